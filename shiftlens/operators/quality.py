"""Data tests on monitored tables, checks before a change, proposal validation, demo models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The data tests a proposal may ask for.
ALLOWED_TESTS = ("not_null", "unique", "accepted_values", "relationships")
SUMMARY_LIMIT = 400


# --- data tests -------------------------------------------------------------


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, violations) for many columns in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "violations")


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts (non-null keys)."""
    present = df.dropna(subset=list(columns))
    return present.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the set, with their counts; NULL is not a value."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return bad.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def relationships(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent row, with their counts. Keys are counted before the join,
    so a key that fills a third of the table crosses the shuffle as one row per task."""
    keys = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(key).alias(column))
    return keys.join(parents, column, "left_anti")


# --- checks before a change -------------------------------------------------


def preflight(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(check, column, blocking_rows): rows that would not survive each change, in one scan.

    Build the conditions with :func:`does_not_cast`, :func:`too_long`, :func:`out_of_range`
    or ``col.isNull()``.
    """
    counted = df.agg(*[F.count_if(cond).alias(name) for name, (_, cond) in checks.items()])
    columns = F.create_map(*[F.lit(x) for name, (col, _) in checks.items() for x in (name, col)])
    return counted.unpivot([], list(checks), "check", "blocking_rows").select(
        "check", columns[F.col("check")].alias("column"), "blocking_rows"
    )


def does_not_cast(column: str, data_type: str) -> Column:
    """Value is present but is not kept exactly by the narrower type."""
    narrow = F.expr(f"try_cast({column} AS {data_type})")
    return F.col(column).isNotNull() & (narrow.isNull() | (narrow != F.col(column)))


def too_long(column: str, length: int) -> Column:
    return F.length(column) > length


def out_of_range(column: str, precision: int, scale: int) -> Column:
    """Magnitude does not fit numeric(precision, scale)."""
    return F.abs(F.col(column)) >= F.lit(10.0 ** (precision - scale))


# --- proposals --------------------------------------------------------------


def check_proposals(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds ``reasons`` to proposals (id, table, summary, patched_sources_yml, tests_to_add, referenced_columns).

    ``allowed`` are (table, column) rows. References are checked as rows against them, so a
    table with very many columns is never gathered into a list.
    """
    asked = proposals.select("id", "table", F.explode("referenced_columns").alias("column"))
    strange = asked.join(allowed, ["table", "column"], "left_anti").select("id").distinct().withColumn("__bad", F.lit(True))
    size = F.length("summary")
    tests = F.array_except("tests_to_add", F.array(*[F.lit(t) for t in ALLOWED_TESTS]))
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(size.between(1, SUMMARY_LIMIT), F.lit(False)), "summary_length"),
            F.when(F.coalesce(F.length("patched_sources_yml"), F.lit(0)) == 0, "patch_missing"),
            F.when(F.size(tests) > 0, "test_not_allowed"),
            F.when(F.col("__bad"), "column_not_in_source"),
        )
    )
    return proposals.join(strange, "id", "left").withColumn("reasons", reasons).drop("__bad")


# --- models of the sample project -------------------------------------------


def stage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Staging projection: rename and prune."""
    return df.select(*[F.col(src).alias(name) for name, src in columns.items()])


def orders_fact(orders: DataFrame, customers: DataFrame) -> DataFrame:
    right = customers.select("customer_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email"))
    return orders.join(right, "customer_id", "left").select(
        "order_id", "customer_id", "customer_name", "customer_email", "amount", "status", F.col("created_at").alias("ordered_at")
    )


def daily_revenue(fact: DataFrame, status: str = "paid") -> DataFrame:
    return (
        fact.where(F.col("status") == status)
        .groupBy(F.to_date("ordered_at").alias("order_date"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("amount").alias("gross_revenue"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
    )
