"""Row rules on incoming relations: trimmed strings, lengths, ranges, presence by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.schemas import DESTRUCTIVE, severity_of, severity_rank


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.regexp_replace(c, r"^\s+|\s+$", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )


def _length_rule(name: str, limit: int) -> tuple[str, Column]:
    size = F.length(name)
    return f"{name}_length", F.coalesce(size.between(1, limit), F.lit(False))


def _range_rule(name: str) -> tuple[str, Column]:
    return f"{name}_negative", F.coalesce(F.col(name) >= 0, F.lit(True))


def column_rules() -> list[tuple[str, Column]]:
    """(reason, condition that must hold) for column rows."""
    return [
        _length_rule("name", 128),
        _length_rule("data_type", 64),
        ("nullable_missing", F.col("nullable").isNotNull()),
        ("ordinal_position_negative", F.coalesce(F.col("ordinal_position") >= 0, F.lit(False))),
        _range_rule("character_max_length"),
        _range_rule("numeric_precision"),
        _range_rule("numeric_scale"),
    ]


def change_rules() -> list[tuple[str, Column]]:
    kind, before, after = F.col("kind"), F.col("column_before"), F.col("column_after")
    return [
        ("kind_unknown", kind.isin("added", "removed", "modified", "table_added", "table_removed")),
        ("after_missing", ~kind.isin("added", "modified") | after.isNotNull()),
        ("before_missing", ~kind.isin("removed", "modified") | before.isNotNull()),
    ]


def event_rules() -> list[tuple[str, Column]]:
    change = F.col("change_type")
    floor = severity_rank(severity_of(change))
    return [
        ("destructive_auto_merge", ~(change.isin(*DESTRUCTIVE) & F.col("auto_mergeable"))),
        ("severity_below_default", severity_rank(F.col("severity")) >= floor),
    ]


def with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reasons``: the rules a row breaks, in rule order."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reasons``)."""
    checked = with_reasons(df, rules)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)
