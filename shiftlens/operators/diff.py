"""Differences between consecutive snapshots of every source, in one job.

Every row is emitted for its own step and for the step after it, then grouped by
(source, step, table, name). A group holds the two versions of one column, so no key is
hot however large a source, table or snapshot is. Specs are wide and their maximum needs sorted rows, so rows are
dealt to many small partitions first and sorted once, there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions.durable import DEAL, spread
from shiftlens.schemas import SPEC_FIELDS, spec_struct

# Order of change kinds within one step; column kinds are then ordered per table.
KIND_RANK = {"table_added": 0, "table_removed": 1, "added": 2, "removed": 3, "modified": 4}
STEP = ("source_identifier", "seq")
CHANGE_COLUMNS = (*STEP, "table_identifier", "kind", "name", "column_before", "column_after")


def _two_steps(rows: DataFrame) -> DataFrame:
    """Each row as ``curr`` of its step and ``prev`` of the next; no step 1, none past the last."""
    sides = F.array(
        F.when(~F.col("is_baseline"), F.struct(F.col("seq").alias("seq"), F.lit(True).alias("is_curr"))),
        F.when(~F.col("is_last"), F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("is_curr"))),
    )
    return (
        rows.withColumn("__side", F.explode(F.array_compact(sides)))
        .withColumn("seq", F.col("__side.seq"))
        .withColumn("is_curr", F.col("__side.is_curr"))
        .drop("__side")
    )


def _latest_of(side: Column, position: Column) -> Column:
    """Spec of the last occurrence on one side (NULL when the side has none)."""
    return F.max(F.when(side, F.struct(position.alias("position"), spec_struct().alias("spec"))))["spec"]


def _steps_of(df: DataFrame, sequenced: DataFrame) -> DataFrame:
    header = sequenced.select("source_identifier", "snapshot_id", "seq", "is_baseline", "is_last")
    return df.join(header, ["source_identifier", "snapshot_id"])


def table_presence(sided: DataFrame) -> DataFrame:
    """(step, table, in_prev, in_curr) from sided table rows."""
    key = [*STEP, "table_identifier"]
    return spread(sided.select(*key, "is_curr"), *key).groupBy(DEAL, *key).agg(
        F.bool_or(~F.col("is_curr")).alias("in_prev"), F.bool_or("is_curr").alias("in_curr")
    ).drop(DEAL)


def table_changes(presence: DataFrame) -> DataFrame:
    changed = presence.where(F.col("in_prev") != F.col("in_curr"))
    kind = F.when(F.col("in_curr"), "table_added").otherwise("table_removed")
    return changed.select(*STEP, "table_identifier", kind.alias("kind"))


def paired_columns(sided: DataFrame, position: str | None = None) -> DataFrame:
    """(step, table, name, column_before, column_after) for every column key of a step."""
    at = F.col(position) if position else F.col("ordinal_position")
    key = [*STEP, "table_identifier", "name"]
    return spread(sided, *key).groupBy(DEAL, *key).agg(
        _latest_of(~F.col("is_curr"), at).alias("column_before"),
        _latest_of(F.col("is_curr"), at).alias("column_after"),
    ).drop(DEAL)


def column_changes(paired: DataFrame, tables: DataFrame) -> DataFrame:
    """Added, removed and modified columns of tables present on both sides.

    A modified column proves its table is on both sides, so only one-sided columns are checked
    against the table changes. Both branches read one exchange.
    """
    b, a = F.col("column_before"), F.col("column_after")
    modified = paired.where(b.isNotNull() & a.isNotNull() & ~b.eqNullSafe(a)).withColumn("kind", F.lit("modified"))
    one_sided = paired.where(b.isNull() | a.isNull()).withColumn(
        "kind", F.when(b.isNull(), "added").otherwise("removed")
    )
    of_kept_tables = one_sided.join(
        tables.select(*STEP, "table_identifier"), [*STEP, "table_identifier"], "left_anti"
    )
    return of_kept_tables.select(*CHANGE_COLUMNS).unionByName(modified.select(*CHANGE_COLUMNS))


def history_diff(
    sequenced: DataFrame, tables: DataFrame, columns: DataFrame, position: str | None = None
) -> DataFrame:
    """Raw changes of every consecutive snapshot pair of every source.

    ``sequenced`` are the headers of :func:`snapshots.sequence`; a header without tables
    makes every table of the step before it ``table_removed``.
    """
    presence = table_presence(
        _two_steps(_steps_of(tables.select("source_identifier", "snapshot_id", "table_identifier"), sequenced))
    )
    table_rows = table_changes(presence)
    paired = paired_columns(_two_steps(_steps_of(columns, sequenced)), position)
    return with_table_rows(column_changes(paired, table_rows), table_rows)


def pair_diff(sides: DataFrame, table_sides: DataFrame, position: str | None = None) -> DataFrame:
    """Raw changes of ready-made pairs: rows already carry ``seq`` and ``is_curr``."""
    table_rows = table_changes(table_presence(table_sides))
    return with_table_rows(column_changes(paired_columns(sides, position), table_rows), table_rows)


def with_table_rows(column_rows: DataFrame, table_rows: DataFrame) -> DataFrame:
    return column_rows.unionByName(table_rows, allowMissingColumns=True)


def kind_rank() -> Column:
    pairs = [F.lit(x) for kv in KIND_RANK.items() for x in kv]
    return F.create_map(*pairs)[F.col("kind")]


def change_order(raw: DataFrame) -> DataFrame:
    """Adds the ``order`` struct: table kinds first, then per table added, removed, modified by name."""
    rank = kind_rank()
    table_level = rank < 2
    return raw.withColumn(
        "change_order",
        F.struct(
            F.when(table_level, rank).otherwise(2).alias("level"),
            F.col("table_identifier").alias("table"),
            rank.alias("kind"),
            F.coalesce("name", F.lit("")).alias("name"),
        ),
    )


def modified_fields(raw: DataFrame, fields: Sequence[str] = SPEC_FIELDS) -> DataFrame:
    """Long form of modified changes: one row per field that differs."""
    differs = [
        F.when(
            ~F.col(f"column_before.{f}").eqNullSafe(F.col(f"column_after.{f}")), F.lit(f)
        )
        for f in fields
    ]
    return raw.where(F.col("kind") == "modified").select(
        *STEP, "table_identifier", "name", F.explode(F.array_compact(F.array(*differs))).alias("field")
    )
