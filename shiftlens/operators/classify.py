"""Rule cascade from raw changes to typed events, with the batch rename matcher."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions import types as ty
from shiftlens.functions.durable import cut
from shiftlens.functions.ranking import ordered_rank
from shiftlens.schemas import DESTRUCTIVE, NEEDS_BACKFILL, severity_of, severity_rank

GROUP = ("source_identifier", "seq", "table_identifier")


# --- rules ------------------------------------------------------------------


def added_type(after: Column) -> Column:
    return (
        F.when(after["nullable"], "column_added_nullable")
        .when(after["default"].isNotNull(), "column_added_not_null")
        .otherwise("column_added_not_null_no_default")
    )


def modified_type(before: Column, after: Column, before_family: Column, after_family: Column) -> Column:
    """First rule that holds decides; NULL when none does. One codegen'd chain."""
    return (
        F.when(before["is_primary_key"] != after["is_primary_key"], "pk_changed")
        .when(before["nullable"] & ~after["nullable"], "nullability_tightened")
        .when(ty.enum_grew(before, after), "enum_value_added")
        .when(
            before_family != after_family,
            F.when(ty.is_widening(before_family, after_family), "type_widened")
            .when(ty.is_narrowing(before_family, after_family), "type_narrowed")
            .otherwise("type_incompatible"),
        )
        .when(ty.capacity_grew(before, after), "type_widened")
        .when(ty.capacity_shrank(before, after), "type_narrowed")
        .when(ty.precision_moved(before, after), "precision_changed")
        .when(~before["default"].eqNullSafe(after["default"]), "default_changed")
    )


def change_type(kind: Column, before: Column, after: Column, before_family: Column, after_family: Column) -> Column:
    return (
        F.when(kind == "added", added_type(after))
        .when(kind == "removed", F.lit("column_dropped"))
        .when(kind == "modified", modified_type(before, after, before_family, after_family))
    )


# --- events -----------------------------------------------------------------

# Emission order within one table: drops and renames, then adds, then the rest.
_EMIT = {"removed": 0, "renamed": 0, "added": 1, "modified": 2}


def _events(typed: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Typed changes -> event rows; ids are a hash of what the event says, so reruns agree."""
    b, a = F.col("column_before"), F.col("column_after")
    ident = F.concat(F.col("table_identifier"), F.lit("."), F.coalesce(a["name"], b["name"]))
    emit = F.create_map(*[F.lit(x) for kv in _EMIT.items() for x in kv])[F.col("kind")]
    return (
        typed.where(F.col("change_type").isNotNull())
        .withColumn("identifier", ident)
        .select(
            *group,
            F.sha2(
                F.concat_ws("|", *[F.col(g).cast("string") for g in group], "identifier", "change_type", b["name"]),
                256,
            ).alias("event_id"),
            "identifier",
            "change_type",
            severity_of(F.col("change_type")).alias("severity"),
            "column_before",
            "column_after",
            F.lit(1.0).alias("confidence"),
            F.col("change_type").isin(*DESTRUCTIVE).alias("destructive"),
            F.lit(False).alias("auto_mergeable"),
            F.col("change_type").isin(*NEEDS_BACKFILL).alias("requires_backfill"),
            F.when(
                F.col("change_type") == "column_renamed",
                F.array(F.format_string("renamed from '%s' → '%s'", b["name"], a["name"])),
            )
            .otherwise(F.array().cast("array<string>"))
            .alias("notes"),
            F.when(F.col("change_type") == "column_renamed", F.array(F.lit("removed"), F.lit("added")))
            .otherwise(F.array("kind"))
            .alias("raw_kinds"),
            F.struct(emit.alias("emit"), *order).alias("emission"),
        )
    )


def _typed(changes: DataFrame) -> DataFrame:
    b, a = F.col("column_before"), F.col("column_after")
    with_families = changes.withColumn("__bf", ty.type_family(b["data_type"])).withColumn(
        "__af", ty.type_family(a["data_type"])
    )
    return with_families.withColumn(
        "change_type", change_type(F.col("kind"), b, a, F.col("__bf"), F.col("__af"))
    ).drop("__bf", "__af")


def column_level(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind").isin("added", "removed", "modified"))


def table_notes(raw: DataFrame) -> DataFrame:
    """Table-level changes: kept as notes, never events."""
    return raw.where(F.col("kind").isin("table_added", "table_removed"))


def classify_single(
    raw: DataFrame, group: Sequence[str] = GROUP, order: Sequence[str] = ("name",)
) -> DataFrame:
    """Each change by itself: a rename stays a drop and an add. No shuffle."""
    return _events(_typed(column_level(raw)), group, order)


def rename_pairs(
    raw: DataFrame, group: Sequence[str] = GROUP, order: Sequence[str] = ("name",), **rank_options: int
) -> DataFrame:
    """Removed and added columns, the k-th removed of a family next to its k-th added.

    Taking each removed column in order with the first unused added one of its family
    pairs equal ranks, so a rank on both sides and one grouping replace the scan.
    """
    spec = F.coalesce("column_before", "column_after")
    sided = raw.where(F.col("kind").isin("added", "removed")).withColumn(
        "__family", ty.type_family(spec["data_type"])
    )
    ranked = ordered_rank(sided, [*group, "__family", "kind"], order, "__k", **rank_options)

    def side(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct(column, *order)))

    both = ranked.groupBy(*group, "__family", "__k").agg(
        side("removed", "column_before").alias("__r"), side("added", "column_after").alias("__a")
    )
    kind = (
        F.when(F.col("__a").isNull(), "removed").when(F.col("__r").isNull(), "added").otherwise("renamed")
    )
    first = [F.coalesce(F.col(f"__r.{o}"), F.col(f"__a.{o}")).alias(o) for o in order]
    return both.select(
        *group,
        kind.alias("kind"),
        F.col("__r.column_before").alias("column_before"),
        F.col("__a.column_after").alias("column_after"),
        *first,
    )


def classify_batch(
    raw: DataFrame, group: Sequence[str] = GROUP, order: Sequence[str] = ("name",), **rank_options: int
) -> DataFrame:
    """Renames matched within each table, everything else as in single mode.

    The changes are written once: ranking reads them several times, and the diff behind them
    is far larger than they are.
    """
    raw = cut(column_level(raw), "changes")
    pairs = rename_pairs(raw, group, order, **rank_options)
    renamed = F.when(F.col("kind") == "renamed", F.lit("column_renamed"))
    paired = _typed(pairs).withColumn("change_type", F.coalesce(renamed, "change_type"))
    modified = _typed(raw.where(F.col("kind") == "modified")).select(*paired.columns)
    return _events(paired.unionByName(modified), group, order)


# --- after classification ---------------------------------------------------


def event_order() -> Column:
    """The smallest is the most severe event, and among those the one emitted first."""
    return F.struct((-severity_rank(F.col("severity"))).alias("r"), "emission", "identifier", "change_type", "severity")


def top_event(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most severe event per key; ties go to the one emitted first.

    ``min`` of (negated rank, emission) combines map-side, so a hot key costs one row per task.
    """
    best = F.min(event_order())
    return events.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, "__b.identifier", "__b.change_type", "__b.severity"
    )


def key_array_changes(table_sides: DataFrame) -> DataFrame:
    """Opt-in: (step, which, keys_before, keys_after) of tables on both sides whose ``primary_key`` or ``partition_keys`` array differs, in members or order."""
    step = ("source_identifier", "seq", "table_identifier")
    side = lambda curr: F.max(F.when(F.col("is_curr") == curr, F.struct("primary_key", "partition_keys")))
    both = table_sides.groupBy(*step).agg(side(False).alias("__b"), side(True).alias("__a")).where("__b is not null and __a is not null")
    arrays = F.array(
        *[F.struct(F.lit(w).alias("which"), F.col(f"__b.{w}").alias("keys_before"), F.col(f"__a.{w}").alias("keys_after")) for w in ("primary_key", "partition_keys")]
    )
    rows = both.select(*step, F.explode(arrays).alias("__k")).select(*step, "__k.*")
    return rows.where(~F.col("keys_before").eqNullSafe(F.col("keys_after")))


def partition_key_changes(table_sides: DataFrame) -> DataFrame:
    """Opt-in: tables on both sides whose partition-key array differs."""
    step = ("source_identifier", "seq", "table_identifier")
    before = F.max(F.when(~F.col("is_curr"), F.struct("partition_keys")))
    after = F.max(F.when(F.col("is_curr"), F.struct("partition_keys")))
    both = table_sides.groupBy(*step).agg(before.alias("__b"), after.alias("__a"))
    kept = both.where(
        F.col("__b").isNotNull() & F.col("__a").isNotNull() & ~F.col("__b").eqNullSafe(F.col("__a"))
    )
    return kept.select(
        *step,
        F.lit("partition_key_changed").alias("change_type"),
        severity_of(F.lit("partition_key_changed")).alias("severity"),
        F.col("__b.partition_keys").alias("keys_before"),
        F.col("__a.partition_keys").alias("keys_after"),
    )
