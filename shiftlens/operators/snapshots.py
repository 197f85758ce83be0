"""Snapshots: new ones, latest, counts, sequence numbers, run summaries; ``store`` keeps them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shiftlens.functions.ranking import ordered_rank
from shiftlens.schemas import SPEC_FIELDS

# --- append -----------------------------------------------------------------


def first_per_id(snapshots: DataFrame, arrival: str = "captured_at") -> DataFrame:
    """One header per snapshot_id: the first to arrive (partial aggregation, no window)."""
    rest = [c for c in snapshots.columns if c != "snapshot_id"]
    picked = F.min(F.struct(arrival, *[c for c in rest if c != arrival]))
    return snapshots.groupBy("snapshot_id").agg(picked.alias("__first")).select(
        *[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in snapshots.columns]
    )


def new_snapshots(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Headers to append: first of each id, and not stored before."""
    return first_per_id(incoming).join(stored.select("snapshot_id"), "snapshot_id", "left_anti").select(
        *incoming.columns
    )


def stored(spark: SparkSession, schema: T.StructType | str, path: str) -> DataFrame:
    """What a Parquet store holds; nothing if it does not exist yet."""
    try:
        return spark.read.schema(schema).option("ignoreMissingFiles", "true").option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(incoming: DataFrame, path: str) -> None:
    """Append snapshot headers to a Parquet store; writing the same ids again changes nothing.

    For headers alone; ``store.SnapshotStore`` keeps headers and columns together.
    """
    held = stored(incoming.sparkSession, incoming.schema, path)
    new_snapshots(incoming, held).write.mode("append").parquet(path)


# --- lookups ----------------------------------------------------------------


def latest(snapshots: DataFrame) -> DataFrame:
    """Newest header per source by (captured_at, snapshot_id)."""
    rest = [c for c in snapshots.columns if c not in ("source_identifier", "captured_at", "snapshot_id")]
    newest = F.max(F.struct("captured_at", "snapshot_id", *rest))
    return (
        snapshots.groupBy("source_identifier")
        .agg(newest.alias("__newest"))
        .select("source_identifier", "__newest.*")
    )


def counts(snapshots: DataFrame) -> DataFrame:
    """Stored snapshots per source and in total (``source_identifier`` NULL)."""
    return snapshots.rollup("source_identifier").agg(F.count(F.lit(1)).alias("snapshots"))


def table_lookup(columns: DataFrame, table: str) -> DataFrame:
    """Columns of that table in order, per snapshot; no row for a snapshot without it."""
    return columns.where(F.col("table_identifier") == table)


def column_lookup(columns: DataFrame, table: str, name: str, position: str | None = None) -> DataFrame:
    """First column of that name in that table, per snapshot; none when absent.

    ``position`` orders repeated rows of one column (table, name, snapshot), of which the last one counts.
    """
    hit = table_lookup(columns, table).where(F.col("name") == name)
    keys = ["source_identifier", "snapshot_id"]
    rest = [c for c in columns.columns if c not in (*keys, "ordinal_position", position)]
    row = F.struct("ordinal_position", *rest)
    found = F.min(row) if position is None else F.max_by(row, position)
    return hit.groupBy(*keys).agg(found.alias("__c")).select(*keys, "__c.*")


# --- documents --------------------------------------------------------------


def to_documents(columns: DataFrame, *keys: str) -> DataFrame:
    """One JSON text per column row; ``from_documents`` restores the row."""
    return columns.select(*keys, F.to_json(F.struct(*SPEC_FIELDS)).alias("document"))


def from_documents(documents: DataFrame, *keys: str) -> DataFrame:
    from shiftlens.schemas import COLUMN_SPEC

    spec = F.from_json("document", COLUMN_SPEC)
    return documents.select(*keys, spec.alias("__spec")).select(*keys, "__spec.*")


# --- sequence ---------------------------------------------------------------


def sequence(snapshots: DataFrame, **rank_options: int) -> DataFrame:
    """Adds ``seq`` from 1 per source in (captured_at, snapshot_id) order, ``is_baseline``, ``is_last``."""
    ranked = ordered_rank(
        snapshots, ["source_identifier"], ["captured_at", "snapshot_id"], "seq", "__size", **rank_options
    )
    return ranked.select(
        *snapshots.columns,
        "seq",
        (F.col("seq") == 1).alias("is_baseline"),
        (F.col("seq") == F.col("__size")).alias("is_last"),
    )


def run_summary(sequenced: DataFrame, events: DataFrame) -> DataFrame:
    """Per (source, seq): baseline flag and number of events."""
    n = events.groupBy("source_identifier", "seq").agg(F.count(F.lit(1)).alias("__events"))
    return sequenced.join(n, ["source_identifier", "seq"], "left").select(
        "source_identifier", "seq", "is_baseline", F.coalesce("__events", F.lit(0)).alias("event_count")
    )
