"""A snapshot store: headers, columns, and a log of ids under one commit record.

An append writes the headers, the columns and the ids of the new snapshots into folders of a batch of its own, and its commit
record last, one small file that appears whole or not at all. Readers take the batches that have a record, so a crash
leaves either all of a batch or nothing of it; the folders it left are never read. What is stored already is looked up in the
id log, which has one short row a snapshot: no header or column file is opened by an append. One writer appends at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shiftlens.operators.snapshots import first_per_id, latest, stored

_COMMIT = "batch string, snapshots long"


class SnapshotStore:
    """Headers (snapshot_id, source_identifier, captured_at, ...) and columns (source_identifier, snapshot_id, ...) under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """(batch, snapshots): one row for each append that was finished."""
        return stored(self.spark, _COMMIT, f"{self.path}/commits")

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        """Rows of the committed batches; the folders of others are pruned."""
        batches = [r["batch"] for r in self.commits().select("batch").collect()]  # one short name an append
        held = stored(self.spark, T.StructType([*schema.fields, T.StructField("batch", T.StringType())]), f"{self.path}/{part}")
        return held.where(F.col("batch").isin(batches)).select(*schema.fieldNames())

    def ids(self) -> DataFrame:
        return self._read("ids", T.StructType([T.StructField("snapshot_id", T.StringType())]))

    def headers(self, schema: T.StructType) -> DataFrame:
        return self._read("headers", schema)

    def columns(self, schema: T.StructType) -> DataFrame:
        """Column rows; a filter on ``source_identifier`` reads that source's folders only."""
        return self._read("columns", schema)

    def append(self, headers: DataFrame, columns: DataFrame) -> str | None:
        """Store the snapshots not stored before, with their columns; the name of the batch, None if there was nothing new.

        Of headers with the same id the first to arrive counts. Column rows of ids without a header are left out.
        """
        batch = uuid.uuid4().hex
        at = lambda part: f"{self.path}/{part}/batch={batch}"
        fresh = first_per_id(headers).join(self.ids(), "snapshot_id", "left_anti").select(*headers.columns)
        fresh.write.parquet(at("headers"))
        fresh = self.spark.read.schema(headers.schema).parquet(at("headers"))
        fresh.select("snapshot_id").write.parquet(at("ids"))
        new = self.spark.read.schema("snapshot_id string").parquet(at("ids"))
        n = new.count()
        if not n:
            return None
        rows = columns.join(new, "snapshot_id", "left_semi").select(*columns.columns)
        # dealt by source and snapshot: a task writes few folders and a large source is written by many
        rows.repartition("source_identifier", "snapshot_id").write.partitionBy("source_identifier").parquet(at("columns"))
        self._commit(batch, n)
        return batch

    def _commit(self, batch: str, n: int) -> None:
        self.spark.createDataFrame([(batch, n)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def latest_columns(self, headers: T.StructType, columns: T.StructType) -> DataFrame:
        """Column rows of the newest snapshot of each source."""
        newest = latest(self.headers(headers)).select("source_identifier", "snapshot_id")
        return self.columns(columns).join(newest, ["source_identifier", "snapshot_id"], "left_semi").select(*columns.fieldNames())
