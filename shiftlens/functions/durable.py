"""Cut lineage through tables in the shared folder the cluster names.

Iterative plans and rank plans read their input several times. A written table
survives the loss of an executor, keeps column pruning, and gives the optimizer
a real size, so the join strategy that follows is chosen on measured bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="shiftlens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shiftlens-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """A stored table and numbers observed while it was written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in measures.items()]), label)
    return out, {k: v or 0 for k, v in seen.get.items()}


#: Bytes of rows that a file of :func:`packed` gets.
FILE_BYTES = 4 << 20


def packed(df: DataFrame, label: str, most: int | None, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`counted` in few files: no more than ``most`` bytes, a bound of the table's size (none: not known), need.

    A file of a few rows costs far more than its rows; on a local store each one also forks processes beside the executor.
    Only the last stage has fewer tasks, in proportion to the bound; exchanges before it keep theirs.
    """
    return counted(df if most is None else df.coalesce(1 + most // FILE_BYTES), label, **measures)


def bucketed(df: DataFrame, key: str, label: str, last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table in the shared folder, stored in buckets of ``key``: joins and groupings by it do not move its rows again.

    ``last`` is applied to the rows once those of one key are together; it may group by the key, alone or first.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    last(df.repartition(parts, key)).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


#: Partitions of :func:`spread`: so many times the session's, but not more than a map task writes without sorting its rows first
#: (``spark.shuffle.sort.bypassMergeThreshold``).
FINER, UNSORTED = 8, 200


DEAL = "__deal"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key together, in more and so smaller partitions than the session's, for wide rows that a task must sort.

    Adds ``DEAL``, a hash of the keys. An aggregate by it and the keys needs no other exchange, so nothing is sorted
    before this one; as its first column it also makes that sort one of numbers. A key may be constant.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(DEAL, F.xxhash64(*keys)).repartition(max(parts, min(FINER * parts, UNSORTED)), DEAL)


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint a narrow control table (one row per scope, stretch, ...) in the same folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
