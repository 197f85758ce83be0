"""Trailing-window rate limit, exact, on a bounded number of rows for each task.

An event is let through while fewer than N events let through before it lie within the last W
seconds (an event exactly W old still counts). What a window holds depends on the one before, so
the fold over time is a chain; it takes at most N steps a window, because each step jumps to the
next event let through. Three things keep a task from reading every event:

* of the rows of one microsecond only the first N + 1 are kept (per task before the shuffle);
* stretches between empty windows are independent and folded apart;
* a stretch is cut into chunks of whole windows, about ``pieces * ROWS`` rows each. Round k folds chunk k of every
  stretch, beginning with the last N times let through before it, so each round is exact and nothing is folded twice.

A window with more rows than that is a chunk of its own. Nothing let through in it expires in it, so all the times at
which a place falls free in it are known from the round before: the first N rows after each of them are all it can
need, and tasks pick them before the fold. Rounds are as many as the longest stretch has chunks: in proportion to its rows, and
at most one a window.

Whether any other event meets a full window is then an equi-join with at most 2N rows per bucket.

Rows with equal scope, time and id are one event.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shiftlens.functions.durable import cut, new_path

PIECES, ROWS = 256, 4096  # a fold reads about so many times so many rows
_MICROS = 1_000_000
_NEVER = -(2**62)


class Slots:
    """The last ``n`` times let through, and a walk over sorted times that takes the free ones."""

    def __init__(self, n: int, width: int, taken: list[int] | None = None) -> None:
        self.width = width
        self.taken = deque(taken or [], maxlen=n)

    def free(self) -> int:
        """A row is let through if its time is above this one."""
        return self.taken[0] + self.width if len(self.taken) == self.taken.maxlen else _NEVER

    def walk(self, times: np.ndarray) -> list[int]:
        """Places let through."""
        passed, at = [], 0
        while (i := max(at, int(np.searchsorted(times, self.free(), "right")))) < len(times):
            passed.append(i)
            self.taken.append(int(times[i]))
            at = i + 1
        return passed


def _widths(width: int, pieces: int) -> list[int]:
    """Cell widths from a piece of a window down to a microsecond."""
    out = [max(1, width // pieces)]
    while out[-1] > 1:
        out.append(max(1, out[-1] // pieces))
    return out


def _first(rows: DataFrame, n: int, start: int, width: int) -> DataFrame:
    """First n + 1 rows of every cell; cells are counted from ``start``."""
    cell = F.floor((F.col("t") - start) / F.lit(width))
    place = F.dense_rank().over(Window.partitionBy("scope", "__cell").orderBy("t", "id"))
    kept = rows.withColumn("__cell", cell).withColumn("__n", place).where(F.col("__n") <= n + 1)
    return kept.groupBy("scope", "__cell", "t", "id").agg(F.lit(False).alias("earlier")).drop("__cell")


def _chain(n: int, width: int, schema: T.StructType):
    """Fold of rows sorted by (scope, stretch, earlier first, time, id), batch by batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slots = None, Slots(n, width)
        for batch in batches:
            scopes, stretches = batch.column("scope").to_pylist(), batch.column("stretch").to_numpy()
            times = batch.column("t").to_numpy()
            earlier = batch.column("earlier").to_numpy(zero_copy_only=False).astype(bool)
            turn = [0, *(i for i in range(1, len(scopes)) if stretches[i] != stretches[i - 1] or scopes[i] != scopes[i - 1]), len(scopes)]
            passed = []
            for a, b in zip(turn, turn[1:]):
                if a == b:
                    continue
                if key != (scopes[a], stretches[a]):
                    key, slots = (scopes[a], stretches[a]), Slots(n, width)
                old = int(earlier[a:b].sum())
                slots.taken.extend(times[a : a + old].tolist())
                passed += [i + a + old for i in slots.walk(times[a + old : b])]
            if passed:
                yield batch.select(schema.names).take(pa.array(passed)).cast(arrow)

    return run


def _folded(rows: DataFrame, before: DataFrame, n: int, width: int) -> DataFrame:
    """(scope, stretch, t, id) let through of one chunk of each stretch, after the times (scope, stretch, t) ``before`` it."""
    names = ["scope", "stretch", "t", "id"]
    old = before.select("scope", "stretch", "t", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(True).alias("earlier"))
    ready = rows.select(*names, F.lit(False).alias("earlier")).unionByName(old)
    ready = ready.repartition("scope", "stretch").sortWithinPartitions("scope", "stretch", F.desc("earlier"), "t", "id")
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names])
    return ready.mapInArrow(_chain(n, width, schema), schema)


def _newest(times: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n newest rows of each key."""
    return times.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("t")))).where(F.col("__n") <= n).drop("__n")


def _needed(rows: DataFrame, before: DataFrame, n: int, width: int) -> DataFrame:
    """Rows of single windows that may be let through: the first n after each time at which a place falls free."""
    taken = before.groupBy("scope", "stretch").agg(F.collect_list("t").alias("__taken"))
    free = F.expr(f"coalesce(size(filter(__taken, x -> x + {width} < t)), 0)")
    place = F.row_number().over(Window.partitionBy("scope", "stretch", "__free").orderBy("t", "id"))
    met = rows.join(taken, ["scope", "stretch"], "left").withColumn("__free", free)
    return met.withColumn("__n", place).where(F.col("__n") <= n).select(*rows.columns)


def _chunks(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(scope, bucket, stretch, chunk, crowded), a row for each window of time that has rows."""
    windows = rows.groupBy("scope", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_time = Window.partitionBy("scope").orderBy("bucket")
    windows = windows.withColumn("gap", F.when(F.col("bucket") - F.lag("bucket").over(by_time) > 1, 1).otherwise(0))
    windows = windows.withColumn("stretch", F.sum("gap").over(by_time)).withColumn("crowded", F.col("n") > most)
    inside = Window.partitionBy("scope", "stretch").orderBy("bucket")
    above = F.floor((F.sum("n").over(inside) - F.col("n")) / most)
    windows = windows.withColumn("above", above)
    turns = (F.col("above") != F.lag("above").over(inside)) | F.col("crowded") | F.lag("crowded").over(inside)
    windows = windows.withColumn("turn", F.when(F.row_number().over(inside) == 1, 0).when(turns, 1).otherwise(0))
    return windows.select("scope", "bucket", "stretch", F.sum("turn").over(inside).alias("chunk"), "crowded")


def admit(candidates: DataFrame, n: int, width: int, prior: DataFrame | None = None, pieces: int = PIECES) -> DataFrame:
    """Rows (scope, t, id) let through, from candidates (scope, t in microseconds, id).

    ``prior`` holds (scope, t) let through before the first candidate.
    """
    spark = candidates.sparkSession
    rows = _first(candidates.select("scope", "t", "id"), n, 0, _widths(width, pieces)[-1])
    if prior is not None:
        newest = _newest(prior.select("scope", "t"), n, "scope")
        rows = rows.unionByName(newest.withColumns({"id": F.lit(None).cast(rows.schema["id"].dataType), "earlier": F.lit(True)}))
    rows = cut(rows.withColumn("bucket", F.floor(F.col("t") / width)), "candidates")
    chunks = cut(_chunks(rows, width, pieces * ROWS), "chunks")
    rounds = chunks.groupBy("chunk").agg(F.bool_or("crowded").alias("crowded")).orderBy("chunk").collect()
    placed = rows.join(chunks, ["scope", "bucket"])
    before = prior_times = placed.where("earlier").select("scope", "stretch", "t")
    rows = placed.where(~F.col("earlier")).select("scope", "stretch", "t", "id", "chunk", "crowded")
    if len(rounds) > 1:
        path = new_path(spark, "chunks")
        rows.repartitionByRange("chunk", "t").write.partitionBy("chunk").parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
    found, path = rows.select("scope", "stretch", "t", "id").limit(0), new_path(spark, "let-through")
    for r in rounds:
        here = rows.where(F.col("chunk") == r["chunk"])
        if r["crowded"]:
            here = here.where(~F.col("crowded")).unionByName(_needed(here.where("crowded"), before, n, width))
        _folded(here, before, n, width).write.mode("append").parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        before = _newest(prior_times.unionByName(found.select("scope", "stretch", "t")), n, "scope", "stretch")
    return found.select("scope", "t", "id")


def rate_limit(
    events: DataFrame,
    slot_taker: str,
    *,
    scope: str | None = None,
    time: str = "detected_at",
    event_id: str = "event_id",
    max_events: int = 10,
    window_seconds: int = 3600,
    prior: DataFrame | None = None,
    pieces: int = PIECES,
) -> tuple[DataFrame, DataFrame]:
    """(events with ``rate_limited``, rows let through).

    ``slot_taker`` names the boolean column of events that use a place when let through; the
    others only learn whether the window is full. Order is (time, event id).
    """
    width = window_seconds * _MICROS
    keyed = events.withColumns(
        {
            "scope": F.col(scope).cast("string") if scope else F.lit("global"),
            "t": F.unix_micros(F.col(time).cast("timestamp")),
            "id": F.col(event_id),
        }
    )
    passed = admit(keyed.where(F.col(slot_taker)).select("scope", "t", "id"), max_events, width, prior, pieces)
    taken = passed.select("scope", "t", "id", F.lit(False).alias("earlier"))
    if prior is not None:
        blank = F.lit(None).cast(taken.schema["id"].dataType).alias("id")
        taken = taken.unionByName(prior.select("scope", "t", blank, F.lit(True).alias("earlier")))
    near = (
        taken.withColumn("__b", F.floor(F.col("t") / width))
        .select(
            "scope",
            F.explode(F.array(F.col("__b"), F.col("__b") + 1)).alias("__bucket"),
            F.struct("t", "id", "earlier").alias("__slot"),
        )
        .groupBy("scope", "__bucket")
        .agg(F.collect_list("__slot").alias("__slots"))
    )
    here = F.expr(
        f"coalesce(size(filter(__slots, a -> a.t >= t - {width} "
        "and (a.earlier or a.t < t or (a.t = t and a.id < id)))), 0)"
    )
    judged = (
        keyed.withColumn("__bucket", F.floor(F.col("t") / width))
        .join(near, ["scope", "__bucket"], "left")
        .withColumn("rate_limited", here >= max_events)
        .select(*events.columns, "rate_limited")
    )
    return judged, passed
