"""Rank and lag that do not put one hot key into one task.

A window partitioned by a key sorts the whole key in one task. Both helpers
give exactly the window's answer, but split a hot key into ordered pieces first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_ROWS = 1_000_000
PIECES = 256


def ordered_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    size_out: str | None = None,
    hot_rows: int = HOT_ROWS,
    pieces: int = PIECES,
) -> DataFrame:
    """``row_number()`` over ``keys`` ordered by ``order`` (ascending, unique within a key; keys are not NULL).

    Keys above ``hot_rows`` are cut at about ``pieces`` splitters, chosen by a hash of the
    order columns: the choice is the same on every recomputation. Without hot keys the
    splitter side is empty at run time and AQE drops its joins, leaving one aggregate and
    one window.
    """
    keys = list(keys)
    df = df.withColumn("__spot", F.struct(*order))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = sizes.where(F.col("__n") > hot_rows).withColumn("__step", F.ceil(F.col("__n") / pieces))
    marks = (
        df.select(*keys, "__spot")
        .join(hot, keys)
        .where(F.pmod(F.xxhash64("__spot"), F.col("__step")) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("__spot")).alias("__marks"))
    )
    # how many marks are not above a row, by halving
    piece = """aggregate(
        sequence(1, cast(ceil(log2(size(__marks) + 1)) as int)), named_struct('lo', 0, 'hi', size(__marks)),
        (a, i) -> if(a.lo >= a.hi, a, if(get(__marks, cast((a.lo + a.hi) div 2 as int)) <= __spot,
            named_struct('lo', cast((a.lo + a.hi) div 2 as int) + 1, 'hi', a.hi),
            named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int)))),
        a -> a.lo)"""
    placed = df.join(marks, keys, "left").withColumn("__piece", F.coalesce(F.expr(piece), F.lit(0)))
    by_piece = (
        placed.where(F.col("__marks").isNotNull())
        .groupBy(*keys, "__piece")
        .agg(F.count(F.lit(1)).alias("__m"))
    )
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_piece.select(
        *keys, "__piece", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy(*keys, "__piece").orderBy("__spot")
    ranked = (
        placed.withColumn("__r", F.row_number().over(within))
        .join(offsets, [*keys, "__piece"], "left")
        .withColumn(out, (F.col("__r") + F.coalesce(F.col("__offset"), F.lit(0))).cast("long"))
    )
    if size_out:
        ranked = ranked.join(sizes.withColumnRenamed("__n", size_out), keys)
    return ranked.drop("__spot", "__marks", "__piece", "__r", "__offset", "__n", "__step")


def chunked_lag(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: str,
    value: str,
    out: str,
) -> DataFrame:
    """``lag(value)`` over ``keys`` ordered by ``order``; ``chunk`` is a non-decreasing function of ``order``.

    Each (key, chunk) is a window of its own. The first row of a chunk takes the last value
    of the chunk before it, found on one pre-aggregated row per chunk.
    """
    keys = list(keys)
    df = df.withColumn("__chunk", chunk)
    ends = df.groupBy(*keys, "__chunk").agg(
        F.max(F.struct(F.col(order), F.col(value))).getField(value).alias("__end")
    )
    per_key = Window.partitionBy(*keys).orderBy("__chunk")
    carried = ends.select(*keys, "__chunk", F.lag("__end").over(per_key).alias("__carried"))
    within = Window.partitionBy(*keys, "__chunk").orderBy(order)
    return (
        df.withColumn("__lag", F.lag(value).over(within))
        .withColumn("__r", F.row_number().over(within))
        .join(carried, [*keys, "__chunk"])
        .withColumn(out, F.when(F.col("__r") == 1, F.col("__carried")).otherwise(F.col("__lag")))
        .drop("__chunk", "__lag", "__r", "__carried")
    )
