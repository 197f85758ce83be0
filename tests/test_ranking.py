"""Rank and lag helpers against plain windows, with hot keys forced."""

import random

from pyspark.sql import Window, functions as F

from shiftlens.functions.ranking import chunked_lag, ordered_rank


def _rows(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", i, f"n{rng.randrange(10**6):06d}_{i}") for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, name string")


def test_ordered_rank_equals_row_number_when_keys_are_split(spark):
    df = _rows(spark)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("name"))).withColumn(
        "n", F.count("*").over(Window.partitionBy("k"))
    )
    for hot_rows, pieces in ((50, 7), (10, 64), (10**9, 8)):
        got = ordered_rank(df, ["k"], ["name"], "r", "n", hot_rows=hot_rows, pieces=pieces)
        assert got.exceptAll(want.select(got.columns)).isEmpty()
        assert got.count() == want.count()


def test_hot_key_is_really_split(spark):
    df = _rows(spark)
    plan = ordered_rank(df, ["k"], ["name"], "r", hot_rows=50, pieces=16)
    assert "__piece" in plan._jdf.queryExecution().toString()


def test_chunked_lag_equals_lag(spark):
    df = _rows(spark)
    want = df.withColumn("p", F.lag("name").over(Window.partitionBy("k").orderBy("i")))
    got = chunked_lag(df, ["k"], F.floor(F.col("i") / 37), "i", "name", "p")
    assert got.select(want.columns).exceptAll(want).isEmpty()
    assert got.count() == want.count()


def test_chunked_lag_keeps_null_values(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 10, "y"), ("a", 11, "z")], "k string, i long, v string")
    got = chunked_lag(df, ["k"], F.floor(F.col("i") / 5), "i", "v", "p").orderBy("i").collect()
    assert [r.p for r in got] == [None, "x", None, "y"]
