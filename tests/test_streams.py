"""Streams with keyed state, over many micro-batches, against the batch functions."""

import random

import pytest
from pyspark.sql import functions as F

from shiftlens.functions.durable import new_path
from shiftlens.operators import cdc_changes, classify, limiter
from shiftlens.sources import cdc
from shiftlens.streaming import batches
from shiftlens.streaming import cdc as cdc_stream
from shiftlens.streaming import limiter as limiter_stream

SCHEMAS = ['{"fields":[{"name":"id","type":"int"}]}', '{"fields":[{"name":"id","type":"long"}]}', '{"fields":[{"name":"id","type":"int"},{"name":"x","type":"string"}]}']
MESSAGES = "topic string, partition int, offset long, value string"


def _files(df_parts, folder):
    for part in df_parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return df_parts[0].schema


def _stream(spark, schema, folder, files):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


# --- change-data messages -----------------------------------------------------


def _messages(n, seed):
    rng = random.Random(seed)
    return [(f"t{rng.randrange(2)}", p, o, rng.choice(SCHEMAS)) for p in range(3) for o in range(n)]  # the same offsets in every partition


def test_hot_topic_is_marked_chunk_by_chunk(spark):
    rows = _messages(40, 1)
    folder = new_path(spark, "hot")
    schema = _files([spark.createDataFrame(rows, MESSAGES)], folder)
    stream = cdc_stream.marked_stream(_stream(spark, schema, folder, 1), chunk=4)
    got = cdc_stream.run_to_table(stream, new_path(spark, "o"), new_path(spark, "c")).select("topic", "partition", "offset", "previous", "is_change")
    want = cdc_changes.mark_changes(cdc.decode(spark.createDataFrame(rows, MESSAGES)), chunk=7).select("topic", "partition", "offset", "previous", "is_change")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # the plain rule: partition by partition, each by offset
    last, changes = {}, {}
    for t, p, o, v in sorted(rows):
        changes[t, p, o], last[t] = last.get(t) != v, v
    assert {(r.topic, r.partition, r.offset): r.is_change for r in got.collect()} == changes


def test_no_frame_holds_more_than_a_chunk():
    import pandas as pd

    rows = pd.DataFrame({"topic": "t", "partition": 0, "offset": [5, 4, 6], "chunk": 1, "schema": ["a", "b", "a"]})
    out = cdc_stream.mark_chunk(rows)
    assert out["offset"].tolist() == [4, 5, 6] and out["chunk"].tolist() == [-1, 1, 1]
    assert out["last"].tolist()[0] == "a" and out["end"].iloc[0] == 6 and out["previous"].tolist()[1:] == ["b", "a"]


def test_state_holds_the_current_schema_and_none_is_an_error(spark):
    folder, progress = new_path(spark, "state"), new_path(spark, "c")
    parts = [[("a", 0, 0, SCHEMAS[0]), ("b", 0, 1, SCHEMAS[1])], [("a", 0, 2, SCHEMAS[2])], [("a", 0, 3, None)]]
    schema = _files([spark.createDataFrame(p, MESSAGES) for p in parts], folder)
    primed = spark.createDataFrame([("b", SCHEMAS[1]), ("z", SCHEMAS[0])], "topic string, record_schema string")
    cdc_stream.run_to_table(cdc_stream.marked_stream(_stream(spark, schema, folder, 1), primed), new_path(spark, "o"), progress)
    held = {r.topic: (r.offset, len(r.fields)) for r in cdc_stream.current_state(spark, progress).collect()}
    assert held == {"a": (2, 2), "b": (1, 1), "z": (None, 1)}
    nothing, progress = new_path(spark, "nothing"), new_path(spark, "c")
    schema = _files([spark.createDataFrame([("a", 0, 0, None)], MESSAGES)], nothing)
    cdc_stream.run_to_table(cdc_stream.marked_stream(_stream(spark, schema, nothing, 1)), new_path(spark, "o"), progress)
    with pytest.raises(ValueError, match="no schema is known"):
        cdc_stream.current_state(spark, progress)


# --- rate limit ---------------------------------------------------------------


def _limited(spark, seed, n=300):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        t += rng.choice([0, 1, 700_000, 2_000_000, 9_000_000])
        rows.append((i, t, rng.choice("ab"), rng.random() < 0.8))
    return spark.createDataFrame(rows, "event_id long, us long, team string, takes boolean").selectExpr("event_id", "timestamp_micros(us) detected_at", "team", "takes")


@pytest.mark.parametrize("scope", ["team", None])
def test_keyed_limiter_equals_batch(spark, scope):
    table = _limited(spark, 4).cache()
    folder = new_path(spark, "limited")
    _files([table.where(f"event_id % 5 = {k}") for k in range(4)] + [table.where("event_id % 5 = 4").union(table.where("event_id = 9"))], folder)
    want, _ = limiter.rate_limit(table, "takes", scope=scope, max_events=3, window_seconds=20)
    # every file spans the whole time, so the lateness has to cover it
    stream = limiter_stream.limited_stream(
        _stream(spark, table.schema, folder, 2), "takes", scope=scope, lateness="2 hours", cell_seconds=5, max_events=3, window_seconds=20
    )
    out, progress = new_path(spark, "judged"), new_path(spark, "progress")
    assert cdc_stream.run_to_table(stream, out, progress).count() == 0  # nothing is closed yet
    later = table.limit(1).selectExpr("-1L event_id", "timestamp_micros(1700100000000000) detected_at", "team", "takes")
    _files([later], folder)
    got = cdc_stream.run_to_table(stream, out, progress).select("event_id", "rate_limited")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("event_id", "rate_limited").collect()))


def test_keyed_limiter_in_time_order_over_batches_and_with_prior(spark):
    table = _limited(spark, 8).cache()
    folder = new_path(spark, "limited")
    first = table.agg(F.min(F.unix_micros("detected_at"))).first()[0]
    prior = spark.createDataFrame([("b", first - 1000), ("b", first - 2000), ("a", first - 30_000_000)], "scope string, t long")
    _files([table.where(f"event_id div 60 = {k}") for k in range(5)], folder)
    _files([table.limit(1).selectExpr("-1L event_id", "timestamp_micros(1700100000000000) detected_at", "team", "takes")], folder)
    want, _ = limiter.rate_limit(table, "takes", scope="team", max_events=2, window_seconds=20, prior=prior)
    stream = limiter_stream.limited_stream(
        _stream(spark, table.schema, folder, 1), "takes", scope="team", lateness="30 seconds", cell_seconds=5, max_events=2, window_seconds=20, prior=prior
    )
    got = cdc_stream.run_to_table(stream, new_path(spark, "judged"), new_path(spark, "progress"))
    assert sorted(map(tuple, got.select("event_id", "rate_limited").collect())) == sorted(map(tuple, want.select("event_id", "rate_limited").collect()))


# --- payload schemas ----------------------------------------------------------

DAYS = ['{"k": 1, "a": 1.5}', '{"k": "x"}', None, '{"k": 2, "b": null}', '{"k": 3, "b": true}', '{"k": 3, "b": true}', "{}"]


def test_windows_are_compared_on_the_stream(spark):
    rows = [("s", d, doc) for d, doc in enumerate(DAYS) if doc] + [("s", 3, '{"k": 2.5, "b": null}'), ("other", 0, '{"k": 1}'), ("other", 4, '{"q": 1}')]
    rows.sort(key=lambda r: r[1])
    folder = new_path(spark, "payloads")
    parts = [spark.createDataFrame([r], "src string, day int, doc string").selectExpr("src", "timestamp_seconds(day * 86400 + 5) ts", "doc") for r in rows]
    schema = _files(parts, folder)
    windows = batches.payload_windows(_stream(spark, schema, folder, 2), "src", "ts", "doc", "1 day", "1 hour")
    out = cdc_stream.run_to_table(batches.payload_drift(windows), new_path(spark, "o"), new_path(spark, "c"))
    day = lambda c: (F.unix_timestamp(c) / 86400).cast("int").alias(c)
    got = sorted(map(tuple, out.select("source_identifier", day("previous_start"), day("window_start"), "kind", "name", "column_before.data_type", "column_after.data_type").collect()), key=str)
    assert got == sorted(
        [
            ("s", 0, 1, "removed", "a", "numeric", None),
            ("s", 0, 1, "modified", "k", "bigint", "text"),
            ("s", 1, 3, "added", "b", None, "text"),
            ("s", 3, 4, "modified", "b", "text", "boolean"),
            ("s", 3, 4, "modified", "k", "text", "bigint"),
            ("other", 0, 4, "added", "q", None, "bigint"),
            ("other", 0, 4, "removed", "k", "bigint", None),
        ],
        key=str,
    )
    events = classify.classify_single(out, ["source_identifier", "window_start", "table_identifier"])
    assert {(r.identifier, r.change_type) for r in events.collect()} >= {("payload.a", "column_dropped"), ("payload.b", "nullability_tightened")}
