"""Cases that once gave a wrong answer: shadowed names, lenient messages, other time zones, deep chains."""

import json

from shiftlens.functions import types
from shiftlens.functions.durable import new_path
from shiftlens.operators import column_lineage, dashboards, exports, graph, store
from shiftlens.sources import cdc
from shiftlens.streaming import batches
from pyspark.sql import functions as F


def test_cte_named_like_its_source_hides_it_outside_its_body(spark):
    scopes = spark.createDataFrame(
        [("p", "m", "orders", 0, "orders", 0, "raw.orders"), ("p", "m", "main", 0, "orders", 0, "orders")],
        "project string, node string, scope string, leg int, alias string, alias_pos int, table_name string",
    )
    edges = spark.createDataFrame([("p", "source.raw.orders", "m", 0)], "project string, src string, dst string, pos int")
    found = {r.scope: (r.rel_node, r.rel_scope) for r in column_lineage.resolve_tables(scopes, edges).collect()}
    assert found == {"orders": ("source.raw.orders", "main"), "main": ("m", "orders")}


def test_lenient_message_does_not_end_the_job(spark):
    df = spark.createDataFrame([("{'fields': []}",), ('{"b":1,"a":2}',), ('{"a":2,"b":1}',)], "s string")
    out = [r.c for r in df.select(cdc.canonical_schema(F.col("s")).alias("c")).collect()]
    assert out[0] == "{'fields': []}" and out[1] == out[2]


def test_audit_time_is_utc_in_any_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("select timestamp '2024-01-01 00:00:00Z' detected_at, 'x' id, 1 n")
        assert exports.audit_rows(rows, "a", "seen", "id", ["n"]).first().occurred_at == "2024-01-01T00:00:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_closure_of_a_deep_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 10)], "s int, d int")
    seeds = spark.createDataFrame([(0, 0)], "id int, v int")
    found = graph.reachable(seeds, edges, ["id"], ["v"], ["s"], ["d"])
    assert sorted(r.v for r in found.collect()) == list(range(1, 13))


def test_type_names_lose_all_white_space_around_them(spark):
    assert spark.sql("select '\t VARCHAR(10)\n' t").select(types.type_family(F.col("t")).alias("f")).first().f == "varchar"


def test_dashboards_stay_in_their_project(spark):
    refs = spark.createDataFrame([("a", "m", "t", "1", "n", "normal", None), ("b", "m", "t", "2", "n", "normal", None)], "project string, model string, tool string, id string, name string, tier string, url string")
    impacted = spark.createDataFrame([("a", "s", "model", "m")], "project string, seed string, kind string, name string")
    assert [r.id for r in dashboards.impact_dashboards(impacted, refs).collect()] == ["1"]


def test_table_names_of_a_long_query(spark):
    sql = " ".join(f"FROM t{i} JOIN s.{chr(34)}u{i}{chr(34)}," for i in range(400))
    names = spark.createDataFrame([(sql,)], "q string").select(dashboards.table_refs(F.col("q")).alias("r")).first().r
    assert names == [x for i in range(400) for x in (f"t{i}", f"u{i}")] and json.dumps(names)


def test_columns_of_a_stored_snapshot_are_not_appended_again(spark):
    held, keys = store.SnapshotStore(spark, new_path(spark, "columns")), "snapshot_id string, source_identifier string, name string"
    headers = lambda ids: spark.createDataFrame([(i, i[0], 1) for i in ids], "snapshot_id string, source_identifier string, captured_at long")
    first = spark.createDataFrame([("a@1", "a", "x"), ("a@1", "a", "y")], keys)
    held.append(headers(["a@1"]), first)
    held.append(headers(["a@1", "b@1"]), spark.createDataFrame([("a@1", "a", "x"), ("b@1", "b", "z")], keys))
    assert sorted((r.source_identifier, r.name) for r in held.columns(first.schema).collect()) == [("a", "x"), ("a", "y"), ("b", "z")]


def test_a_new_checkpoint_keeps_what_the_store_holds(spark):
    folder, passed, judged = (new_path(spark, n) for n in ("limited", "passed", "judged"))
    schema = "event_id long, s long, takes boolean"
    step = batches.limiter_step(passed, judged, "takes", max_events=2, window_seconds=30)
    for start in (0, 10):  # two streams, each with a checkpoint and a folder of its own
        here = f"{folder}/{start}"
        rows = [(start + i, start + i, True) for i in range(3)]
        spark.createDataFrame(rows, schema).selectExpr("event_id", "timestamp_seconds(s) detected_at", "takes").write.parquet(here)
        batches.run_batches(spark.readStream.schema(spark.read.parquet(here).schema).parquet(here), step, new_path(spark, "progress"))
    got = {r.event_id: r.rate_limited for r in spark.read.parquet(judged).collect()}
    assert got == {0: False, 1: False, 2: True, 10: True, 11: True, 12: True}


def test_an_empty_json_key_is_a_column(spark):
    rows = spark.createDataFrame([("s", 0, '{"": 1, "a": 2}'), ("s", 1, '{"a": 2}')], "src string, t long, doc string")
    timed = rows.selectExpr("src", "timestamp_seconds(t) ts", "doc")
    found = batches.window_columns(batches.payload_windows(timed, "src", "ts", "doc", "1 day", "1 hour")).collect()
    assert sorted((r.name, r.nullable, r.payloads) for r in found) == [("", True, 2), ("a", False, 2)]
