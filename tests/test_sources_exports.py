"""Sources, exports, policy and streams on small fixtures."""

import json

from pyspark.sql import functions as F

from shiftlens.functions.durable import new_path
from shiftlens.operators import cdc_changes, dashboards, evaluate, exports, limiter, policy
from shiftlens.sources import cdc, files
from shiftlens.streaming import batches
from shiftlens.streaming import cdc as cdc_stream

A = '{"fields":[{"name":"id","type":"int"},{"name":"amount","type":{"type":"bytes","logicalType":"decimal","precision":10,"scale":2}}]}'
B = '{"fields":[{"name":"id","type":"int"},{"name":"amount","type":{"scale":2,"type":"bytes","precision":10,"logicalType":"decimal"}},{"name":"email","type":["null","string"]}]}'
A_OTHER_ORDER = '{"fields":[{"type":"int","name":"id"},{"name":"amount","type":{"logicalType":"decimal","type":"bytes","precision":10,"scale":2}}]}'
MESSAGES = "topic string, offset long, value string"
TOPIC = "dbserver1.public.orders"


def _messages(spark, values):
    return spark.createDataFrame([(TOPIC, i, v) for i, v in enumerate(values)], MESSAGES)


def test_decode_and_types(spark):
    values = [A, None, '{"schema":{}}', '{"x":1}', '{"schema":%s}' % B, "not json"]
    rows = cdc.avro_columns(cdc.decode(_messages(spark, values)), "dbserver1.").collect()
    got = {(r.offset, r.name): (r.table_identifier, r.data_type, r.nullable, r.ordinal_position) for r in rows}
    assert got == {
        (0, "id"): ("public.orders", "integer", False, 0),
        (0, "amount"): ("public.orders", "numeric(10,2)", False, 1),
        (4, "id"): ("public.orders", "integer", False, 0),
        (4, "amount"): ("public.orders", "numeric(10,2)", False, 1),
        (4, "email"): ("public.orders", "text", True, 2),
    }


def test_field_type_edges(spark):
    types = ['"long"', '["string","null"]', '["null"]', '[{"type":"int","logicalType":"date"},"null"]', '{"type":"long","logicalType":"timestamp-micros"}', '{"type":"array","items":"int"}', '{"type":"bytes","logicalType":"decimal"}']
    value = '{"fields":[%s]}' % ",".join('{"name":"c%d","type":%s}' % (i, t) for i, t in enumerate(types))
    rows = cdc.avro_columns(cdc.decode(_messages(spark, [value]))).orderBy("ordinal_position").collect()
    assert [(r.data_type, r.nullable) for r in rows] == [
        ("bigint", False), ("text", True), ("text", True), ("date", True), ("timestamp", False), ("text", False), ("numeric(38,0)", False),
    ]


def test_repeated_schema_is_one_change_and_return_is_another(spark):
    marked = cdc_changes.mark_changes(cdc.decode(_messages(spark, [A, A_OTHER_ORDER, B, A])), chunk=2)
    assert [r.is_change for r in marked.orderBy("offset").collect()] == [True, False, True, True]
    events = cdc_changes.change_events(marked, "dbserver1.").orderBy("offset").collect()
    assert [(e.offset, e.identifier, e.change_type) for e in events] == [
        (2, "public.orders.email", "column_added_nullable"),
        (3, "public.orders.email", "column_dropped"),
    ]


def test_stream_equals_batch_over_many_batches_and_priming(spark):
    folder = new_path(spark, "messages")
    values = [A, A, B, A_OTHER_ORDER, None, B, B]
    for i, v in enumerate(values):
        spark.createDataFrame([(TOPIC, i, v)], MESSAGES).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 3).parquet(folder)
    out = cdc_stream.run_to_table(cdc_stream.marked_stream(read()), new_path(spark, "o"), new_path(spark, "c"))
    want = cdc_changes.mark_changes(cdc.decode(_messages(spark, values))).select("offset", "is_change")
    assert out.select("offset", "is_change").exceptAll(want).isEmpty() and out.count() == 6
    primed = spark.createDataFrame([(TOPIC, A)], "topic string, record_schema string")
    out = cdc_stream.run_to_table(cdc_stream.marked_stream(read(), primed), new_path(spark, "o"), new_path(spark, "c"))
    assert [r.is_change for r in out.orderBy("offset").collect()] == [False, False, True, True, True, False]


def test_limiter_stream_equals_batch(spark):
    folder = new_path(spark, "limited")
    rows = [(i, i * 7 % 40 + (i // 20) * 50, "a" if i % 3 else "b", i % 4 != 0) for i in range(60)]
    schema = "event_id long, s long, team string, takes boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).selectExpr(
            "event_id", "timestamp_seconds(s) detected_at", "team", "takes"
        ).coalesce(1).write.mode("append").parquet(folder)
    table = spark.read.parquet(folder)
    want, _ = limiter.rate_limit(table, "takes", scope="team", max_events=2, window_seconds=30)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    judged = new_path(spark, "judged")
    step = batches.limiter_step(new_path(spark, "passed"), judged, "takes", scope="team", max_events=2, window_seconds=30)
    batches.run_batches(stream, step, new_path(spark, "progress"))
    got = spark.read.parquet(judged).select("event_id", "rate_limited")
    assert got.count() == 60 and got.exceptAll(want.select("event_id", "rate_limited")).isEmpty()


def test_polling_over_many_batches_equals_one_history(spark):
    from shiftlens.operators import classify, diff, snapshots

    from test_changes import SPEC, spec

    folder = new_path(spark, "arrivals")
    schema = f"source_identifier string, snapshot_id string, captured_at timestamp, table_identifier string, {SPEC}"
    days = [{"a": "integer"}, {"a": "bigint", "b": "text"}, {"b": "text"}, {"b": "text"}, {"b": "integer", "a": "integer"}]
    for day, columns in enumerate(days):
        rows = [("s", f"s@{day}", None, "t", *spec(n, ty)) for n, ty in columns.items()]
        df = spark.createDataFrame(rows, schema).withColumn("captured_at", F.timestamp_seconds(F.lit(day * 86400)))
        df.coalesce(1).write.mode("append").parquet(folder)
        if day == 2:
            df.coalesce(1).write.mode("append").parquet(folder)  # the same snapshot arrives twice
    table = spark.read.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    events = new_path(spark, "polled")
    batches.run_batches(stream, batches.polling_step(new_path(spark, "store"), events), new_path(spark, "progress"))
    got = sorted((r.snapshot_id, r.identifier, r.change_type) for r in spark.read.parquet(events).collect())
    once = table.distinct()
    headers = snapshots.sequence(once.select("source_identifier", "snapshot_id", "captured_at").distinct())
    raw = diff.history_diff(headers, once, once.drop("captured_at"))
    want = classify.classify_single(raw).join(headers, ["source_identifier", "seq"])
    assert got == sorted((r.snapshot_id, r.identifier, r.change_type) for r in want.collect())
    assert got and got[0] == ("s@1", "t.a", "type_widened")


def test_policy_gates(spark):
    rows = [
        ("column_added_nullable", "low", 0.0, 0), ("column_added_nullable", "low", 3.0, 2), ("default_changed", "medium", 99.0, 9),
        ("default_changed", "medium", 25.0, 9), ("column_dropped", "high", 99.0, 9), ("column_renamed", "high", 0.0, 0), ("type_widened", "low", 26.0, 3),
    ]
    df = spark.createDataFrame(rows, "change_type string, severity string, blast_radius_score double, models int").withColumn(
        "fan_out_conservative", F.lit(False)
    )
    out = [(r.action, r.labels[2:]) for r in policy.decide(df, policy.has_impact("models")).collect()]
    assert out == [
        ("alert_only", []), ("open_pr", []), ("open_draft_pr", ["requires-human", "large-blast"]), ("open_pr", []),
        ("open_draft_pr", ["requires-human", "destructive"]), ("open_draft_pr", ["requires-human"]), ("open_draft_pr", ["requires-human", "large-blast"]),
    ]


def test_one_run_event_and_every_output(spark):
    events = spark.sql(
        "select 'e' event_id, timestamp '2024-01-01 00:00:00' detected_at, 'raw.t.c' identifier, 'column_dropped' change_type, 'high' severity, "
        "1.0D confidence, 7.0D blast_radius_score, false fan_out_conservative, named_struct('name', 'c', 'data_type', 'text') column_before, "
        "cast(null as struct<name:string,data_type:string>) column_after"
    )
    models = spark.sql("select 'e' event_id, concat('m', lpad(id, 3, '0')) model from range(25)")
    (event,) = exports.run_events(events, producer="p", namespace="n", drift_facet="f").collect()
    outputs = exports.run_event_outputs(models, "n").orderBy("name").collect()
    assert [tuple(o) for o in outputs] == [("e", "n", f"m{i:03d}") for i in range(25)]
    first = json.loads(event.payload)
    assert first["eventType"] == "COMPLETE" and "parent" not in first["run"]["facets"]
    assert first["inputs"][0]["facets"]["schema"]["fields"] == [{"name": "c", "type": "text"}]


def test_audit_lines_are_appended(spark):
    path = new_path(spark, "audit")
    rows = spark.sql("select timestamp '2024-01-01 00:00:00' detected_at, 'x' id, 1 n")
    for _ in range(2):
        exports.append_audit(exports.audit_rows(rows, "actor", "seen", "id", ["n"]), path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert lines == [{"action": "seen", "actor": "actor", "occurred_at": "2024-01-01T00:00:00.000000Z", "payload": {"n": 1}, "target": "x"}] * 2


def test_dashboard_refs(spark):
    sql = 'select * from a.b.Orders o join "x"."stg_c" on 1=1 FROM (SELECT 1) left join orders, z'
    got = spark.createDataFrame([(sql,), (None,), ("",)], "sql string").select(dashboards.table_refs(F.col("sql")).alias("r")).collect()
    assert got[0].r == ["orders", "stg_c"] and not got[1].r and got[2].r == []


def test_scenario_files_round_trip_and_scores(spark, tmp_path):
    col = {"name": "a", "data_type": "integer", "nullable": True, "is_primary_key": False, "ordinal_position": 1}
    for i, (kind, expected) in enumerate([("added", "column_added_nullable"), ("removed", "column_dropped")]):
        doc = {
            "scenario_id": f"s{i}", "table": "t", "expected_change_type": expected, "expected_severity": "low" if kind == "added" else "high",
            "raw_changes": [{"table_identifier": "t", "kind": kind, "column_before": None if kind == "added" else col, "column_after": col if kind == "added" else None}],
        }
        (tmp_path / f"s{i}.json").write_text(json.dumps(doc, indent=1))
    scenarios = files.read_scenarios(spark, str(tmp_path))
    changes = files.scenario_changes(scenarios)
    expected = scenarios.select("scenario_id", "expected_change_type", "expected_severity")
    results = evaluate.rule_method(expected, changes).withColumn("method", F.lit("rule")).unionByName(
        evaluate.value_test_baseline(expected, changes).withColumn("method", F.lit("value"))
    )
    rows = {r.method: r for r in evaluate.compare_methods(results).collect()}
    assert rows["rule"].classification_recall == 1.0 and rows["rule"].severity_macro_f1 == 1.0
    assert rows["value"].drift_recall == 0.5 and rows["value"].classification_recall == 0.0


def test_hold_out_formula(spark):
    import hashlib

    ids = [f"id{i}" for i in range(50)]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", evaluate.held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (int(hashlib.sha256(r.i.encode()).hexdigest()[:8], 16) % 10 in (7, 8, 9)) for r in got)


def test_lake_footers(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.sql("select 1 a, 'x' b, timestamp '2024-01-01 00:00:00' c").coalesce(1).write.parquet(path)
    rows = files.lake_columns(spark, str(tmp_path)).orderBy("ordinal_position").collect()
    assert [(r.table_identifier, r.name, r.data_type) for r in rows] == [
        ("orders", "a", "integer"), ("orders", "b", "text"), ("orders", "c", "timestamp"),
    ]
