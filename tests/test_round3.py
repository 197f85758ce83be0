"""Findings of the third review: lookups of repeated rows, tables of several files."""

from shiftlens.functions import durable
from shiftlens.operators import column_lineage, lineage, snapshots
from shiftlens.plans import change_queries, source_queries


def test_last_of_repeated_rows_is_looked_up(spark):
    rows = spark.createDataFrame(
        [("s", "a", "t", 3, "k", "text", 1), ("s", "a", "t", 3, "k", "bigint", 0), ("s", "b", "t", 3, "k", "bigint", 5), ("s", "b", "u", 3, "k", "date", 9)],
        "source_identifier string, snapshot_id string, table_identifier string, ordinal_position int, name string, data_type string, position int",
    )
    found = snapshots.column_lookup(rows, "t", "k", "position").collect()
    assert {(r.snapshot_id, r.data_type) for r in found} == {("a", "text"), ("b", "bigint")} and len(found) == 2


def test_files_of_one_table_are_one_schema(spark, tmp_path):
    spark.range(4).selectExpr("id a", "'x' b").repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1).selectExpr("id a").coalesce(1).write.parquet(str(tmp_path / "plain"))
    rows = source_queries.lake_schema(spark, str(tmp_path)).collect()
    assert sorted((r.table_identifier, r.name, r.ordinal_position) for r in rows) == [("orders", "a", 0), ("orders", "b", 1), ("plain", "a", 0)]


def _project(spark, scopes, items, deps, columns, models):
    table = lambda rows, schema: spark.createDataFrame([("p", *r) for r in rows], "project string, " + schema)
    return column_lineage.column_lineage(
        table([(m, "model") for m in models], "node_id string, kind string"),
        table(deps, "src string, dst string, pos int"),
        table(scopes, "node string, scope string, leg int, alias string, alias_pos int, table_name string"),
        table(items, "node string, scope string, leg int, pos int, out_name string, ref_alias string, ref_col string, is_star boolean"),
        table(columns, "node_id string, pos int, column string"),
    )


def test_stars_between_models_wait_for_main_scopes_only_and_little_is_written(spark, monkeypatch):
    written, plain = [], durable.new_path
    monkeypatch.setattr(durable, "new_path", lambda s, label: written.append(label) or plain(s, label))
    found = _project(
        spark,
        [("a", "main", 0, "s", 0, "raw.s"), ("a", "q", 0, "b", 0, "b"), ("b", "main", 0, "a", 0, "x.a"), ("c", "main", 0, "q", 0, "q"), ("c", "q", 0, "r", 0, "r"), ("c", "r", 0, "s", 0, "raw.s")],
        [("a", "main", 0, 0, "x", None, "x", False), ("a", "q", 0, 0, None, None, None, True), ("b", "main", 0, 0, None, "a", None, True), ("b", "main", 0, 1, "y", "a", "x", False),
         ("c", "main", 0, 0, None, None, None, True), ("c", "q", 0, 0, None, "r", None, True), ("c", "r", 0, 0, None, "s", None, True)],
        [("source.s", "a", 0), ("b", "a", 1), ("a", "b", 0), ("source.s", "c", 0)],
        [("source.s", 0, "x"), ("source.s", 1, "z")],
        ["a", "b", "c", "d"],
    )
    edges = {(r.src_node, r.src_col, r.dst_node, r.dst_col) for r in found.column_edges.collect()}
    assert edges == {("source.s", "x", "a", "x"), ("a", "x", "b", "x"), ("a", "x", "b", "y"), ("source.s", "x", "c", "x"), ("source.s", "z", "c", "z")}
    columns = {(r.node_id, r.pos, r.column) for r in found.model_columns.collect()}
    assert columns == {("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("c", 2, "z")}
    assert [r.node_id for r in found.fan_out.collect()] == ["d"]
    assert len(written) < 20


def test_rounds_of_reach_do_not_move_the_links(spark):
    edges = spark.range(2000).selectExpr("'p' project", "concat('a', id) src", "concat('a', id + 1) dst").union(spark.sql("select 'p', 'a1', 'a2'"))
    graph = lineage.node_graph(edges)
    front = spark.range(3).selectExpr("id", "0L batch", "1L mask")
    joined = front.hint("merge").join(graph.links, front["id"] == graph.links["src"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert graph.links.count() == 2000 and graph.names().count() == 2001


def test_changes_are_computed_once_before_they_are_ranked(spark):
    plan = change_queries.ordered_changes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan
