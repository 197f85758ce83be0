"""Closure and levels against naive Python, lineage on the sample project."""

import random

from pyspark.sql import functions as F

from shiftlens.operators import column_lineage as cl
from shiftlens.operators import graph, lineage
from shiftlens.sources import files


def _edges(spark, pairs):
    return spark.createDataFrame([("p", a, b) for a, b in pairs], "project string, src string, dst string")


def _naive(pairs, seed):
    seen, todo = set(), [seed]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {seed}


def test_closure_with_cycles_equals_naive(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)}
    seeds = [f"n{i}" for i in range(25)]
    df = spark.createDataFrame([("p", s) for s in seeds], "project string, seed string")
    got = {s: set() for s in seeds}
    for r in lineage.node_closure(df, _edges(spark, pairs)).collect():
        got[r.seed].add(r.node_id)
    assert got == {s: _naive(pairs, s) for s in seeds}


def test_levels_and_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")]
    nodes = spark.createDataFrame([("p", "lonely")], "project string, node_id string")
    rows = graph.levels(nodes, _edges(spark, pairs), ["project", "node_id"], ["project", "src"], ["project", "dst"])
    assert {r.node_id: r.level for r in rows.collect()} == {
        "a": 0, "lonely": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None,
    }


MANIFEST = """{"sources": {
  "source.d.raw.orders": {"name": "orders", "identifier": "orders", "schema": "raw", "columns": {"id": {}, "customer_id": {}, "amount": {}}},
  "source.d.raw.customers": {"name": "customers", "schema": "raw", "columns": {"customer_id": {}, "email": {}}}},
 "nodes": {
  "model.d.stg_orders": {"resource_type": "model", "name": "stg_orders", "depends_on": {"nodes": ["source.d.raw.orders"]}},
  "model.d.stg_customers": {"resource_type": "model", "name": "stg_customers", "depends_on": {"nodes": ["source.d.raw.customers"]}},
  "model.d.fct_orders": {"resource_type": "model", "name": "fct_orders", "depends_on": {"nodes": ["model.d.stg_orders", "model.d.stg_customers"]}},
  "model.d.mart_daily": {"resource_type": "model", "name": "mart_daily", "depends_on": {"nodes": ["model.d.fct_orders"]}},
  "model.d.mart_union": {"resource_type": "model", "name": "mart_union", "depends_on": {"nodes": ["model.d.stg_orders", "model.d.fct_orders"]}},
  "model.d.broken": {"resource_type": "model", "name": "broken", "depends_on": {"nodes": ["source.d.raw.customers"]}},
  "model.d.below": {"resource_type": "model", "name": "below", "depends_on": {"nodes": ["model.d.broken"]}}},
 "exposures": {"exposure.d.board": {"name": "board", "depends_on": {"nodes": ["model.d.mart_daily"]}}}}"""

SCOPES = [  # node, scope, leg, alias, alias_pos, table_name
    ("stg_orders", "main", 0, "orders", 0, "raw.orders"),
    ("stg_customers", "main", 0, "customers", 0, "raw.customers"),
    ("fct_orders", "paid", 0, "o", 0, "analytics.stg_orders"),
    ("fct_orders", "main", 0, "paid", 0, "paid"),
    ("fct_orders", "main", 0, "c", 1, "analytics.stg_customers"),
    ("mart_daily", "main", 0, "fct_orders", 0, "analytics.fct_orders"),
    ("mart_union", "main", 0, "a", 0, "stg_orders"),
    ("mart_union", "main", 1, "b", 0, "fct_orders"),
    ("below", "main", 0, "x", 0, "broken"),
]
PROJECTIONS = [  # node, scope, leg, pos, out_name, ref_alias, ref_col, is_star
    ("stg_orders", "main", 0, 0, "id", None, "id", False),
    ("stg_orders", "main", 0, 1, "customer_id", None, "customer_id", False),
    ("stg_orders", "main", 0, 2, "amount", None, "amount", False),
    ("stg_customers", "main", 0, 0, None, None, None, True),
    ("fct_orders", "paid", 0, 0, None, "o", None, True),
    ("fct_orders", "main", 0, 0, "amount", None, "amount", False),
    ("fct_orders", "main", 0, 1, "email", "c", "email", False),
    ("mart_daily", "main", 0, 0, None, None, None, True),
    ("mart_union", "main", 0, 0, "metric", "a", "amount", False),
    ("mart_union", "main", 1, 0, "other", "b", "email", False),
    ("below", "main", 0, 0, "y", "x", "anything", False),
]


def _project(spark):
    entries = files.manifest_entries(spark.createDataFrame([("d", MANIFEST)], "project string, text string"))
    nodes, edges, columns = files.lineage_nodes(entries), files.lineage_edges(entries), files.source_columns(entries)
    full = lambda rows: [("d", f"model.d.{r[0]}", *r[1:]) for r in rows]
    scopes = spark.createDataFrame(full(SCOPES), "project string, node string, scope string, leg int, alias string, alias_pos int, table_name string")
    projections = spark.createDataFrame(
        full(PROJECTIONS),
        "project string, node string, scope string, leg int, pos int, out_name string, ref_alias string, ref_col string, is_star boolean",
    )
    return nodes, edges, columns, scopes, projections


def test_impact_of_a_source(spark):
    nodes, edges, *_ = _project(spark)
    asked = spark.createDataFrame([("d", "raw.orders.amount"), ("d", "nowhere.nope.x")], "project string, source_identifier string")
    located = lineage.find_sources(asked, nodes)
    closure = lineage.node_closure(located.where(F.col("node_id").isNotNull()).select("project", F.col("node_id").alias("seed")), edges)
    rows = {r.source_identifier: r for r in lineage.impact_summary(located, lineage.impact_nodes(closure, nodes)).collect()}
    assert rows["raw.orders.amount"].models == 4 and rows["raw.orders.amount"].exposures == 1
    assert rows["raw.orders.amount"].blast_radius_score == 7.0 and rows["raw.orders.amount"].lineage_confidence == "high"
    assert rows["nowhere.nope.x"].models == 0 and rows["nowhere.nope.x"].lineage_confidence == "low"


def test_column_lineage_of_the_sample_project(spark):
    nodes, edges, columns, scopes, projections = _project(spark)
    found = cl.column_lineage(nodes, edges, scopes, projections, columns)
    assert {r.node_id for r in found.fan_out.collect()} == {"model.d.broken"}
    ask = spark.createDataFrame(
        [("d", "source.d.raw.orders", "amount"), ("d", "source.d.raw.customers", "email"), ("d", "source.d.raw.orders", "never")],
        "project string, seed string, seed_column string",
    )
    out = {}
    for r in lineage.impact_columns(ask, nodes, edges, found.column_edges, columns, found.model_columns, found.fan_out).collect():
        out.setdefault((r.seed.split(".")[-1], r.seed_column), set()).add((r.name, r.column))
    # The CTE's column wins over the other table in scope, the star model keeps both columns.
    assert out["orders", "amount"] == {
        ("stg_orders", "amount"), ("fct_orders", "amount"), ("mart_daily", "amount"), ("mart_union", "metric"),
    }
    # An unresolved model below the source widens to every column beneath it.
    assert out["customers", "email"] == {
        ("stg_customers", "email"), ("fct_orders", "email"), ("mart_daily", "email"), ("mart_union", "metric"), ("below", "y"),
    }
    assert ("stg_orders", "id") in out["orders", "never"] and ("mart_union", "metric") in out["orders", "never"]
    known = lineage.column_nodes(columns, found.model_columns, found.column_edges)
    assert lineage.graph_violations(nodes, edges, known, found.column_edges).isEmpty()
