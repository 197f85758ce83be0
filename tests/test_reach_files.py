"""Reach by masks, numbers of wide keys, files read whole, key arrays."""

import random

from pyspark.sql import functions as F

from shiftlens.functions import interning
from shiftlens.functions.durable import new_path
from shiftlens.operators import classify, evaluate, graph, lineage
from shiftlens.sources import files


def _below(pairs, seed):
    seen, todo = set(), [seed]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {seed}


def test_counts_of_many_seeds_with_cycles_equal_naive(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(120)} | {("n0", "n0")})
    names = [f"n{i}" for i in range(90)]  # more seeds than a mask has bits
    edges = spark.createDataFrame([("p", a, b) for a, b in pairs] + [("p", None, "n1")], "project string, src string, dst string")
    seeds = spark.createDataFrame([("p", s) for s in [*names, "absent"]], "project string, seed string")
    kinds = ["model", "exposure", "source"]
    nodes = spark.createDataFrame([("p", n, kinds[i % 3]) for i, n in enumerate(names)], "project string, node_id string, kind string")
    wide = spark.createDataFrame([("p", "n4"), ("p", "n7")], "project string, node_id string")
    got = {r.seed: (r.models, r.exposures, r.wide) for r in lineage.impact_counts(seeds, nodes, edges, wide).collect()}
    want = {}
    for s in names:
        below = _below(pairs, s)
        n = [sum(kinds[int(x[1:]) % 3] == k for x in below) for k in ("model", "exposure")]
        if any(n):
            want[s] = (*n, bool(below & {"n4", "n7"}))
    assert got == want


def test_levels_of_a_graph_with_two_paths(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    rows = graph.levels(spark.createDataFrame([("lonely",)], "node string"), edges, ["node"], ["src"], ["dst"])
    assert {r.node: r.level for r in rows.collect()} == {"a": 0, "lonely": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None}


def test_numbers_that_meet_take_another_salt(spark, monkeypatch):
    keys = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "b")], "x string, y string")
    assert interning.differing_salt(keys) == 0
    plain = interning.number
    monkeypatch.setattr(interning, "number", lambda salt, *c: F.lit(7).cast("long") if salt == 0 else plain(salt, *c))
    assert interning.differing_salt(keys) == 1


def test_cards_of_lists_only(spark):
    texts = ['[{"id": 1, "name": "a", "dataset_query": {"native": {"query": "q"}}}, {"id": "x"}, 5]', '{"error": [1]}', '  []', "not json"]
    path = new_path(spark, "cards")
    spark.createDataFrame([(t,) for t in texts], "text string").write.option("maxRecordsPerFile", 1).text(path)
    assert sorted(map(tuple, files.read_cards(spark, path).collect()), key=str) == [("1", "a", "q"), ("x", None, None)]


def test_key_arrays_differ_in_members_and_order(spark):
    rows = [("s", 2, t, c, pk, part) for t, before, after in [
        ("order", (["a", "b"], ["d"]), (["b", "a"], ["d"])), ("same", (["a"], []), (["a"], [])), ("part", (["a"], ["d"]), (["a"], ["e"])), ("new", None, (["a"], ["d"])),
    ] for c, side in ((False, before), (True, after)) if side for pk, part in [side]]
    sides = spark.createDataFrame(rows, "source_identifier string, seq int, table_identifier string, is_curr boolean, primary_key array<string>, partition_keys array<string>")
    got = sorted((r.table_identifier, r.which, r.keys_before, r.keys_after) for r in classify.key_array_changes(sides).collect())
    assert got == [("order", "primary_key", ["a", "b"], ["b", "a"]), ("part", "partition_keys", ["d"], ["e"])]


def test_nothing_expected_and_nothing_predicted(spark):
    rows = [("m", None, None, None, None), ("m", None, None, "pk_changed", "high"), ("m", "pk_changed", "high", "pk_changed", "high")]
    results = spark.createDataFrame(rows, "method string, expected_change_type string, expected_severity string, predicted_change_type string, predicted_severity string")
    scores = evaluate.recall_precision(results).first()
    assert (scores.total, scores.detected, scores.correct) == (3, 2, 2)
    assert {(r.expected, r.predicted): r.n for r in evaluate.confusion(results).collect()} == {
        ("<none>", "<none>"): 1, ("<none>", "pk_changed"): 1, ("pk_changed", "pk_changed"): 1,
    }
