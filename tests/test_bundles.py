"""Documents kept many to a file."""

import os

from shiftlens.operators import evaluate
from shiftlens.plans import derive, source_queries as q
from shiftlens.sources import files


def test_many_documents_take_few_files_and_come_back_whole(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q, "new_path", lambda s, label: str(tmp_path / label))
    texts = [f'[{{"id": {i},\n "name": "é\\n{i}"}}]' for i in range(300)]
    docs = spark.createDataFrame([(t, f"p{i}") for i, t in enumerate(texts)], "text string, project string")
    back = q.stored_documents(docs, "cards", "project")
    assert sorted(map(tuple, back.collect())) == sorted((t, f"p{i}") for i, t in enumerate(texts))
    assert sum(n.endswith(".json") for n in os.listdir(tmp_path / "cards")) <= 32
    assert sorted(int(r.id) for r in files.cards_of(back).collect()) == list(range(300))


def test_entries_of_a_manifest_without_a_section(spark):
    text = '{"nodes": {"b": {"name": "B"}, "a": {"depends_on": {"nodes": ["b", "s"]}}}, "exposures": {"e": {}}}'
    rows = files.manifest_entries(spark.createDataFrame([("p", text), ("q", "{}")], "project string, text string"))
    assert sorted((r.project, r.section, r.ord, r.node_id) for r in rows.collect()) == [("p", "exposures", 0, "e"), ("p", "nodes", 0, "b"), ("p", "nodes", 1, "a")]
    assert sorted((r.src, r.dst, r.pos) for r in files.lineage_edges(rows).collect()) == [("b", "a", 0), ("s", "a", 1)]


def test_all_methods_are_the_three_methods_and_the_diff_runs_once(spark, monkeypatch):
    runs, inner = [], derive.cut
    monkeypatch.setattr(derive, "cut", lambda *a: runs.append(1) or inner(*a))
    expected, changes = derive.scenarios(spark, "/root/testdata/sf0.001")
    assert len(runs) == 1 and all("scenario-changes" in f for f in changes.inputFiles())
    expected = expected.unionByName(expected.limit(3)).unionByName(spark.sql("select 'other' scenario_id, null expected_change_type, 'low' expected_severity"))
    expected = inner(expected.unionByName(expected.limit(0)))
    separate = [
        f(expected, changes).selectExpr("*", f"'{name}' method")
        for name, f in (("rule", evaluate.rule_method), ("value_test", evaluate.value_test_baseline), ("model_test", evaluate.model_test_baseline))
    ]
    want = sorted((tuple(r) for df in separate for r in df.collect()), key=str)
    assert sorted(map(tuple, evaluate.all_methods(expected, changes).collect()), key=str) == want
