"""Diff, classification and rename matching against straightforward Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from shiftlens.functions.types import type_family
from shiftlens.operators import classify, diff, snapshots
from shiftlens.schemas import COLUMN_SPEC, DESTRUCTIVE, SEVERITY
from shiftlens.sources import contract
from pyspark.sql import functions as F

SPEC = "name string, data_type string, nullable boolean, default string, is_primary_key boolean, ordinal_position int, " \
    "character_max_length int, numeric_precision int, numeric_scale int, enum_values array<string>"
RAW = f"source_identifier string, seq long, table_identifier string, kind string, name string, column_before struct<{SPEC}>, column_after struct<{SPEC}>"


def spec(name="c", data_type="integer", nullable=True, default=None, pk=False, pos=1, length=None, precision=None, scale=None, enum=None):
    return (name, data_type, nullable, default, pk, pos, length, precision, scale, enum)


def change(kind, before=None, after=None, table="s.t", seq=2):
    return ("src", seq, table, kind, (after or before)[0], before, after)


CASES = [
    (spec(), spec(pk=True, nullable=False), "pk_changed"),
    (spec(), spec(nullable=False, data_type="text"), "nullability_tightened"),
    (spec(enum=["a"]), spec(enum=["a", "b"]), "enum_value_added"),
    (spec(enum=["a", "b"]), spec(enum=["b", "a"]), None),
    (spec(enum=["a", "b"]), spec(enum=["a"]), None),
    (spec(enum=None), spec(enum=["a"]), None),
    (spec(data_type="smallint"), spec(data_type="bigint"), "type_widened"),
    (spec(data_type="bigint"), spec(data_type="integer"), "type_narrowed"),
    (spec(data_type="int4"), spec(data_type="int8"), "type_incompatible"),
    (spec(data_type="varchar(10)", length=10), spec(data_type="varchar(20)", length=20), "type_widened"),
    (spec(data_type="varchar(20)", length=20), spec(data_type="varchar(10)", length=10), "type_narrowed"),
    (spec(data_type="numeric(10,2)"), spec(data_type="numeric(12,2)"), None),
    (spec(data_type="numeric", precision=10), spec(data_type="numeric", precision=12), "precision_changed"),
    (spec(data_type="numeric", precision=None), spec(data_type="numeric", precision=12), "precision_changed"),
    (spec(default=None), spec(default="0"), "default_changed"),
    (spec(nullable=False), spec(nullable=True), None),
    (spec(pos=1), spec(pos=2), None),
]


def test_modified_rules(spark):
    rows = [("src", i, "s.t", "modified", "c", b, a) for i, (b, a, _) in enumerate(CASES)]
    got = {r.seq: r.change_type for r in classify.classify_single(spark.createDataFrame(rows, RAW)).collect()}
    assert [got.get(i) for i in range(len(CASES))] == [c[2] for c in CASES]


def test_added_and_removed_rules(spark):
    rows = [
        change("added", after=spec("a")),
        change("added", after=spec("b", nullable=False, default="0")),
        change("added", after=spec("d", nullable=False)),
        change("removed", before=spec("e")),
    ]
    events = classify.classify_single(spark.createDataFrame(rows, RAW)).orderBy("identifier").collect()
    assert [(e.identifier, e.change_type, e.severity, e.requires_backfill, e.destructive) for e in events] == [
        ("s.t.a", "column_added_nullable", "low", False, False),
        ("s.t.b", "column_added_not_null", "low", True, False),
        ("s.t.d", "column_added_not_null_no_default", "medium", True, False),
        ("s.t.e", "column_dropped", "high", False, True),
    ]


def test_family_strips_only_a_trailing_parameter(spark):
    texts = ["VARCHAR(10)", " numeric (10,2) ", "timestamp(6) without time zone", "text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(type_family(F.col("t"))).collect()]
    assert got == ["varchar", "numeric", "timestamp(6) without time zone", "text"]


def _greedy(changes):
    """Each removed column takes the first unused added one of its family, in order."""
    fam = lambda c: c[1].split("(")[0]
    removed = [c for c in changes if c[0] == "removed"]
    added = [c for c in changes if c[0] == "added"]
    used, pairs = set(), set()
    for r in removed:
        hit = next((i for i, a in enumerate(added) if i not in used and fam(a) == fam(r)), None)
        if hit is None:
            pairs.add((r[2], None))
        else:
            used.add(hit)
            pairs.add((r[2], added[hit][2]))
    return pairs | {(None, a[2]) for i, a in enumerate(added) if i not in used}


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.sampled_from([2, 10**6]))
def test_rename_pairs_equal_greedy_matching(spark, seed, hot_rows):
    rng = random.Random(seed)
    tables, rows = {}, []
    for t in range(30):
        names = rng.sample(range(1000), 12)
        changes = sorted(
            (rng.choice(["added", "removed"]), rng.choice(["integer", "text", "varchar(5)", "varchar(9)"]), f"n{n:04d}") for n in names
        )
        changes.sort(key=lambda c: c[2])
        tables[f"t{t}"] = _greedy(changes)
        for kind, ty, name in changes:
            s = spec(name, ty)
            rows.append(change(kind, s if kind == "removed" else None, s if kind == "added" else None, f"t{t}"))
    pairs = classify.rename_pairs(spark.createDataFrame(rows, RAW), hot_rows=hot_rows, pieces=3).collect()
    got = {}
    for p in pairs:
        b, a = p.column_before, p.column_after
        got.setdefault(p.table_identifier, set()).add((b and b.name, a and a.name))
    assert got == tables


def test_rename_event_note_and_kinds(spark):
    rows = [change("removed", before=spec("a")), change("added", after=spec("z"))]
    event = classify.classify_batch(spark.createDataFrame(rows, RAW)).collect()
    assert len(event) == 1
    assert event[0].change_type == "column_renamed" and event[0].severity == "high"
    assert event[0].notes == ["renamed from 'a' → 'z'"] and event[0].raw_kinds == ["removed", "added"]
    assert event[0].identifier == "s.t.z"


def _pairwise(history):
    out = set()
    for src, snaps in history.items():
        for k in range(1, len(snaps)):
            prev, curr = snaps[k - 1], snaps[k]
            for t in curr.keys() - prev.keys():
                out.add((src, k + 1, t, "table_added", None))
            for t in prev.keys() - curr.keys():
                out.add((src, k + 1, t, "table_removed", None))
            for t in prev.keys() & curr.keys():
                p, c = prev[t], curr[t]
                out |= {(src, k + 1, t, "added", n) for n in c.keys() - p.keys()}
                out |= {(src, k + 1, t, "removed", n) for n in p.keys() - c.keys()}
                out |= {(src, k + 1, t, "modified", n) for n in p.keys() & c.keys() if p[n] != c[n]}
    return out


@pytest.mark.parametrize("seed", [1])
def test_history_diff_equals_pairwise_diff(spark, seed):
    rng = random.Random(seed)
    history, headers, columns = {}, [], []
    for s in range(3):
        snaps = []
        for k in range(6):
            tables = {}
            if rng.random() > 0.15:  # sometimes a snapshot without tables
                for t in rng.sample(range(4), 3):
                    tables[f"t{t}"] = {f"c{c}": rng.choice(["integer", "text", None]) for c in rng.sample(range(6), 4)}
            snaps.append(tables)
            sid = f"s{s}-{k}"
            headers.append(("kafka", f"s{s}", sid, k))
            for t, cols in tables.items():
                for c, default in cols.items():
                    columns.append((f"s{s}", sid, t, *spec(c, default=default)))
        history[f"s{s}"] = snaps
    head = spark.createDataFrame(headers, "source_kind string, source_identifier string, snapshot_id string, captured_at int")
    cols = spark.createDataFrame(columns, f"source_identifier string, snapshot_id string, table_identifier string, {SPEC}")
    raw = diff.history_diff(snapshots.sequence(head, hot_rows=2, pieces=2), cols, cols)
    got = {(r.source_identifier, r.seq, r.table_identifier, r.kind, r.name) for r in raw.collect()}
    assert got == _pairwise(history)


def test_repeated_column_keeps_the_last(spark):
    rows = [("src", 2, False, "t", *spec("c")), ("src", 2, True, "t", *spec("c", "text", pos=1)), ("src", 2, True, "t", *spec("c", pos=7))]
    sides = spark.createDataFrame(rows, f"source_identifier string, seq long, is_curr boolean, table_identifier string, {SPEC}")
    raw = diff.pair_diff(sides, sides.select("source_identifier", "seq", "table_identifier", "is_curr")).collect()
    assert [(r.kind, r.column_after.ordinal_position, r.column_after.data_type) for r in raw] == [("modified", 7, "integer")]


def test_severity_and_destructive_gate(spark):
    rows = [(t, s, auto) for t in SEVERITY for s in ("low", "medium", "high") for auto in (True, False)]
    df = spark.createDataFrame(rows, "change_type string, severity string, auto_mergeable boolean")
    rank = {"low": 0, "medium": 1, "high": 2}
    for r in contract.with_reasons(df, contract.event_rules()).collect():
        want = []
        if r.change_type in DESTRUCTIVE and r.auto_mergeable:
            want.append("destructive_auto_merge")
        if rank[r.severity] < rank[SEVERITY[r.change_type]]:
            want.append("severity_below_default")
        assert r.reasons == want


def test_change_rules_by_kind(spark):
    rows = [("added", None, None), ("removed", None, None), ("modified", spec(), None), ("table_added", None, None), ("weird", None, None)]
    df = spark.createDataFrame(rows, f"kind string, column_before struct<{SPEC}>, column_after struct<{SPEC}>")
    got = [r.reasons for r in contract.with_reasons(df, contract.change_rules()).collect()]
    assert got == [["after_missing"], ["before_missing"], ["after_missing"], [], ["kind_unknown"]]


def test_snapshot_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("duckdb", "a", "1", 10), ("duckdb", "a", "2", 20), ("duckdb", "a", "2", 30)]
    df = spark.createDataFrame(rows, "source_kind string, source_identifier string, snapshot_id string, captured_at int")
    snapshots.append(df, path)
    snapshots.append(df, path)
    stored = spark.read.parquet(path)
    assert sorted((r.snapshot_id, r.captured_at) for r in stored.collect()) == [("1", 10), ("2", 20)]
    newest = snapshots.latest(stored).collect()
    assert [(r.snapshot_id, r.captured_at) for r in newest] == [("2", 20)]


def test_column_spec_matches_ddl(spark):
    assert spark.createDataFrame([], SPEC).schema.simpleString() == COLUMN_SPEC.simpleString()
