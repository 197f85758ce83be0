"""The snapshot store: append once, all or nothing, and what an append reads."""

import pytest

from shiftlens.functions.durable import new_path
from shiftlens.operators.store import SnapshotStore

HEADERS = "snapshot_id string, source_identifier string, captured_at long"
COLUMNS = "source_identifier string, snapshot_id string, name string"


def _frames(spark, ids, names=("x", "y")):
    heads = [(f"{s}@{n}", s, n) for s, n in ids]
    return spark.createDataFrame(heads, HEADERS), spark.createDataFrame([(s, f"{s}@{n}", c) for s, n in ids for c in names], COLUMNS)


def _held(store, spark):
    heads, cols = _frames(spark, [])
    return (
        sorted(r.snapshot_id for r in store.headers(heads.schema).collect()),
        sorted((r.source_identifier, r.snapshot_id, r.name) for r in store.columns(cols.schema).collect()),
    )


def test_a_snapshot_is_stored_once(spark):
    store = SnapshotStore(spark, new_path(spark, "store"))
    assert _held(store, spark) == ([], [])
    assert store.append(*_frames(spark, [("a", 1), ("b", 1)]))
    assert store.append(*_frames(spark, [("a", 1), ("a", 2), ("a", 2)], names=("z",)))
    assert store.append(*_frames(spark, [("a", 1), ("a", 2), ("b", 1)])) is None
    heads, cols = _held(store, spark)
    assert heads == ["a@1", "a@2", "b@1"]
    assert cols == [("a", "a@1", "x"), ("a", "a@1", "y"), ("a", "a@2", "z"), ("a", "a@2", "z"), ("b", "b@1", "x"), ("b", "b@1", "y")]
    newest = store.latest_columns(*(f.schema for f in _frames(spark, [])))
    assert sorted({(r.source_identifier, r.snapshot_id) for r in newest.collect()}) == [("a", "a@2"), ("b", "b@1")]
    assert sum(r.snapshots for r in store.commits().collect()) == 3


@pytest.mark.parametrize("step", ["columns", "record"])
def test_a_crash_leaves_nothing_and_the_next_append_all(spark, monkeypatch, step):
    store = SnapshotStore(spark, new_path(spark, "store"))
    store.append(*_frames(spark, [("a", 1)]))
    before = _held(store, spark)
    heads, cols = _frames(spark, [("a", 2)])
    if step == "columns":  # the job that writes the columns dies
        broken = cols.selectExpr("source_identifier", "snapshot_id", "raise_error('lost') name")
        with pytest.raises(Exception, match="lost"):
            store.append(heads, broken)
    else:  # the driver dies before the record
        with monkeypatch.context() as m:
            m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                store.append(heads, cols)
    assert _held(store, spark) == before
    store.append(heads, cols)
    assert _held(store, spark)[0] == ["a@1", "a@2"] and len(_held(store, spark)[1]) == 4


def test_an_append_opens_no_header_or_column_file(spark):
    store = SnapshotStore(spark, new_path(spark, "store"))
    store.append(*_frames(spark, [("a", 1), ("b", 1)]))
    heads, _ = _frames(spark, [("a", 1)])
    plan = heads.join(store.ids(), "snapshot_id", "left_anti")
    assert plan.inputFiles() and all("/ids/" in f for f in plan.inputFiles())
