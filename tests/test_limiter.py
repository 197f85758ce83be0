"""The rate limit on cells against one deque over all events."""

import random
from collections import deque

import pytest

from shiftlens.operators import limiter
from shiftlens.operators.limiter import rate_limit


def _fold(events, n, width):
    window, limited = {}, {}
    for scope, t, i, takes in sorted(events, key=lambda e: (e[1], e[2])):
        w = window.setdefault(scope, deque())
        while w and w[0] < t - width:
            w.popleft()
        limited[i] = len(w) >= n
        if takes and not limited[i]:
            w.append(t)
    return limited


def _events(seed, n, span, scopes=3):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, span, span * 3 if rng.random() < 0.05 else 1])
        rows.append((f"s{rng.randrange(scopes)}", t * 1_000_000, i, rng.random() < 0.7))
    return rows


@pytest.mark.parametrize(
    "seed,n,width,limit,pieces",
    [(1, 800, 60, 3, 256), (2, 500, 60, 3, 40), (5, 150, 20, 2, 1000)],
)
def test_rate_limit_equals_deque(spark, seed, n, width, limit, pieces):
    rows = _events(seed, n, 4)
    df = spark.createDataFrame(rows, "scope_name string, us long, event_id long, takes boolean").selectExpr(
        "scope_name", "timestamp_micros(us) detected_at", "event_id", "takes"
    )
    judged, passed = rate_limit(
        df, "takes", scope="scope_name", max_events=limit, window_seconds=width, pieces=pieces
    )
    got = {r.event_id: r.rate_limited for r in judged.collect()}
    want = _fold(rows, limit, width * 1_000_000)
    assert got == want
    takes = {r[2] for r in rows if r[3]}
    assert {r.id for r in passed.collect()} == {i for i in takes if not want[i]}


def test_entry_exactly_one_window_old_still_counts(spark):
    df = spark.sql(
        "select timestamp_micros(t * 1000000) detected_at, t event_id, true takes from values (0L), (3600L), (3601L) v(t)"
    )
    judged, _ = rate_limit(df, "takes", max_events=1, window_seconds=3600)
    assert {r.event_id: r.rate_limited for r in judged.collect()} == {0: False, 3600: True, 3601: False}


def test_prior_entries_carry_over(spark):
    rows = _events(9, 300, 4)
    cut_at = sorted(r[1] for r in rows)[150]
    schema = "scope_name string, us long, event_id long, takes boolean"
    read = lambda part: spark.createDataFrame(part, schema).selectExpr(
        "scope_name", "timestamp_micros(us) detected_at", "event_id", "takes"
    )
    options = dict(scope="scope_name", max_events=3, window_seconds=60, pieces=30)
    first, passed = rate_limit(read([r for r in rows if r[1] < cut_at]), "takes", **options)
    second, _ = rate_limit(read([r for r in rows if r[1] >= cut_at]), "takes", prior=passed.select("scope", "t"), **options)
    got = {r.event_id: r.rate_limited for r in [*first.collect(), *second.collect()]}
    assert got == _fold(rows, 3, 60_000_000)


def _crowded(seed, n, scopes):
    """Bursts of microseconds, ties, and places that fall free inside a burst."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 3, 50, 700] if rng.random() < 0.995 else [30_000_000, 59_999_000, 61_000_000])
        rows.append((f"s{rng.randrange(scopes)}", t, i, rng.random() < 0.9))
    return rows


@pytest.mark.parametrize("seed,limit,pieces", [(1, 3, 8), (2, 1, 64), (3, 7, 16)])
def test_crowded_cells_are_cut_finer(spark, seed, limit, pieces):
    rows = _crowded(seed, 6000, 2)
    df = spark.createDataFrame(rows, "scope_name string, us long, event_id long, takes boolean").selectExpr(
        "scope_name", "timestamp_micros(us) detected_at", "event_id", "takes"
    )
    judged, _ = rate_limit(df, "takes", scope="scope_name", max_events=limit, window_seconds=60, pieces=pieces)
    assert {r.event_id: r.rate_limited for r in judged.collect()} == _fold(rows, limit, 60_000_000)


def test_a_fold_reads_few_rows_of_a_crowded_window(spark):
    rows = spark.range(200_000).selectExpr("'s' scope", "id * 15 t", "id")
    kept = limiter._first(rows, 10, 0, limiter._widths(3_600_000_000, 256)[0])
    assert kept.count() == 11


def test_repeated_events_and_no_events(spark):
    rows = [("s", 5, 1, True)] * 4 + [("s", 6, 2, True), ("s", 7, 3, True)]
    df = spark.createDataFrame(rows, "scope_name string, us long, event_id long, takes boolean").selectExpr(
        "scope_name", "timestamp_micros(us) detected_at", "event_id", "takes"
    )
    judged, _ = rate_limit(df, "takes", scope="scope_name", max_events=2, window_seconds=60)
    assert sorted((r.event_id, r.rate_limited) for r in judged.collect()) == [(1, False)] * 4 + [(2, False), (3, True)]
    assert rate_limit(df.limit(0), "takes")[0].count() == 0


@pytest.mark.parametrize("seed,limit,rows_a_piece", [(1, 3, 1), (2, 1, 4), (3, 7, 40)])
def test_chunks_of_a_stretch_are_folded_once_each(spark, monkeypatch, seed, limit, rows_a_piece):
    """Dense and thin windows in turn: windows above the limit of a chunk, and chunks of many windows; no round is repeated."""
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([10, 200, 5_000, 40_000] if i // 600 % 2 else [3_000_000, 9_000_000])
        rows.append((f"s{rng.randrange(2)}", t, i, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "scope_name string, us long, event_id long, takes boolean").selectExpr(
        "scope_name", "timestamp_micros(us) detected_at", "event_id", "takes"
    )
    monkeypatch.setattr(limiter, "ROWS", rows_a_piece)
    folds, folded = [], limiter._folded
    monkeypatch.setattr(limiter, "_folded", lambda *a: folds.append(1) or folded(*a))
    judged, _ = rate_limit(df, "takes", scope="scope_name", max_events=limit, window_seconds=60, pieces=8)
    assert {r.event_id: r.rate_limited for r in judged.collect()} == _fold(rows, limit, 60_000_000)
    windows = {(r[0], r[1] // 60_000_000) for r in rows}
    assert 1 < len(folds) <= max(sum(w[0] == s for w in windows) for s in ("s0", "s1"))


def test_a_saturated_limit_takes_rounds_by_rows_only(spark, monkeypatch):
    """A full window every minute, every place falling free among other rows: one chunk is one fold."""
    df = spark.range(20_000).selectExpr("timestamp_micros(id * 137001) detected_at", "id event_id", "true takes")
    folds, folded = [], limiter._folded
    monkeypatch.setattr(limiter, "_folded", lambda *a: folds.append(1) or folded(*a))
    judged, _ = rate_limit(df, "takes", max_events=5, window_seconds=60, pieces=8)
    rows = [("global", i * 137001, i, True) for i in range(20_000)]
    assert {r.event_id: r.rate_limited for r in judged.collect()} == _fold(rows, 5, 60_000_000)
    assert len(folds) == 1
