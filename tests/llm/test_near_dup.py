import random

import numpy as np
import pytest

from shiftlens.llm import components, near_dup


def brute(rows, per_cent, size=5):
    sets = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), low[find(i)], low[find(i)] == doc) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_groups_equal_brute_force(spark, threshold):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, base = [], [word() for _ in range(120)]
    for doc in range(90):
        w = list(base) if doc % 3 else [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((doc, " ".join(w) if doc % 10 else " ".join(base).upper()))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A  B"), (104, "a b")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows, round(threshold * 100))


def test_a_pair_at_the_threshold_is_never_ruled_out():
    rng = np.random.default_rng(1)
    for n in (20, 200, 1000):
        common, own = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n * 18 // 100).astype(np.uint64)
        half = len(own) // 2
        a, b = np.unique(np.concatenate((common, own[:half]))), np.unique(np.concatenate((common, own[half:])))
        x, y = (np.array(near_dup.odd_sketch(s), np.int64) for s in (a, b))
        if len(a) <= near_dup.SKETCHED:
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_odd_rows_and_no_rows(odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id == 3} == {2}
    assert near_dup.one_of_each(odd).columns == odd.columns and near_dup.one_of_each(odd).count() == 6
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(21)} == {0} and {found[i] for i in range(100, 130)} == {100}


def test_small_tables_are_a_few_files_however_many_partitions(spark):
    import glob

    from shiftlens.functions import durable

    rows = [(i, " ".join(f"w{i // 4}x{j}" for j in range(60 + i % 4))) for i in range(200)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        before = set(glob.glob(f"{durable.shared_dir(spark)}/shiftlens-*".removeprefix("file:")))
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()
        made = set(glob.glob(f"{durable.shared_dir(spark)}/shiftlens-*".removeprefix("file:"))) - before
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r)[:4] for r in got) == brute(rows, 85)
    files = {path: len(glob.glob(f"{path}/part-*")) for path in made if "sketches" not in path}
    assert len(files) > 8 and max(files.values()) <= 2
