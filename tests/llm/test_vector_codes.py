import hashlib
from math import floor

import numpy as np

from shiftlens.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int, ids int"


def brute(rows):
    """The contract's rows by plain loops: rows are (vec_id, vector, label) with finite components."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    whole = [[floor(4096 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    start = [v for v, r in zip(whole, rows, strict=True) if r[0] is not None][:16]
    books = [[part(v, p) for v in start] for p in range(8)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            where = [near(v, p)[1] for v in whole]
            books[p] = [
                [sum(x) // len(x) for x in zip(*(part(v, p) for v, w in zip(whole, where, strict=True) if w == i), strict=True)] if i in where else e for i, e in enumerate(books[p])
            ]
    found = [[near(v, p) for p in range(8)] for v in whole]
    labels = {}
    for r, f in zip(rows, found, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), labels[r[2]], digest) for r, f in zip(rows, found, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.standard_normal(dim), 1).astype(np.float32)], int(i % 3) if i % 5 else None) for i in range(n)]


def test_codes_equal_brute_force(spark, monkeypatch):
    rows = vectors(90)
    rows += [(7, rows[7][1], 1), (5, rows[3][1], 2), (None, rows[0][1], 1), (200, [0.0] * 16, 0), (201, [0.0] * 16, 0)]
    want = sorted(brute(rows), key=str)
    assert got(vector_codes.code_table(frame(spark, rows))) == want
    monkeypatch.setattr(vector_codes, "BLOCK", 8)
    assert got(vector_codes.code_table(frame(spark, rows).repartition(3))) == want


def test_rows_that_take_no_part(spark):
    rows = vectors(30)
    bad = [(100, None, 1), (101, [], 1), (102, [None] + [1.0] * 15, 1), (103, [float("nan")] * 16, 1), (104, [float("inf")] * 16, 1), (105, [1.0] * 8, 1), (106, [1e20] * 16, 1)]
    assert got(vector_codes.code_table(frame(spark, rows + bad))) == sorted(brute(rows), key=str)


def test_few_rows_and_none(spark):
    rows = vectors(3)
    assert got(vector_codes.code_table(frame(spark, rows))) == sorted(brute(rows), key=str)
    assert got(vector_codes.code_table(frame(spark, []))) == []
    assert got(vector_codes.code_table(frame(spark, [(None, [1.0] * 16, 1)]))) == []


def test_components_near_the_limit_stay_exact(spark):
    rows = [(i, [float((-1) ** i * 40_000)] * 8 + [float(i)] * 8, 1) for i in range(40)]
    assert got(vector_codes.code_table(frame(spark, rows))) == sorted(brute(rows), key=str)


def test_decoded_vectors_are_the_entries(spark):
    rows = vectors(40)
    coded, books = vector_codes.compress(frame(spark, rows))
    error = {r["vec_id"]: r["error"] for r in coded.collect()}
    whole = {i: np.floor(np.array(v) * 4096) for i, v, _ in rows}
    for r in vector_codes.decode(coded, books).collect():
        assert round(((np.array(r["vector"]) * 4096 - whole[r["vec_id"]]) ** 2).sum()) == error[r["vec_id"]]
