"""Approximate nearest neighbours by multi-index hashing.

A vector's code is the signs of its centred vector under learned rotations: principal axes, rotated so that signs lose
least (iterative quantisation), ``ROTATIONS`` times from different starts. A code is split into one-byte substrings, each
with its own index from value to rows. If two codes differ in at most r bits, some substring differs in at most
r // substrings bits, so probing the values that near in every index meets every code within radius r; XOR counts keep
exactly those, and the original vectors rank them.

The mean, the rotations and r come from a sample of at most ``SAMPLE`` vectors (those with the smallest hash of the id): r
is such that ``REACH`` of the sample's near neighbours lie within it. All vectors are indexed. Index and queries are dealt
into blocks by hashes and every block of queries meets every block of the index, so a task holds two blocks
whatever the table's size. Where a block holds fewer than k codes within r, its k nearest codes count instead.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor those of another
length than the most common (the smaller of two); ties go to the smaller id; rows of the same id are one vector, the
smallest in order; null ids take no part; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut

SAMPLE, SAMPLE_QUERIES = 4096, 512
ROTATIONS, ITERATIONS = 2, 20
REACH = 0.98
INDEX_ROWS, QUERY_ROWS = 8192, 1024
_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass
class Codes:
    """Learned centre and rotations, and the radius to search."""

    centre: np.ndarray
    turn: np.ndarray
    radius: int = 0

    @staticmethod
    def learn(sample: np.ndarray) -> Codes:
        centre = sample.mean(axis=0)
        _, _, axes = np.linalg.svd(sample - centre, full_matrices=True)
        turned, parts, rng = (sample - centre) @ axes.T, [], np.random.default_rng(7)
        for _ in range(ROTATIONS):
            rotation, _ = np.linalg.qr(rng.standard_normal((len(axes), len(axes))))
            for _ in range(ITERATIONS):
                u, _, v = np.linalg.svd(turned.T @ np.where(turned @ rotation >= 0, 1.0, -1.0))
                rotation = u @ v
            parts.append(axes.T @ rotation)
        return Codes(centre, np.concatenate(parts, axis=1))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        return np.packbits((vectors - self.centre) @ self.turn >= 0, axis=1)

    def reach(self, sample: np.ndarray, k: int, rows: int) -> None:
        """Set the radius: near neighbours in the sample are its share of the k nearest of all rows."""
        near = max(1, min(len(sample) - 1, round(k * len(sample) / max(rows, 1))))
        if len(sample) < 2:
            return
        some, codes = sample[:SAMPLE_QUERIES], self.of(sample)
        product = some @ sample.T
        product[np.arange(len(some)), np.arange(len(some))] = -np.inf
        best = np.argpartition(-product, near - 1, axis=1)[:, :near]
        apart = np.bitwise_count(codes[: len(some), None, :] ^ codes[best]).sum(axis=2)
        self.radius = int(np.quantile(apart, REACH, method="higher"))


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


class Block:
    """A block of the index: for each substring, a bitmap of the rows of every value.

    A probe asks for all values within a few bits of one, so the bitmaps of such balls are ORed once a block.
    """

    def __init__(self, codes: np.ndarray, radius: int) -> None:
        self.radius, self.words = radius, _words(codes)
        near = radius // max(codes.shape[1], 1) >= _DISTANCE
        self.balls = np.empty((codes.shape[1], 256, -(-len(codes) // 8)), np.uint8)
        for j, column in enumerate(codes.T):
            rows = np.packbits(column[None, :] == np.arange(256, dtype=np.uint8)[:, None], axis=1)
            for value in range(256):
                self.balls[j, value] = np.bitwise_or.reduce(rows[near[value]], axis=0)

    def within(self, code: np.ndarray, least: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits, or the ``least`` nearest codes if those are more."""
        met = np.bitwise_or.reduce(self.balls[np.arange(len(code)), code], axis=0)
        rows, own = np.flatnonzero(np.unpackbits(met, count=len(self.words))), _words(code[None, :])
        rows = rows[np.bitwise_count(self.words[rows] ^ own).sum(axis=1, dtype=np.int64) <= self.radius]
        if len(rows) >= min(least, len(self.words)):
            return rows
        apart = np.bitwise_count(self.words ^ own).sum(axis=1, dtype=np.int64)
        return np.flatnonzero(apart <= np.partition(apart, min(least, len(apart)) - 1)[min(least, len(apart)) - 1])


def search_block(index: pd.DataFrame, queries: pd.DataFrame, model: Codes, k: int) -> pd.DataFrame:
    """The k best of one block of the index for each of one block of queries."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(index) and len(queries):
        ids, vectors = index["vec_id"].to_numpy(), np.stack(index["vector"].to_numpy()).astype(np.float64)
        wanted = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        block, codes = Block(model.of(vectors), model.radius), model.of(wanted)
        for query, vector, code in zip(queries["vec_id"].to_numpy(), wanted, codes, strict=True):
            rows = block.within(code, k + 1)
            rows = rows[ids[rows] != query]
            score = vectors[rows] @ vector
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), query), ids[rows[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1)
    return rows.join(F.broadcast(sizes.select("n")), F.size("vector") == F.col("n")).select("vec_id", "vector")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (inner product) of the k nearest found of each query row."""
    rows = cut(usable(vectors, id_col, vector_col), "vectors")
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    schema = "query_id long, vec_id long, score double"
    if sample:
        points = np.array([r["vector"] for r in sample])
        model = Codes.learn(points)
        model.reach(points, k, count)
    else:
        model = Codes(np.zeros(0), np.zeros((0, 0)))
    queries = rows.filter(is_query(F.col("vec_id")))
    blocks, groups = -(-count // INDEX_ROWS) or 1, -(-queries.count() // QUERY_ROWS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    index = rows.select("vec_id", "vector", dealt(blocks).alias("block")).withColumn("group", every(groups))
    asked = queries.select("vec_id", "vector", dealt(groups).alias("group")).withColumn("block", every(blocks))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, model, k)

    found = index.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(search, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
