"""Closure of few seeds and levels as iterated joins over edge tables; ``reach`` has the closure of many seeds.

Each round is one shuffle join of the newest rows only, written to the shared folder, so a
lost executor costs one round and the plan never grows. Hub nodes are left to AQE's skew join;
results are sets of (seed, vertex) rows and are never gathered per seed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shiftlens.functions.durable import cut
from shiftlens.operators import reach


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(
    seeds: DataFrame,
    edges: DataFrame,
    ids: Sequence[str],
    vertex: Sequence[str],
    src: Sequence[str],
    dst: Sequence[str],
    stored: bool = False,
) -> DataFrame:
    """Vertices reached from each seed by one edge or more: rows (ids, vertex), distinct.

    Cycles end because a known (ids, vertex) row is not expanded again. ``stored`` says the
    edges are a distinct stored table already.
    """
    row = [*ids, *vertex]
    hop = edges.select(
        *[F.col(s).alias(f"__s{i}") for i, s in enumerate(src)],
        *[F.col(d).alias(f"__d{i}") for i, d in enumerate(dst)],
    )
    if not stored:
        hop = cut(hop.distinct(), "edges")

    def step(frontier: DataFrame) -> DataFrame:
        on = reduce(
            lambda a, b: a & b, [frontier[v] == hop[f"__s{i}"] for i, v in enumerate(vertex)]
        )
        return (
            frontier.join(hop, on)
            .select(*ids, *[F.col(f"__d{i}").alias(v) for i, v in enumerate(vertex)])
            .distinct()
        )

    rounds = [cut(step(seeds.select(*row)), "reach")]
    while not rounds[-1].isEmpty():
        rounds.append(cut(step(rounds[-1]).join(_union(rounds), row, "left_anti"), "reach"))
    return _union(rounds)


def descendants(
    seeds: DataFrame,
    edges: DataFrame,
    ids: Sequence[str],
    vertex: Sequence[str],
    src: Sequence[str],
    dst: Sequence[str],
    start: Sequence[str],
) -> DataFrame:
    """Strict descendants: ``reachable`` without the seed itself (``start`` names its id columns)."""
    found = reachable(seeds, edges, ids, vertex, src, dst)
    same = reduce(lambda a, b: a & b, [F.col(s) == F.col(v) for s, v in zip(start, vertex, strict=True)])
    return found.where(~same)


def levels(nodes: DataFrame, edges: DataFrame, node: Sequence[str], src: Sequence[str], dst: Sequence[str]) -> DataFrame:
    """Longest-path level per node from 0; nodes on or behind a cycle get NULL."""
    stored = reach.store(edges, node, src, dst, nodes)
    return reach.levels(stored).join(stored.names(), "id").select(*node, "level")
