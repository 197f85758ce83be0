"""Source divergence audit: how far the word use of the sources of each language is apart.

Words of every whole text are counted by (language, source), and a language keeps the terms in at least ``LEAST`` of its
documents. A term's smoothed share in a group is p = 1 + floor(``UNIT`` * (count + 5) / (N + 5 * V)), with N the group's
occurrences of kept terms and V their number; |p - q| summed over all kept terms is the distance of two sources, and p - q
against the whole language names a source's own terms.

Distances come from segment trees over term ids. The ids of a language are dealt by a hash into blocks of about ``TERMS``,
sorted by frequency inside, so that equal counts stand side by side; a group's tree over a block has its counts as leaves.
Trees of all groups in a task are hash-consed level by level: equal counts are one leaf, equal pairs of children one node, so
equal subtrees, runs of zeros above all, are shared between places and groups. Two trees are traversed at the same time from
their roots, level by level; a pair of nodes met again, at whatever place, is kept once with its number, so that each pair of
equal nodes is priced once for a pair of groups. A task holds one block and two sets of about ``GROUPS`` groups, whatever the
table's size; sums over blocks are one row for each pair of sources.

Counting keeps at most ``HELD`` terms at a time in a task and hands on partial counts by (language, term), so a hot source or
word is spread over terms. Numbers are whole and exact; shares of counts beyond 9e9 are computed by Python's integers.

Defined cases: null text, language and source are ''. A text without words, an empty one included, still makes its group
occur. Long texts are read in slices. Repeated rows and ids count each. A language without kept terms has pairs of value 0
and no terms. Equal values are ranked by the item's UTF-8 bytes. Other columns of the table are not read, so their names
cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm.common import map_batches

LEAST, UNIT, ADDED, TOP = 30, 1_000_000_000, 5, 50
HELD, SLICE, ROWS = 200_000, 1 << 20, 50_000
TERMS, GROUPS, PAIRS = 3500, 64, 64

#: Bytes of words stay, A-Z in lower case; all others become blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: str) -> Iterator[list[bytes]]:
    """Words of a text, slice by slice; slices end at blanks."""
    data = text.encode().translate(_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    used: defaultdict[tuple, Counter] = defaultdict(Counter)
    held: defaultdict[tuple, Counter] = defaultdict(Counter)

    def out() -> Iterator[list[list]]:
        for (lang, source), counts in used.items():
            terms, docs = list(counts), held[lang, source]
            for i in range(0, len(terms), ROWS):
                some = terms[i : i + ROWS]
                yield [[lang] * len(some), [source] * len(some), [t.decode() for t in some], [counts[t] for t in some], [docs[t] for t in some]]
        used.clear()
        held.clear()

    kept = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            group, counts, distinct = (lang, source), used[lang, source], set()
            kept -= len(counts)
            for words in _pieces(text):
                counts.update(words)
                distinct.update(words)
            held[group].update(distinct)
            kept += len(counts)
            if kept > HELD:
                yield from out()
                kept = 0
    yield from out()


def share(count: Column | str, total: Column | str, size: Column | str) -> Column:
    """p of a count among ``total`` occurrences of ``size`` kept terms."""
    return F.expr(f"cast(1 + (({count} + cast({ADDED} as decimal(1,0))) * {UNIT}) div ({total} + {ADDED} * {size}) as long)")


def shares(counts: np.ndarray, below: int) -> np.ndarray:
    """p of every count, ``below`` being N + 5 * V."""
    if counts.size and int(counts.max()) > 9_000_000_000:
        counts = counts.astype(object)
    return (1 + (counts + ADDED) * UNIT // below).astype(np.int64)


class Trees:
    """Hash-consed trees over the rows of ``counts`` (groups x terms, padded by -1 to a power of two)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.leaves, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            most = int(ids.max()) + 1
            nodes, inner = np.unique(ids[:, ::2].astype(np.int64) * most + ids[:, 1::2], return_inverse=True)
            self.children.append((nodes // most, nodes % most))
            ids = inner.reshape(len(counts), -1)
        self.roots = ids[:, 0]

    def prices(self, p: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
        """Sum of |p - q| of every pair (first[i], second[i]) of groups, and how many node pairs were priced.

        ``p`` is groups x leaves, 0 for the padding.
        """
        left, right, pair = self.roots[first], self.roots[second], np.arange(len(first))
        steps, priced = [], len(first)
        for low, high in reversed(self.children):
            most = int(max(low.max(), high.max())) + 1
            both = [(pair * most + side[left]) * most + side[right] for side in (low, high)]
            met, inner = np.unique(np.concatenate(both), return_inverse=True)
            steps.append((inner[: len(left)], inner[len(left) :]))
            pair, rest = np.divmod(met, most * most)
            left, right = np.divmod(rest, most)
            priced += len(met)
        price = np.abs(p[first[pair], left] - p[second[pair], right])
        for a, b in reversed(steps):
            price = price[a] + price[b]
        return price, priced


def block_prices(rows: pd.DataFrame) -> pd.DataFrame:
    """Distances of the groups in one block: rows with an id are counts, rows without name a group."""
    names = rows[rows["id"].isna()].sort_values(["part", "source"]).drop_duplicates("source")
    place = {s: i for i, s in enumerate(names["source"])}
    size = int(names["size"].iloc[0])
    counts = np.zeros((len(names), 1 << max(0, (size - 1).bit_length())), np.int64)
    counts[:, size:] = -1
    cells = rows[rows["id"].notna()]
    counts[cells["source"].map(place).to_numpy(np.int64), cells["id"].to_numpy(np.int64)] = cells["count"].to_numpy(np.int64)
    parts = names["part"].to_numpy()
    a, b = np.triu_indices(len(names), 1)
    if rows["a"].iloc[0] != rows["b"].iloc[0]:  # pairs inside one part belong to another task
        a, b = a[parts[a] != parts[b]], b[parts[a] != parts[b]]
    value = np.zeros(len(a), np.int64)
    if size:
        trees = Trees(counts)
        p = np.stack([np.where(trees.leaves < 0, 0, shares(trees.leaves, int(below))) for below in names["below"]])
        for i in range(0, len(a), PAIRS):
            value[i : i + PAIRS], _ = trees.prices(p, a[i : i + PAIRS], b[i : i + PAIRS])
    source = names["source"].to_numpy(object)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "one": source[a], "two": source[b], "value": value})


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang``, ``source``, ``term``, ``count``, ``total`` (in the language) of every kept term that a group has."""
    partial = map_batches(docs, _count, "lang string, source string, term string, count long, docs long").repartition("lang", "term")
    counted = partial.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"all_docs": F.sum("docs").over(whole), "total": F.sum("count").over(whole)})
    return counted.filter(F.col("all_docs") >= least).select("lang", "source", "term", "count", "total")


def audit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: distances to the other sources (``pair``) and own terms (``term``)."""
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    kept = cut(kept_counts(docs, least), "counts")
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(groups.na.fill(0, ["n", "v", "lang_n"]), "groups")
    return pair_part(kept, terms, groups).unionByName(term_part(kept, groups, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def term_part(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a source uses most beyond its language."""
    p = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (share("count", "n", "v") - share("total", "lang_n", "v")).alias("value"))
    return _ranked(p.filter("value > 0"), "term").filter(F.col("rank") <= top)


def pair_part(kept: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """The distance of every source of a language to every other."""
    dealt = lambda key, n: F.pmod(F.xxhash64("lang", key), n).cast("int")
    cuts = groups.groupBy("lang", "v").agg(F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).alias("blocks"), F.ceil(F.count("*") / GROUPS).alias("parts"))
    cuts = cut(cuts, "cuts")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("total"), "term"))
    ids = cut(terms.join(cuts, "lang").select("lang", "term", "total", dealt("term", F.col("blocks")).alias("block")).withColumn("id", place - 1), "ids")
    block_sizes = ids.groupBy("lang", "block").agg(F.count("*").alias("size"))
    # every group stands in all blocks of its language, and with every part of its groups
    members = groups.join(cuts.drop("v"), "lang").select("lang", "source", (F.col("n") + ADDED * F.col("v")).alias("below"), dealt("source", F.col("parts")).alias("part"), "parts", "blocks")
    marks = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).join(block_sizes, ["lang", "block"], "left")
    marks = marks.select("lang", "block", "source", "part", "parts", "below", F.coalesce("size", F.lit(0)).alias("size"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("long").alias("count"))
    cells = kept.drop("total").join(ids.drop("total"), ["lang", "term"]).join(members, ["lang", "source"])
    cells = cells.select("lang", "block", "source", "part", "parts", "below", F.lit(0).cast("long").alias("size"), "id", "count")
    both = marks.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    both = both.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("parts", "other")
    priced = both.groupBy("lang", "block", "a", "b").applyInPandas(block_prices, "lang string, one string, two string, value long")
    sums = priced.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    return _ranked(sums.select("lang", sides.alias("side"), "value").select("lang", "side.source", "side.item", "value"), "pair")
