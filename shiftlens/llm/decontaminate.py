"""Benchmark decontamination: BM25 over test items with block-max pruning, then overlap of question and answer.

The items are the index: for each term the BM25 impact on each item, divided by the score the item gives itself, so a
passage that holds a whole item scores 1 on it. Every training text is cut into overlapping passages of words, each
long enough to hold the longest item whole, and every passage is a query. Items lie in blocks; a passage's bound
on a block is the sum of its terms' largest impacts there. Passages whose bound over all blocks is below the threshold
are skipped, then blocks, and what is left is scored exactly, so every item above the threshold is retrieved.
A retrieved pair is a hit if the passage holds at least ``OVERLAP`` of the item's five-word shingles, from its
question (all but its last sentence) and its answer (the last sentence, or the last third of a single one).

An index holds at most ``ITEMS`` items and is broadcast; a larger benchmark is several indexes, chosen by a hash of the
item, and the documents are read once for each. Item frequencies, lengths and the passages' length are those of the whole
benchmark, so a score is the same in one index or many.

Defined cases: items that are null or have no word are never hit; equal items are one; null or empty texts have no
passage; words are runs of letters, digits and non-ASCII bytes, lower-cased in ASCII; of several hits of an item in one
row the best counts; equal rows give equal hits; a null doc_id stays null; an empty benchmark or table gives no hit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm.common import map_batches, slices, texts
from shiftlens.llm.hashing import many_word_hashes, shingle_hashes, space_words

THRESHOLD = 0.5  # share of an item's own BM25 score
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 32  # items of one block
ITEMS = 4096  # items of one index
K1, B = 1.2, 0.75
WORDS = space_words(bytes(set(range(128)) - set(b"0123456789abcdefghijklmnopqrstuvwxyz")))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def question_and_answer(text: str) -> tuple[str, str]:
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass
class Statistics:
    """What a score needs to know of the whole benchmark: items with words, their mean and largest length, and in how many items a term is."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray  # sorted word hashes
    df: np.ndarray

    @staticmethod
    def of(words: np.ndarray, sizes: np.ndarray) -> Statistics:
        """Of the items whose words stand one after the other."""
        pairs = np.unique(np.stack([words, np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)]), axis=1)
        terms, df = np.unique(pairs[0], return_counts=True)
        return Statistics(len(sizes), float(sizes.mean()) if len(sizes) else 1.0, int(max(sizes, default=1)), terms, df)


@dataclass
class Index:
    """BM25 impacts of one block of the benchmark."""

    ids: list[int]
    terms: np.ndarray  # sorted word hashes
    impact: np.ndarray  # terms x items, divided by each item's own score
    block_max: np.ndarray  # terms x blocks
    most: np.ndarray  # largest impact of each term
    shingles: list[tuple[np.ndarray, np.ndarray, int]]  # of question and answer, and their size in words
    stride: int

    @staticmethod
    def of(items: list[tuple[int, str]], known: Statistics | None = None) -> Index:
        """``known`` are the numbers of the whole benchmark, where ``items`` are a part of it."""
        items = sorted((x for x in items if len(many_word_hashes([lowered(x[1])], WORDS)[0])), key=lambda x: (len(x[1]), x))
        words, first = many_word_hashes([lowered(t) for _, t in items], WORDS) if items else (np.empty(0, np.uint64), np.array([0]))
        terms, term = np.unique(words, return_inverse=True)
        size = np.diff(first[: len(items) + 1]) if items else np.empty(0, int)
        count = np.zeros((len(terms), len(items)), np.float32)
        np.add.at(count, (term, np.repeat(np.arange(len(items)), size)), 1)
        known = known or Statistics.of(words, size)
        df = known.df[np.searchsorted(known.terms, terms)]
        idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
        impact = idf[:, None] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / max(1.0, known.mean)))
        impact = (impact / np.maximum(impact.sum(axis=0), 1e-9)).astype(np.float32)
        order = range(0, len(items), BLOCK)
        block_max = np.stack([impact[:, a : a + BLOCK].max(axis=1) for a in order], axis=1) if items else np.empty((0, 0), np.float32)
        shingles = []
        for _, text in items:
            n = len(many_word_hashes([lowered(text)], WORDS)[0])
            parts = [many_word_hashes([lowered(x)], WORDS)[0] for x in question_and_answer(text)]
            whole = shingle_hashes(np.concatenate(parts), SHINGLE)
            cut = max(0, len(whole) - max(1, len(parts[1]))) if len(parts[1]) else len(whole)
            shingles.append((np.unique(whole[:cut]), np.unique(whole[cut:]), min(SHINGLE, n)))
        return Index([i for i, _ in items], terms, impact, block_max, impact.max(axis=1) if items else np.empty(0, np.float32), shingles, known.longest)

    def rows_of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def retrieve(self, row: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, item, score) of every pair at or above the threshold; passage k is words k*stride to (k+2)*stride."""
        known = np.flatnonzero(row >= 0)
        if not len(known):
            return []
        # first bound: largest impacts, by stride, over two strides; a term that repeats only raises it
        half = np.bincount(known // self.stride, self.most[row[known]])
        bound = half + np.concatenate((half[1:], [0]))
        out: list[tuple[int, int, float]] = []
        for passage in np.flatnonzero(bound >= threshold).tolist():
            at = row[passage * self.stride : (passage + 2) * self.stride]
            terms = np.unique(at[at >= 0])
            if self.most[terms].sum() < threshold:
                continue
            for block in np.flatnonzero(self.block_max[terms].sum(axis=0) >= threshold).tolist():
                score = self.impact[terms, block * BLOCK : (block + 1) * BLOCK].sum(axis=0)
                out += [(passage, block * BLOCK + i, float(score[i])) for i in np.flatnonzero(score >= threshold).tolist()]
        return out

    def hits(self, words: np.ndarray, threshold: float, overlap: float) -> dict[int, tuple]:
        """Best verified hit of each item: (overlap, score, question overlap, answer overlap, first word, end word)."""
        found: dict[int, tuple] = {}
        for passage, item, score in self.retrieve(self.rows_of(words), threshold - 1e-6):
            question, answer, size = self.shingles[item]
            start = passage * self.stride
            here = shingle_hashes(words[start : start + 2 * self.stride], size) if len(words) - start >= size else np.empty(0, np.uint64)
            q, a = np.isin(question, here).sum(), np.isin(answer, here).sum()
            share = (q + a) / (len(question) + len(answer))
            if share >= overlap:
                at = np.flatnonzero(np.isin(here, np.concatenate((question, answer))))
                best = (float(share), score, float(q / max(1, len(question))), float(a / max(1, len(answer))), start + int(at[0]), start + int(at[-1]) + size)
                found[item] = max(found.get(item, best), best)
        return found


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of at most about ``ITEMS`` items each, one at a time: only one is in the driver.

    Scores do not depend on how many there are: counts, lengths and frequencies are those of all items, and of the
    frequencies the driver holds those of one index's terms.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    found = cut(map_batches(items.select("part", "text"), _item_terms, "part int, term long, size long"), "item-terms")
    n, total, longest = found.filter("size > 0").agg(F.count("*"), F.sum("size"), F.max("size")).first()
    often = cut(found.filter("size is null").groupBy("term").agg(F.count("*").alias("df")), "term-items")
    for k in range(blocks):
        part = items.filter(F.col("part") == k).collect()
        own = found.filter((F.col("part") == k) & F.col("size").isNull()).select("term").distinct().join(often, "term").collect()
        terms = np.array([r["term"] for r in own], np.int64).view(np.uint64)
        order = np.argsort(terms)
        known = Statistics(n, (total or 0) / max(n, 1), longest or 1, terms[order], np.array([r["df"] for r in own], np.int64)[order])
        index = Index.of([(r["item_id"], r["text"]) for r in part], known)
        if index.ids:
            yield index


def _item_terms(batches):
    """Distinct terms of every item, and its number of words in a row without a term."""
    for batch in batches:
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = many_word_hashes([lowered(text)], WORDS)[0]
            terms = np.unique(words).view(np.int64).tolist()
            yield [[part] * (len(terms) + 1), [*terms, None], [None] * len(terms) + [len(words)]]


def _row_hits(index: Index, batch: pa.RecordBatch, column: str, threshold: float, overlap: float):
    for start, end in slices(batch, column):
        raw = [lowered(x or "") for x in batch.column(column).slice(start, end - start).to_pylist()]
        words, first = many_word_hashes(raw, WORDS)
        for i in range(end - start):
            found = index.hits(words[first[i] : first[i + 1]], threshold, overlap)
            if found:
                yield start + i, found


HITS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it. Documents are scanned in place, without a shuffle."""
    out = docs.sparkSession.createDataFrame([], HITS)
    for index in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                ids, columns = batch.column("doc_id").to_pylist(), [[] for _ in range(8)]
                for i, found in _row_hits(held.value, batch, "text", threshold, overlap):
                    for item, (share, score, q, a, first, end) in found.items():
                        for column, value in zip(columns, (ids[i], held.value.ids[item], score, share, q, a, first, end), strict=True):
                            column.append(value)
                yield columns

        out = out.union(map_batches(texts(docs, id_col, text_col), run, HITS))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    for index in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, _ in _row_hits(held.value, batch, text_col, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
