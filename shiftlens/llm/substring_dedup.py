"""Substring dedup over sliding sentence spans.

A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line break. Every sentence begins and
ends a span: the shortest run of at least ``sentences`` sentences and ``words`` words. Spans are hashed (128 bits
over the words, so spacing does not matter) and joined over all documents; every sentence that a
repeated span covers is removed, but for the span's first place (smallest doc_id, then position).

Short sentences repeat by chance, so a span has a least number of words; a span of several sentences does
not depend on where a passage was pasted: a host's half sentence before it spoils only the spans that hold it.

Defined cases: null or empty text has no sentence; text after the last mark is a sentence; a document
with too few words has no span and stays as it is; a repeat inside one document counts; equal rows are
one document; rows that share a ``doc_id`` with other texts are ordered by a hash of the text; rows
without a ``doc_id`` stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm.common import map_batches, texts
from shiftlens.llm.hashing import run_names, word_places

SENTENCES = 2
WORDS = 20
_END = re.compile(rb"[.!?]+(?=\s)|\n")


def sentences_of(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the sentences that hold a word, in order; together with white space they are the text."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.end()].strip():
            out.append((at, m.end()))
            at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def spans_in(text: bytes, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, sentence count and name (two words) of the spans that the sentences begin and end."""
    found = sentences_of(text)
    starts, hashes = word_places(text)
    at = np.searchsorted(starts, [a for a, _ in found] + [len(text)])  # first word of each sentence
    every = np.arange(len(found))
    end = np.maximum(every + sentences, np.searchsorted(at, at[every] + words))
    begin = np.minimum(every + 1 - sentences, np.searchsorted(at, at[every + 1] - words, side="right") - 1)
    fits, back = end <= len(found), begin >= 0
    both = np.unique(np.concatenate((every[fits] * (len(found) + 1) + end[fits], begin[back] * (len(found) + 1) + every[back] + 1)))
    first, end = both // (len(found) + 1), both % (len(found) + 1)
    return first, end - first, run_names(hashes, at[first], at[end])


def spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: name (``n0``, ``n1``), ``doc_id``, ``version`` of its text, ``first`` sentence, ``size`` in sentences."""

    def run(batches):
        for batch in batches:
            parts, held = [], 0
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "version", "text"))
            for doc, version, text in zip(*columns, strict=True):
                first, size, names = spans_in(text.encode(), sentences, words)
                parts.append((names[0], names[1], np.full(len(first), doc), np.full(len(first), version), first, size))
                held += len(first)
                if held > 1 << 17:
                    yield [np.concatenate(c) for c in zip(*parts, strict=True)]
                    parts, held = [], 0
            if parts:
                yield [np.concatenate(c) for c in zip(*parts, strict=True)]

    return map_batches(_versions(docs, id_col, text_col), run, "n0 long, n1 long, doc_id long, version long, first int, size int")


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).filter("doc_id is not null").withColumn("version", F.xxhash64("text"))


def repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``version`` and its repeated spans: array of (first, size, keep_id, keep_first)."""
    every = spans(docs, sentences, words, id_col, text_col)
    place = F.struct("doc_id", "version", "first")
    # Half of the name finds the few spans that may be repeated, in the narrowest rows; the rest is done on those.
    twice = every.groupBy("n0").agg(F.count("*").alias("n")).filter("n > 1").select("n0")
    some = cut(every.join(twice, "n0"), "repeats")
    again = some.join(some.groupBy("n0", "n1").agg(F.min(place).alias("keep")), ["n0", "n1"]).filter(place != F.col("keep"))
    one = again.select("doc_id", "version", F.struct("first", "size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.first").alias("keep_first")).alias("span"))
    return one.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("span")).alias("spans"))


RUNS = "doc_id long, keep_id long, first_sentence int, n_sentences int, n_words int, keep_first int, removed string"


def repeated_runs(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per stretch of removed sentences, with the document that keeps its first span."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = text.encode()
                ranges = sentences_of(raw)
                for span, end in _stretches(found):
                    removed = raw[ranges[span["first"]][0] : ranges[end - 1][1]]
                    row = (doc, span["keep_id"], span["first"], end - span["first"], len(removed.split()), span["keep_first"], removed.strip().decode())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield out

    marked = _versions(docs, id_col, text_col).join(repeats(docs, sentences, words, id_col, text_col), ["doc_id", "version"])
    return map_batches(marked.dropDuplicates(["doc_id", "version"]).select("doc_id", "text", "spans"), run, RUNS)


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` without removed sentences, ``n_removed`` for every row of ``docs``."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, gone = text.encode(), set()
                for span, end in _stretches(found or []):
                    gone.update(range(span["first"], end))
                left = b"".join(raw[a:b] for i, (a, b) in enumerate(sentences_of(raw)) if i not in gone) if gone else raw
                out[0].append(doc)
                out[1].append((left.strip() if gone else left).decode())
                out[2].append(len(gone))
            yield out

    every = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    marked = every.join(repeats(docs, sentences, words, id_col, text_col), ["doc_id", "version"], "left")
    return map_batches(marked.select("doc_id", "text", "spans"), run, "doc_id long, text string, n_removed long")


def _stretches(found: list[dict]) -> list[tuple[dict, int]]:
    """Overlapping or touching spans as (leading span, end sentence); ``found`` is sorted by first sentence."""
    out: list[list] = []
    for span in found:
        if out and span["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["first"] + span["size"])
        else:
            out.append([span, span["first"] + span["size"]])
    return [(span, end) for span, end in out]
