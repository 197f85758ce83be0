"""Line dedup by content-defined line chunks.

Each line has a hash; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is 0 modulo
``MEAN``, so boundaries move with the content and an inserted or removed line changes only the chunks
around it. A last line alone belongs to the chunk before it; that chunk is looked for without the line too, as in other
documents it may end there. Chunks of several lines that occur more than once in all documents are removed, but for the
first place (smallest doc_id, then position), after their bytes were found equal to the first's.

The first chunk of a document and the one after a changed line may start elsewhere in two copies of a
passage; the chunks that follow agree again, as a boundary depends on ``WINDOW`` lines only.

Defined cases: null and empty text have no line and stay as they are; lines end at ``\\n`` only; a document of
one line is a chunk that is never removed; a repeat inside one document counts; equal rows
(``doc_id`` and text) are one document; other texts under the same ``doc_id`` are ordered by a hash of the text;
rows without a ``doc_id`` stay as they are; chunks with equal names but other bytes stay; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm.common import fresh, map_batches, pieces, texts
from shiftlens.llm.hashing import mix, run_names, span_hashes

WINDOW = 2
MEAN = 2
LEAST = 2  # lines of a chunk


def chunks_of(text: bytes, window: int = WINDOW, mean: int = MEAN, least: int = LEAST, shorter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and end line of each chunk, line start bytes (one more at the end), and chunk names.

    With ``shorter``, the last chunk follows once more without the closing lines that are too few for a chunk of their own.
    """
    data = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], breaks + 1))
    ends = np.concatenate((breaks, [len(data)]))
    full = ends > starts  # an empty line has a fixed hash
    hashes = np.zeros(len(starts), np.uint64)
    hashes[full] = span_hashes(data, starts[full], ends[full])
    rolling = np.zeros(len(hashes), np.uint64)
    for i in range(window):
        rolling[i:] = mix(rolling[i:] + hashes[: len(hashes) - i] * np.uint64(2 * i + 1))
    marks = np.flatnonzero(rolling % np.uint64(mean) == 0) + 1
    first, edges = 0, [0]
    for mark in marks.tolist():
        if mark - first >= least and len(starts) - mark >= least:
            edges.append(mark)
            first = mark
    edges.append(len(starts))
    first, end = np.array(edges[:-1]), np.array(edges[1:])
    cuts = marks[(marks - edges[-2] >= least) & (marks < len(starts))] if shorter else marks[:0]
    if len(cuts):
        first, end = np.append(first, first[-1]), np.append(end, cuts[0])
    return first, end, np.concatenate((starts, [len(data) + 1])), run_names(hashes, first, end)


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).filter("doc_id is not null").withColumn("version", F.xxhash64("text"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of several lines: name, ``doc_id``, ``version`` of its text, ``first`` and ``end`` line."""

    def run(batches):
        for batch in pieces(batches, "text"):
            parts = []
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True):
                first, end, _, (n0, n1) = chunks_of(text.encode(), shorter=True)
                many = end - first >= LEAST
                count = int(many.sum())
                parts.append((n0[many], n1[many], np.full(count, doc), np.full(count, version), first[many], end[many]))
            if parts:
                yield [np.concatenate(c) for c in zip(*parts, strict=True)]

    source = _versions(docs, id_col, text_col).filter(F.col("text").contains("\n"))
    return map_batches(source, run, "n0 long, n1 long, doc_id long, version long, first int, end int")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``version``, ``first``, ``end`` of every chunk to be removed, found equal byte by byte to the first."""
    every = cut(chunks(docs, id_col, text_col), "chunks")
    place = F.struct("doc_id", "version", "first", "end")
    seen = every.groupBy("n0", "n1").agg(F.min(place).alias("keep"), F.max(place).alias("last")).filter("keep <> last").drop("last")
    again = every.join(seen, ["n0", "n1"])
    needed = again.groupBy("doc_id", "version").agg(F.collect_set(F.struct("n0", "n1", "first", "end", F.expr("keep = struct(doc_id, version, first, end)").alias("is_first"))).alias("parts"))
    source = _versions(docs, id_col, text_col).join(needed, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])

    def run(batches):
        for batch in pieces(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            for doc, version, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "parts")), strict=True):
                raw = text.encode()
                _, _, starts, _ = chunks_of(raw)
                for p in parts:
                    row = (p["n0"], p["n1"], doc, version, p["first"], p["end"], p["is_first"], raw[starts[p["first"]] : starts[p["end"]] - 1])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield out

    with_bytes = cut(map_batches(source.select("doc_id", "version", "text", "parts"), run, "n0 long, n1 long, doc_id long, version long, first int, end int, is_first boolean, bytes binary"), "chunkbytes")
    firsts = with_bytes.filter("is_first").select("n0", "n1", F.col("bytes").alias("kept_bytes"))
    return with_bytes.filter("not is_first").join(firsts, ["n0", "n1"]).filter("bytes = kept_bytes").select("doc_id", "version", "first", "end")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the repeated chunks; documents that had nothing else go."""
    doc, version, parts, left = fresh(docs, 4)
    gone = repeated_chunks(docs, id_col, text_col).groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version)).agg(F.collect_set(F.struct("first", "end")).alias(parts))

    @F.pandas_udf("string")
    def without(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([without_lines(t, p) for t, p in zip(texts, found, strict=True)], dtype=object)

    same = (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(version))
    changed = without(F.when(F.col(parts).isNotNull(), F.col(text_col)), parts)  # a function is called for every row; other texts need not go there
    marked = docs.join(gone, same, "left").withColumn(left, F.when(F.col(parts).isNotNull(), changed).otherwise(F.col(text_col)))
    kept = marked.filter(F.col(parts).isNull() | (F.col(left) != ""))
    return kept.select(*(F.col(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def lines_of(parts) -> set[int]:
    """Lines of the chunks ``parts``."""
    return {i for p in (parts if parts is not None else ()) for i in range(p["first"], p["end"])}


def without_lines(text: str, parts) -> str:
    """``text`` without the lines of the chunks ``parts``."""
    gone = lines_of(parts)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc_id``, ``text`` (null stays null), ``n_lines``, ``n_removed``."""

    def run(batches):
        for batch in pieces(batches, "text"):
            out: list[list] = [[] for _ in range(4)]
            for doc, text, null, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "is_null", "parts")), strict=True):
                gone = len(lines_of(parts))
                for column, value in zip(out, (doc, None if null else without_lines(text, parts), text.count("\n") + 1 if text else 0, gone), strict=True):
                    column.append(value)
            yield out

    gone = repeated_chunks(docs, id_col, text_col).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "end")).alias("parts"))
    every = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(text_col).isNull().alias("is_null"))
    marked = every.withColumn("version", F.xxhash64("text")).join(gone, ["doc_id", "version"], "left")
    return map_batches(marked.select("doc_id", "text", "is_null", "parts"), run, "doc_id long, text string, n_lines long, n_removed long")
