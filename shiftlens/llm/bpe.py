"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks of ``CHUNK`` characters that reach ``OVERLAP`` characters into the next one. All
chunks of all documents are pre-tokenised in parallel, each from its own start. A match depends only on the text
that follows it, so where two neighbours have a boundary in common, both go on alike: there the chunks are stitched,
and the pieces between the stitches are encoded in parallel and joined by their number. A boundary counts only if the
match before it ended before its chunk did, and if no white space stands before it: matches of white space look at the
character after them, which a piece that ends there no longer has. Where an overlap holds no common boundary (one match
longer than the overlap), the rest of that document from the last stitch on is one piece.

Each match of the pattern is encoded separately: merges of lowest rank first, leftmost among equals. Decoding
concatenates the raw bytes of the ids.

Ids are little-endian unsigned 32-bit integers in a binary column.

Defined cases: null and empty text have no ids; equal rows (doc_id and text) are encoded alike and each has its row;
a document of at most one chunk has nothing to stitch and is never shuffled; a null doc_id is kept; ids unknown to the
vocabulary cannot be decoded and raise; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm.common import map_batches, texts

CHUNK, OVERLAP = 16_384, 256
CACHED = 300_000  # distinct matches that a task remembers


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Ranks of a vocabulary file; a few MB, read by the driver and broadcast."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Cache(dict):
    """Encoded matches by match."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, match: str) -> bytes:
        raw = match.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        out = np.array([rank] if rank is not None else merged(raw, self.ranks), "<u4").tobytes()
        if len(match) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[match] = out
        return out


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the pair of lowest rank merges first, leftmost among equals."""
    size = len(raw)
    end = list(range(1, size + 1))  # end of the part that begins here
    before = list(range(-1, size - 1))  # begin of the part before
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * size
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = end[i]
        if j >= size or end[j] != stop or j == stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < size:
            before[stop] = i
            if (r := ranks.get(raw[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[raw[i : end[i]]] for i in range(size) if alive[i]]


class Encoder:
    """A vocabulary and a pattern, compiled in a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern, self.cache = regex.compile(pattern), _Cache(ranks)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.token = {rank: token for token, rank in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def boundaries(pattern, chunk: str, last: bool) -> tuple[list[int], list[int]]:
    """Match starts in the first ``OVERLAP`` characters, and those sure ones from ``CHUNK`` on, counted from there."""
    head, tail = [], []
    for m in pattern.finditer(chunk):
        at = m.start()
        if at < OVERLAP:
            head.append(at)
        if at >= CHUNK and not last and not chunk[at - 1].isspace():
            tail.append(at - CHUNK)
    return head, tail


def _chunks(long_docs: DataFrame) -> DataFrame:
    """``doc_id``, ``version`` of the text, ``k``, ``last``, ``chunk``; spread over tasks by all three keys."""

    def run(batches):
        for batch in batches:
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True):
                starts = range(0, len(text), CHUNK)
                for group in range(0, len(starts), 256):  # rows of one very long text go out in groups
                    part = starts[group : group + 256]
                    n = len(part)
                    yield [[doc] * n, [version] * n, [a // CHUNK for a in part], [a + CHUNK >= len(text) for a in part], [text[a : a + CHUNK + OVERLAP] for a in part]]

    out = map_batches(long_docs, run, "doc_id long, version long, k int, last boolean, chunk string")
    return out.repartition("doc_id", "version", "k")


def _stitches(chunked: DataFrame, pattern: str) -> DataFrame:
    """``cut``: where chunk k takes over from chunk k - 1, counted from its start; null where they don't meet."""

    def run(batches):
        compiled = regex.compile(pattern)
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("doc_id", "version", "k", "last")]
            found = [boundaries(compiled, c, last) for c, last in zip(batch.column("chunk").to_pylist(), keys[3], strict=True)]
            yield [*keys, [h for h, _ in found], [t for _, t in found]]

    edges = map_batches(chunked, run, "doc_id long, version long, k int, last boolean, head array<int>, tail array<int>")
    order = Window.partitionBy("doc_id", "version").orderBy("k")
    meets = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head"))))
    met = edges.select("doc_id", "version", "k", "last", meets.alias("met"))
    sure = F.min(F.col("met").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    met = met.select("doc_id", "version", "k", "last", F.when(sure, F.col("met")).alias("cut"))
    ahead = F.lead("cut").over(order)
    return met.select("doc_id", "version", "k", "last", "cut", ahead.alias("next_cut"), F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"))


def pieces(docs: DataFrame, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``version``, ``piece``, ``text``: the stitched pieces of texts longer than a chunk."""
    chunked = cut(_chunks(docs.filter(F.length("text") > CHUNK).dropDuplicates(["doc_id", "version"])), "chunks")
    placed = _stitches(chunked, pattern).withColumnsRenamed({"doc_id": "d", "version": "v", "k": "n"}).drop("last")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("k") == F.col("n"))
    start = F.coalesce("cut", F.lit(0))
    end = F.when(F.col("last"), F.length("chunk")).otherwise(F.lit(CHUNK) + F.coalesce("next_cut", F.lit(0)))
    own = chunked.join(placed, same).select("doc_id", "version", "piece", "k", F.col("chunk").substr(start + 1, end - start).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("k", "part")))
    return own.groupBy("doc_id", "version", "piece").agg(F.concat_ws("", F.transform(parts, lambda x: x["part"])).alias("text"))


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (binary) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in batch.schema.names if c != "text"]
            yield [*keys, [encoder.encode(x) for x in batch.column("text").to_pylist()]]

    whole = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    short = map_batches(whole.filter(F.length("text") <= CHUNK).select("doc_id", "text"), run, "doc_id long, ids binary")
    coded = map_batches(pieces(whole, pattern), run, "doc_id long, version long, piece long, ids binary")
    joined = coded.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    rows = whole.filter(F.length("text") > CHUNK).select(F.col("doc_id").alias("d"), F.col("version").alias("v"))
    long = rows.join(joined, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc_id", "parts")

    def join(batches):
        for batch in batches:
            yield [batch.column("doc_id").to_pylist(), [b"".join(p["ids"] for p in row) for row in batch.column("parts").to_pylist()]]

    return short.union(map_batches(long, join, "doc_id long, ids binary"))


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the ``bytes`` that they stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks or read_ranks())

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids = batch.column("ids").slice(at, 1024).to_pylist()
                yield [batch.column("doc_id").slice(at, 1024).to_pylist(), ids, [decoder.decode(x) for x in ids]]

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, bytes binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Token count, SHA-256 digests of ids and decoded bytes, and ``more`` columns."""
    return decoded.select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), *more)


