"""Token ids as binary files, written in document order and read back.

Documents are range-partitioned and sorted by ``doc_id`` (then by a hash of the text), tokenised, and packed into files
of about ``FILE_IDS`` ids; a document is never split. A file is self-contained: ``MAGIC``, u32 documents, u32 crc32 of the
table, the table (i64 doc_id, u8 known, u32 ids of each), then the ids as ``range_coder`` writes them. Files are
values of a binary column of a table, so Spark commits them, a lost executor's part is written again, and any store
that Spark reads can hold them. ``part`` and ``seq`` give their order.

Between a letter, digit or mark and a character of another kind the byte-level pre-tokeniser always ends a match, so a text
is the concatenation of words that are encoded once each by the library and remembered. Words are named by a hash of their bytes; a name that
stands for two words of different length is found, and those words are encoded again. Both are array operations on many texts at once.

The strings of the definition's added tokens are their ids, as the library gives them: texts are split at them before the words.

Defined cases: null and empty texts have the end id only; a null ``doc_id`` sorts first and stays null; equal rows are all
written; a text larger than a file makes a larger file; an empty table has no file and gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.functions.durable import new_path
from shiftlens.llm import range_coder
from shiftlens.llm.common import map_batches, slices, texts
from shiftlens.llm.hashing import mix, span_hashes

MAGIC = b"TIDF0001"
FILE_IDS = 4_000_000
END = 2
CACHED = 1_500_000  # words that a worker remembers
LONGEST = 1024  # bytes of a remembered word
FILES = "part int, seq int, n_docs long, n_ids long, file binary"

# Classes of bytes: 1 letters, 2 digits, 3 marks, 4 white space, 5 the apostrophe; 0 is anything else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _CLASS[0x30:0x3A], _CLASS[[0x20, *range(0x09, 0x0E)]], _CLASS[0x27] = 1, 2, 4, 5
# Whether a match surely ends between two classes. An apostrophe may begin a contraction with the letter after it.
_ENDS = np.zeros((6, 6), bool)
_ENDS[1, [2, 3, 4, 5]] = _ENDS[2, [1, 3, 4, 5]] = _ENDS[3, [1, 2, 4]] = True
_ENDS[5, [2, 4]] = True


def word_starts(data: np.ndarray) -> np.ndarray:
    """Whether a match of the pre-tokeniser surely begins at each byte but the first, whatever stands elsewhere."""
    kind = _CLASS[data]
    out = _ENDS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    # a space after a character outside ASCII that is no white space, told by the lead bytes of those that are
    at = np.flatnonzero((data[1:] == 0x20) & (data[:-1] >= 0x80)) + 1
    out[at[(data[np.maximum(at - 2, 0)] != 0xC2) & ~np.isin(data[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3))] - 1] = True
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    reached = np.cumsum(count)
    return np.arange(int(reached[-1]) if len(reached) else 0) + np.repeat(first - (reached - count), count)


def _plain(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether words surely begin and end with no white space, but for one leading space, told as by :func:`word_starts`."""
    at = starts + ((data[starts] == 0x20) & (stops - starts > 1))
    lead, last = data[at], data[stops - 1]
    begins = np.where(lead < 0x80, (_CLASS[lead] != 0) & (_CLASS[lead] != 4), ~np.isin(lead, (0xC2, 0xE1, 0xE2, 0xE3)))
    wide = (data[np.maximum(stops - 2, 0)] != 0xC2) & ~np.isin(data[np.maximum(stops - 3, 0)], (0xE1, 0xE2, 0xE3))
    return begins & np.where(last < 0x80, (_CLASS[last] != 0) & (_CLASS[last] != 4), wide)


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def word_names(raw: bytes, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits that name words. Two words of one length up to 8 bytes never share a name; up to 16 bytes are taken as two numbers, longer ones byte by byte."""
    eight = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8")

    def number(at, n):
        shift = (at & 7).astype(np.uint64) << np.uint64(3)
        low, high = eight[at >> 3] >> shift, (eight[(at >> 3) + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (low | high) & _KEEP[n]

    names = mix(number(starts, np.minimum(size, 8)) ^ (size.astype(np.uint64) * _ODD[0]))
    more = np.flatnonzero((size > 8) & (size <= 16))
    names[more] = mix(names[more] + number(starts[more] + 8, size[more] - 8) * _ODD[1])
    long = np.flatnonzero(size > 16)
    names[long] = span_hashes(data, starts[long], starts[long] + size[long])
    return names


class Words:
    """Ids of texts, word by word, with the tokenizers library."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # a word is ordinary text; ``encode_whole`` splits at the added tokens
        added = json.loads(definition).get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space or need whole words are not split at")
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        vocabulary = self.tokenizer.get_vocab()  # one character of a token stands for one byte
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.bits, self.table = 17, np.full(1 << 17, -1, np.int32)  # number of a word at the place its name gives or behind it; -1 is free
        self.words = self.held = 0
        self.names, self.pool = np.empty(1 << 16, np.uint64), np.empty(1 << 18, "<u4")
        self.first, self.count, self.size = (np.empty(1 << 16, kind) for kind in (np.int64, np.int32, np.int32))  # place and number of ids, bytes
        self.again = np.zeros(1 << 16, bool)  # whether it was met again

    def _room(self, words: int, ids: int) -> None:
        """Space behind what is held."""
        while self.words + words > len(self.names):
            for what in ("names", "first", "count", "size", "again"):
                old = getattr(self, what)
                setattr(self, what, np.concatenate((old, np.zeros(len(old), old.dtype))))
        while self.held + ids > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), "<u4")))

    def _shrink(self) -> None:
        """Only words that were met again stay; none, if those are most."""
        stay = np.flatnonzero(self.again[: self.words])
        names, count, size = self.names[stay], self.count[stay], self.size[stay]
        ids = self.pool[_ranges(self.first[stay], count)]
        self.forget()
        if len(stay) <= CACHED // 2:
            self._add(names, ids, count, size)

    def _ids(self, words: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _encode_words(self, raw: bytes, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the number of each.

        Words with no white space at their ends go to the library together, each after a line break: that is a match of its own
        before a word or before its leading space.
        """
        plain = _plain(data, starts, stops)
        together, alone = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        count, order, parts = np.zeros(len(starts), np.int64), [], [np.empty(0, "<u4")]
        for at in range(0, len(together), 4096):
            some = together[at : at + 4096]
            size = stops[some] - starts[some] + 1
            ends = np.cumsum(size)
            text = data[_ranges(starts[some] - 1, size)]
            text[ends - size] = 0x0A
            ids = self._ids([text.tobytes()])[0]
            reached = np.cumsum(self.bytes_of[ids])
            breaks = np.searchsorted(reached, np.concatenate(([0], ends[:-1])) + 1)
            cuts = np.searchsorted(reached, ends)
            if cuts[-1] != len(ids) - 1 or (reached[cuts] != ends).any() or (self.bytes_of[ids[breaks]] != 1).any():
                alone.append(some)  # a token over two words
                continue
            count[some] = cuts - breaks
            parts.append(np.delete(ids, breaks))
            order.append(some)
        alone = np.concatenate(alone)
        for i, ids in zip(alone.tolist(), self._ids([raw[a:b] for a, b in zip(starts[alone].tolist(), stops[alone].tolist(), strict=True)]), strict=True):
            count[i] = len(ids)
            parts.append(ids)
        order = np.concatenate((*order, alone))
        # back into the order of the words
        ids, first = np.concatenate(parts), np.zeros(len(starts), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return ids[_ranges(first, count)], count

    def _add(self, names: np.ndarray, ids: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of words that are not held yet, of different names."""
        self._room(len(names), len(ids))
        number = np.arange(self.words, self.words + len(names))
        self.names[number], self.count[number], self.size[number], self.again[number] = names, count, size, False
        self.first[number] = self.held + np.cumsum(count) - count
        self.pool[self.held : self.held + len(ids)] = ids
        self.words, self.held = self.words + len(names), self.held + len(ids)
        if 2 * self.words > len(self.table):  # half of it stays free
            self.bits = int(2 * self.words).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(self.words))
        else:
            self._place(number)
        return number

    def _place(self, left: np.ndarray) -> None:
        """Words, by number, into the table: at the first free place from their own."""
        slot = (self.names[left] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & (len(self.table) - 1)

    def _known(self, names: np.ndarray) -> np.ndarray:
        """Numbers of the words held under these names, else -1."""
        slot = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.table[slot]
        other = np.flatnonzero((found >= 0) & (self.names[found] != names))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.table) - 1)
            found[other] = at = self.table[slot[other]]
            other = other[(at >= 0) & (self.names[at] != names[other])]
        return found

    def encode(self, texts: list[bytes], tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``tail``, one after the other, and the number of each."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        begins = ends - size
        mark = np.zeros(len(data) + 1, bool)
        if len(data):
            mark[1:-1] = word_starts(data)
        mark[begins] = True
        starts = np.flatnonzero(mark[: len(data)])
        stops = np.append(starts[1:], len(data))[: len(starts)]
        size = stops - starts
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero(size <= LONGEST)
        names = word_names(raw, data, starts[short], size[short])
        if self.words > CACHED:
            self._shrink()
        at = self._known(names)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, one, which = np.unique(names[new], return_index=True, return_inverse=True)
            one = short[new[one]]
            at[new] = self._add(fresh, *self._encode_words(raw, data, starts[one], stops[one]), size[one])[which]
        self.again[at[:0] if len(new) == len(at) else np.delete(at, new)] = True
        first[short], count[short] = self.first[at], self.count[at]
        clash = np.zeros(len(starts), bool)
        clash[short] = self.size[at] != size[short]
        alone = np.flatnonzero(clash | (size > LONGEST))
        extra, count[alone] = self._encode_words(raw, data, starts[alone], stops[alone])
        first[alone] = self.held + np.cumsum(count[alone]) - count[alone]
        # behind the words' ids, until the next call
        self._room(0, len(extra) + len(tail))
        self.pool[self.held : self.held + len(extra) + len(tail)] = np.concatenate((extra, tail))
        after = np.searchsorted(starts, ends)  # the tail's place among the words
        first, count = np.insert(first, after, self.held + len(extra)), np.insert(count, after, len(tail))
        upto = np.cumsum(count)[after + np.arange(len(texts))]
        return self.pool[_ranges(first, count)], np.diff(upto, prepend=0)

    def encode_whole(self, texts: list[bytes], tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts in which the strings of added tokens are their ids."""
        if not any(token in text for text in texts for token in self.added):
            return self.encode(texts, tail)
        parts, after, first = [], [], []  # parts between added tokens, the ids behind each, and the first part of each text
        for text in texts:
            first.append(len(parts))
            at = 0
            for m in self.added_pattern.finditer(text):
                parts.append(text[at : m.start()])
                after.append([self.added[m[0]]])
                at = m.end()
            parts.append(text[at:])
            after.append(tail)
        ids, count = self.encode(parts, tail[:0])
        more = np.fromiter(map(len, after), np.int64, len(after))
        ids = np.insert(ids, np.repeat(np.cumsum(count), more), np.concatenate(after))
        return ids, np.add.reduceat(count + more, first)


@lru_cache(maxsize=1)
def words_of(definition: str) -> Words:
    """One for all tasks of a worker, so that a word is encoded once."""
    return Words(definition)


_ROW = np.dtype([("doc", "<i8"), ("known", "u1"), ("n", "<u4")])


def pack(docs: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents and their ids."""
    table = np.zeros(len(docs), _ROW)
    table["doc"], table["known"], table["n"] = [d or 0 for d in docs], [d is not None for d in docs], counts
    head = table.tobytes()
    return MAGIC + struct.pack("<II", len(docs), zlib.crc32(head)) + head + range_coder.encode(ids)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, the number of ids of each, and all ids of a file; raises if a checksum is wrong."""
    n, check = struct.unpack_from("<II", data, 8)
    end = 16 + _ROW.itemsize * n
    if data[:8] != MAGIC or zlib.crc32(data[16:end]) != check:
        raise ValueError("not a file of documents, or its table is damaged")
    table = np.frombuffer(data[16:end], _ROW)
    docs = [d if k else None for d, k in zip(table["doc"].tolist(), table["known"].tolist(), strict=True)]
    return docs, table["n"].astype(np.int64), range_coder.decode(data[end:]).astype("<u4")


def token_files(docs: DataFrame, path: str | None = None, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as files in ascending order of ``doc_id``. ``path``: the tokenizer's definition, read by the driver."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json")) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a few MB
    tail = np.array([] if end is None else [end], "<u4")

    def run(batches):
        words, part, seq = words_of(shared.value), TaskContext.get().partitionId(), 0
        docs, counts, held, size = [], [], [], 0

        def file():
            return [[part], [seq], [len(docs)], [size], [pack(docs, np.concatenate(counts), np.concatenate(held))]]

        for batch in batches:
            for start, stop in slices(batch, "text"):
                text = batch.column("text").slice(start, stop - start).cast(pa.binary()).to_pylist()
                ids, count = words.encode_whole(text, tail)
                docs += batch.column("doc_id").slice(start, stop - start).to_pylist()
                counts.append(count)
                held.append(ids)
                size += len(ids)
                if size >= FILE_IDS:
                    yield file()
                    docs, counts, held, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield file()

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return map_batches(ordered, run, FILES)


def write_files(docs: DataFrame, folder: str | None = None, **options) -> str:
    """Write the files to ``folder`` (else a new one in the shared folder) and return it."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    token_files(docs, **options).write.parquet(folder)
    return folder


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``ids`` of every document of the files."""
    files = spark.read.schema(FILES).parquet(folder)
    in_part = files.select("part", "seq", "n_ids", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in_part"))
    # one row for each task that wrote
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = in_part.join(parts, "part").select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("in_part")).alias("base"))

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file")), strict=True):
                docs, counts, ids = unpack(data)
                starts, raw = np.concatenate(([0], np.cumsum(counts))), ids.tobytes()
                for group in range(0, len(docs), 1024):
                    some, edge = docs[group : group + 1024], starts[group : group + 1025].tolist()
                    yield [[part] * len(some), [seq] * len(some), some, edge[:-1], [raw[4 * a : 4 * b] for a, b in zip(edge[:-1], edge[1:], strict=True)]]

    rows = map_batches(files.select("part", "seq", "file"), run, "part int, seq int, doc_id long, in_file long, ids binary")
    # one row of a few bytes for each file of millions of ids: sent to the ids, which then move nowhere
    both = rows.join(F.broadcast(placed), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    return both.select("doc_id", (F.col("base") + F.col("in_file")).alias("start"), "ids")


def checksums(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
