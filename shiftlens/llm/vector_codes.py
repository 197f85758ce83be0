"""Product codes of vectors by dictionaries of the integers that each dimension holds.

Components become integers, floor(``SCALE`` * x), and a vector is cut into ``PARTS`` equal parts, each coded by the nearest
of ``ENTRIES`` codebook entries. Rows are stored once in blocks of at most ``BLOCK`` vectors: for every dimension the
block's distinct integers (its dictionary) and one dictionary index a vector. A round tabulates, dimension by dimension,
the squared difference of every dictionary value to that dimension of every entry; a vector's distance to the entries of a
part is then a gather of table rows by its indexes and a few adds, whatever the values. Tables have at most a block's rows,
so memory is bounded however many distinct values a dimension has in all.

A round sends only sums and counts, one row for each entry and dimension of a task, added up by Spark; the codebooks, the
only thing that reaches the driver, have ``PARTS * ENTRIES`` short rows.

Defined cases: vectors that are null, empty, hold null or non-finite components, or have another length than the most common
that ``PARTS`` divides (the smallest of equally common ones) take no part, nor those with an integer beyond
``limit(length)``, whose squared distance may not fit a long. Zero vectors and repeated rows take part like any other; rows
with a null id are coded, but never start an entry. The starting entries are those of the smallest ids, equal ids by vector;
with fewer rows there are fewer entries. Ties go to the lower entry. Null labels are one label. Other columns of the table
are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.functions.durable import cut
from shiftlens.llm.common import map_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK = 8192


def limit(length: int) -> int:
    """The largest integer component whose vector's squared distance to any other surely fits a long."""
    return isqrt((2**63 - 1) // max(length, 1)) // 2


def kept_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` of the rows that are coded."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    size = F.size("vector")
    rows = rows.filter((size > 0) & (size % PARTS == 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.groupBy(size.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).select("n")
    length = sizes.first()
    if length is None:
        return rows.limit(0)
    most = limit(length["n"])
    return rows.filter((size == length["n"]) & ~F.exists("vector", lambda x: F.abs(F.floor(x * SCALE)) > most))


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows in blocks: ids and labels, each dimension's dictionary, and the vectors' indexes into it, dimension by dimension."""
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
            T.StructField("dictionaries", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("indexes", T.BinaryType()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = np.floor(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) * SCALE).astype(np.int64)
                dictionaries, indexes = [], np.empty(values.T.shape, np.uint16)
                for d, column in enumerate(values.T):
                    found, indexes[d] = np.unique(column, return_inverse=True)
                    dictionaries.append(found)
                yield [[part.column("vec_id").to_pylist()], [part.column("label").to_pylist()], [dictionaries], [indexes.tobytes()]]

    return map_batches(rows, build, schema)


def assign(dictionaries: list[np.ndarray], indexes: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every vector in every part, and its squared distance: both parts x vectors.

    ``indexes`` is dimensions x vectors, ``codebooks`` parts x entries x dimensions of a part.
    """
    parts, entries, width = codebooks.shape
    nearest, apart = np.empty((parts, indexes.shape[1]), np.uint8), np.empty((parts, indexes.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((indexes.shape[1], entries), np.int64)
        for d in range(width):
            table = (dictionaries[p * width + d][:, None] - codebooks[p, :, d][None, :]) ** 2
            distance += table[indexes[p * width + d]]
        nearest[p] = distance.argmin(axis=1)
        apart[p] = distance[np.arange(len(distance)), nearest[p]]
    return nearest, apart


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    for i in range(batch.num_rows):
        dictionaries = [np.asarray(x, np.int64) for x in batch.column("dictionaries")[i].as_py()]
        yield i, dictionaries, np.frombuffer(batch.column("indexes")[i].as_buffer(), np.uint16).reshape(len(dictionaries), -1)


def _sums(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``part``, ``entry``, ``place``, ``total``, ``n``: sums and numbers of the parts assigned to each entry."""
    parts, entries, width = codebooks.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total, n = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, dictionaries, indexes in _opened(batch):
                nearest, _ = assign(dictionaries, indexes, codebooks)
                for p in range(parts):
                    n[p] += np.bincount(nearest[p], minlength=entries)
                    for d in range(width):
                        # how often each dictionary value meets each entry, then one product a value
                        values = dictionaries[p * width + d]
                        met = np.bincount(nearest[p].astype(np.int64) * len(values) + indexes[p * width + d], minlength=entries * len(values))
                        total[p, :, d] += met.reshape(entries, -1) @ values
        part, entry, place = np.indices(total.shape)
        used = np.repeat(n.ravel(), width) > 0
        columns = [part.ravel(), entry.ravel(), place.ravel(), total.ravel(), np.repeat(n.ravel(), width)]
        yield [c[used].tolist() for c in columns]

    found = map_batches(blocks.select("dictionaries", "indexes"), add, "part int, entry int, place int, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))


def learn(rows: DataFrame, blocks: DataFrame) -> np.ndarray:
    """The codebooks, parts x entries x dimensions of a part, after all rounds."""
    first = rows.filter("vec_id is not null").orderBy("vec_id", "vector").limit(ENTRIES).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64)
    start = np.floor(np.array([r["vector"] for r in first]) * SCALE).astype(np.int64)
    codebooks = start.reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for r in _sums(blocks, codebooks).collect():  # at most as many rows as the codebooks have components
            codebooks[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return codebooks


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, ``label``, ``code`` binary with a byte a part, ``error`` long of every coded row; the codebooks)."""
    rows = kept_rows(vectors, id_col, vector_col, label_col)
    blocks = cut(blocks_of(rows), "blocks")
    codebooks = learn(rows, blocks)
    schema = T.StructType([*rows.select("vec_id", "label").schema.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for i, dictionaries, indexes in _opened(batch):
                nearest, apart = assign(dictionaries, indexes, codebooks)
                yield [batch.column("ids")[i].as_py(), batch.column("labels")[i].as_py(), [x.tobytes() for x in np.ascontiguousarray(nearest.T)], apart.sum(axis=0)]

    return map_batches(blocks if codebooks.size else blocks.limit(0), code, schema), codebooks


def decode(coded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vec_id`` and ``vector``: the entries that a code names, in the scale of the original vectors."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            codes = np.array([list(x) for x in batch.column("code").to_pylist()], np.int64).reshape(batch.num_rows, len(codebooks))
            vectors = np.concatenate([book[codes[:, p]] for p, book in enumerate(codebooks)], axis=1) / SCALE
            yield [batch.column("vec_id").to_pylist(), vectors.tolist()]

    return map_batches(coded.select("vec_id", "code"), rebuild, "vec_id long, vector array<double>")


def code_table(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error``, ``codebooks_sha256`` of every coded row."""
    coded, codebooks = compress(vectors)
    coded = cut(coded, "codes")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    of_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
