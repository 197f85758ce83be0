"""Small helpers of the pipeline operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` long and ``text`` string (null: empty), so no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, names = {c.lower() for c in df.columns}, []
    for i in range(count + len(taken)):
        if f"own_{i}" not in taken and len(names) < count:
            names.append(f"own_{i}")
    return names


def runs(sizes: Iterable[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most ``most``; a larger one is alone."""
    start = held = stop = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
        stop = i + 1
    if stop:
        yield start, stop


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes together; a longer text is alone."""
    return runs(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), most)


def pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut at :func:`slices`, so that what a task makes of a piece has its size, not that of 10,000 texts."""
    for batch in batches:
        for start, stop in slices(batch, column):
            yield batch.slice(start, stop - start)


def map_batches(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """``fn`` gets a list of column lists per record batch and returns or yields lists of column lists."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)
