"""A training corpus from raw documents: five stages, each an operator of the library.

``run`` writes each stage's rows to the shared folder and reads them again as the next one's documents, so a lost
executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut
from shiftlens.llm import bpe, decontaminate, language, line_dedup, near_dup
from shiftlens.llm.common import table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; text without a letter and undecided text go."""
    return language.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line chunks that occurred before; what is left has its length in n_chars."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the bytes they decode to."""
    return bpe.digests(bpe.decode(bpe.encode(docs)), "ids")


STAGES = [("languages", languages), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("tokens", tokens)]

#: Models, sketches and merges are not SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
