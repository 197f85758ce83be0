"""Schemas observed in JSON payloads: keys, types and missing share per source and time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


DOCUMENT = "map<string,variant>"


def value_type(value: Column) -> Column:
    """SQL type of one variant value; NULL for a JSON null."""
    seen = F.schema_of_variant(value)
    return (
        F.when(seen == "VOID", F.lit(None).cast("string"))
        .when(seen.startswith("BIGINT"), "bigint")
        .when(seen.startswith("DECIMAL"), "numeric")
        .when(seen == "DOUBLE", "double precision")
        .when(seen == "BOOLEAN", "boolean")
        .when(seen.startswith("ARRAY") | seen.startswith("OBJECT"), "json")
        .otherwise("text")
    )


def observed_columns(rows: DataFrame, source: str, bucket: Column, payload: str) -> DataFrame:
    """One column row per (source, bucket, key).

    The type is the one type seen, or text when several were. A key is nullable when it
    was null or missing in any payload of the bucket. Counts are combined before the
    shuffle, so a hot source costs one row per key and task, not one per payload.
    """
    base = rows.select(
        F.col(source).alias("source_identifier"), bucket.alias("bucket"), F.col(payload).alias("__doc")
    )
    totals = base.groupBy("source_identifier", "bucket").agg(F.count(F.lit(1)).alias("payloads"))
    pairs = base.select(
        "source_identifier", "bucket", F.explode(F.from_json("__doc", DOCUMENT)).alias("name", "__value")
    )
    typed = pairs.select("source_identifier", "bucket", "name", value_type(F.col("__value")).alias("__type"))
    keys = typed.groupBy("source_identifier", "bucket", "name").agg(
        F.count(F.lit(1)).alias("present"),
        F.count("__type").alias("non_null"),
        F.min("__type").alias("__low"),
        F.max("__type").alias("__high"),
    )
    return keys.join(totals, ["source_identifier", "bucket"]).select(
        "source_identifier",
        "bucket",
        "name",
        F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise("text").alias("data_type"),
        (F.col("non_null") < F.col("payloads")).alias("nullable"),
        (1 - F.col("non_null") / F.col("payloads")).alias("missing_share"),
        "payloads",
    )
