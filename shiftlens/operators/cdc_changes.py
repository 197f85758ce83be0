"""Schema changes in change-data messages: duplicates, in-row diffs, counters.

The batch functions here and the stream in ``shiftlens.streaming.cdc`` share the in-row diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftlens.functions.ranking import chunked_lag
from shiftlens.operators.classify import classify_single
from shiftlens.sources.cdc import FIELD, canonical_schema, field_type, order_columns, topic_table

OFFSETS_PER_CHUNK = 100_000


def mark_changes(decoded: DataFrame, chunk: int = OFFSETS_PER_CHUNK) -> DataFrame:
    """Per decoded message: the schema before it in its topic, and whether it is a change.

    Only the message just before counts, so A, B, A is three changes. A topic is read partition by
    partition, each by offset; offsets are unique in a partition, so a chunk of offsets bounds the
    window whatever share of the rows the topic holds.
    """
    at = order_columns(decoded)
    cell = F.struct(*at[:-1], F.floor(F.col("offset") / chunk).alias("chunk"))
    slim = decoded.select("topic", F.struct(*at).alias("place"), cell.alias("cell"), canonical_schema(F.col("record_schema")).alias("schema"))
    lagged = chunked_lag(slim, ["topic"], F.col("cell"), "place", "schema", "previous")
    return lagged.select("topic", *[F.col(f"place.{c}").alias(c) for c in at], "schema", "previous", (~F.col("schema").eqNullSafe(F.col("previous"))).alias("is_change"))


def _specs(schema: Column) -> Column:
    """Record schema text -> array of column specs."""
    fields = F.from_json(schema, f"struct<fields:array<{FIELD}>>")["fields"]

    def spec(field: Column, at: Column) -> Column:
        data_type, nullable = field_type(field["type"])
        return F.struct(
            field["name"].alias("name"),
            data_type.alias("data_type"),
            F.coalesce(nullable, F.lit(False)).alias("nullable"),
            F.lit(None).cast("string").alias("default"),
            F.lit(False).alias("is_primary_key"),
            at.alias("ordinal_position"),
            F.lit(None).cast("int").alias("character_max_length"),
            F.lit(None).cast("int").alias("numeric_precision"),
            F.lit(None).cast("int").alias("numeric_scale"),
            F.lit(None).cast("array<string>").alias("enum_values"),
        )

    return F.transform(fields, spec)


def _last_named(specs: Column, name: Column) -> Column:
    hits = F.filter(specs, lambda s: s["name"] == name)
    return F.get(hits, F.size(hits) - 1)


def raw_changes(marked: DataFrame, prefix: str = "") -> DataFrame:
    """Column changes of every message that follows another schema of its topic.

    A topic moves between few schemas, so every pair of schemas is read and compared once and
    joined back to its messages. The first schema of a topic has nothing before it and yields nothing.
    """
    pair_of, at = ["topic", "previous", "schema"], order_columns(marked)
    changed = marked.where(F.col("is_change") & F.col("previous").isNotNull()).select(*pair_of, *at)
    both = changed.select(*pair_of).distinct().select(
        *pair_of,
        topic_table(F.col("topic"), prefix).alias("table_identifier"),
        _specs(F.col("previous")).alias("__before"),
        _specs(F.col("schema")).alias("__after"),
    )
    names = F.array_union(F.col("__before.name"), F.col("__after.name"))
    pair = lambda n: F.struct(
        n.alias("name"),
        _last_named(F.col("__before"), n).alias("column_before"),
        _last_named(F.col("__after"), n).alias("column_after"),
    )
    rows = both.select(*pair_of, "table_identifier", F.explode(F.transform(names, pair)).alias("__c")).select(
        *pair_of, "table_identifier", "__c.*"
    )
    b, a = F.col("column_before"), F.col("column_after")
    kind = F.when(b.isNull(), "added").when(a.isNull(), "removed").when(~b.eqNullSafe(a), "modified")
    found = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return changed.join(found, pair_of).select("topic", *at, "table_identifier", "name", "column_before", "column_after", "kind")


def change_events(marked: DataFrame, prefix: str = "") -> DataFrame:
    return classify_single(raw_changes(marked, prefix), ["topic", *order_columns(marked), "table_identifier"], ["name"])


def stream_counters(messages: DataFrame, marked: DataFrame, events: DataFrame) -> DataFrame:
    """Messages, schema changes (the first counts), duplicates and events per topic."""
    seen = messages.groupBy("topic").agg(F.count(F.lit(1)).alias("messages_consumed"))
    changes = marked.groupBy("topic").agg(
        F.count_if("is_change").alias("schema_changes_detected"),
        F.count_if(~F.col("is_change")).alias("duplicates_skipped"),
    )
    emitted = events.groupBy("topic").agg(F.count(F.lit(1)).alias("events_emitted"))
    return seen.join(changes, "topic", "left").join(emitted, "topic", "left").fillna(0)


def bootstrap_changes(current: DataFrame, schemas: DataFrame) -> DataFrame:
    """Topics whose given schema differs from the one held now (or is new); count them for the total."""
    held = current.select("topic", canonical_schema(F.col("record_schema")).alias("__held"))
    given = schemas.withColumn("__given", canonical_schema(F.col("record_schema")))
    return given.join(held, "topic", "left").where(~F.col("__given").eqNullSafe(F.col("__held"))).drop("__given", "__held")
