"""Change-data messages (topic, offset, value JSON) -> record schemas -> column rows.

The JSON is read by Spark's own functions; no row reaches Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Avro primitive -> SQL type; anything else is text.
AVRO_TO_SQL = {
    "int": "integer",
    "long": "bigint",
    "float": "real",
    "double": "double precision",
    "string": "text",
    "boolean": "boolean",
    "bytes": "bytea",
}

FIELD = "struct<name:string,type:string>"


def topic_table(topic: Column, prefix: str) -> Column:
    """``prefix`` removed when the topic starts with it, else the last two dot segments."""
    parts = F.split(topic, r"\.")
    last_two = F.when(
        F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")
    ).otherwise(topic)
    if not prefix:
        return last_two
    rest = F.substring(topic, F.lit(len(prefix) + 1), F.length(topic))
    return F.when(topic.startswith(prefix), rest).otherwise(last_two)


def decode(messages: DataFrame) -> DataFrame:
    """Keep messages that carry a record schema, as ``record_schema`` JSON and its ``fields``.

    A ``schema`` key decides when present, even when it holds no fields; tombstones and
    payloads without fields are dropped. Outside a stream each distinct schema is read once.
    """
    wrapped = F.array_contains(F.json_object_keys("value"), "schema")
    schema = F.when(wrapped, F.get_json_object("value", "$.schema")).otherwise(F.col("value"))
    found = messages.where(F.col("value").isNotNull()).withColumn("record_schema", schema)
    if messages.isStreaming:  # a stream is read once, so its rows are parsed where they stand
        return found.withColumn("fields", _fields(F.col("record_schema"))).where(F.size("fields") > 0)
    return found.join(schema_registry(found), "record_schema").select(*found.columns, "fields")


def _fields(record_schema: Column) -> Column:
    return F.from_json(record_schema, f"struct<fields:array<{FIELD}>>")["fields"]


def schema_registry(messages: DataFrame) -> DataFrame:
    """(record_schema, fields): every distinct schema text that has fields, parsed once.

    Texts are combined by each task before the shuffle: messages are very many, their schemas few. Spark broadcasts the
    registry if its measured size allows, and splits hot schemas otherwise.
    """
    texts = messages.select("record_schema").distinct()
    return texts.withColumn("fields", _fields(F.col("record_schema"))).where(F.size("fields") > 0)


def _scalar_sql(avro: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in AVRO_TO_SQL.items() for x in kv])[avro]
    return F.coalesce(named, F.lit("text"))


def _object_sql(avro: Column) -> Column:
    logical = F.get_json_object(avro, "$.logicalType")
    precision = F.coalesce(F.get_json_object(avro, "$.precision"), F.lit("38"))
    scale = F.coalesce(F.get_json_object(avro, "$.scale"), F.lit("0"))
    base = F.coalesce(F.get_json_object(avro, "$.type"), F.lit("string"))
    return (
        F.when(logical == "decimal", F.concat(F.lit("numeric("), precision, F.lit(","), scale, F.lit(")")))
        .when(logical.isin("timestamp-millis", "timestamp-micros"), F.lit("timestamp"))
        .when(logical == "date", F.lit("date"))
        .otherwise(_scalar_sql(base))
    )


def _typed_sql(avro: Column) -> Column:
    return F.when(avro.startswith("{"), _object_sql(avro)).otherwise(_scalar_sql(avro))


def field_type(raw: Column) -> tuple[Column, Column]:
    """(SQL type, nullable) of one Avro ``type`` given as raw JSON text or a bare name."""
    is_union = raw.startswith("[")
    branches = F.from_json(raw, "array<string>")
    real = F.filter(branches, lambda b: b != "null")
    first = F.when(F.size(real) > 0, real[0]).otherwise(F.lit("string"))
    nullable = is_union & (F.size(real) != F.size(branches))
    return F.when(is_union, _typed_sql(first)).otherwise(_typed_sql(raw)), nullable


def avro_columns(decoded: DataFrame, prefix: str = "") -> DataFrame:
    """One column row per field of each decoded message; ordinals start at 0. Types are found once per distinct schema."""
    data_type, nullable = field_type(F.col("__field.type"))
    columns = schema_registry(decoded).select("record_schema", F.posexplode("fields").alias("ordinal_position", "__field")).select(
        "record_schema", "ordinal_position", F.col("__field.name").alias("name"), data_type.alias("data_type"), F.coalesce(nullable, F.lit(False)).alias("nullable")
    )
    kept = [c for c in decoded.columns if c not in ("value", "record_schema", "fields")]
    return decoded.select(*kept, "record_schema").join(columns, "record_schema").select(
        *kept,
        topic_table(F.col("topic"), prefix).alias("table_identifier"),
        "name",
        "data_type",
        "nullable",
        F.lit(None).cast("string").alias("default"),
        F.lit(False).alias("is_primary_key"),
        "ordinal_position",
        F.lit(None).cast("int").alias("character_max_length"),
        F.lit(None).cast("int").alias("numeric_precision"),
        F.lit(None).cast("int").alias("numeric_scale"),
        F.lit(None).cast("array<string>").alias("enum_values"),
    )


def canonical_schema(record_schema: Column) -> Column:
    """Key-order-free text of a record schema: equal texts mean structurally equal schemas.

    A lenient message whose schema is no strict JSON is compared as it is written.
    """
    return F.coalesce(F.to_json(F.try_parse_json(record_schema)), record_schema)


def order_columns(messages: DataFrame) -> list[str]:
    """Columns that put the messages of a topic in order: the offset, within its partition where there is one."""
    return ["partition", "offset"] if "partition" in messages.columns else ["offset"]


def current_schemas(decoded: DataFrame) -> DataFrame:
    """Latest decoded schema of each topic (partial aggregation; no window)."""
    at = order_columns(decoded)
    newest = F.max(F.struct(*at, "record_schema"))
    return (
        decoded.groupBy("topic")
        .agg(newest.alias("__newest"))
        .select("topic", *[F.col(f"__newest.{c}").alias(c) for c in (*at, "record_schema")])
        .withColumn("fields", _fields(F.col("record_schema")))
    )
