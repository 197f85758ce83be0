"""Relations, enumerations and fixed values shared by every operator.

Every operator takes and returns DataFrames with the columns listed here.
Monitored schemas are data: a monitored column is a row, its type is a string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- column spec ------------------------------------------------------------

COLUMN_SPEC = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("default", T.StringType()),
        T.StructField("is_primary_key", T.BooleanType()),
        T.StructField("ordinal_position", T.IntegerType()),
        T.StructField("character_max_length", T.IntegerType()),
        T.StructField("numeric_precision", T.IntegerType()),
        T.StructField("numeric_scale", T.IntegerType()),
        T.StructField("enum_values", T.ArrayType(T.StringType())),
    ]
)
SPEC_FIELDS = tuple(COLUMN_SPEC.fieldNames())

# snapshots(source_kind, source_identifier, snapshot_id, captured_at)
SNAPSHOT_KEYS = ("source_identifier", "snapshot_id")
# snapshot_tables(source_identifier, snapshot_id, table_identifier, primary_key, partition_keys)
TABLE_KEYS = (*SNAPSHOT_KEYS, "table_identifier")

RAW_CHANGE = T.StructType(
    [
        T.StructField("table_identifier", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("column_before", COLUMN_SPEC),
        T.StructField("column_after", COLUMN_SPEC),
    ]
)

SCENARIO = T.StructType(
    [
        T.StructField("scenario_id", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("expected_change_type", T.StringType()),
        T.StructField("expected_severity", T.StringType()),
        T.StructField("pre_columns", T.ArrayType(COLUMN_SPEC)),
        T.StructField("raw_changes", T.ArrayType(RAW_CHANGE)),
        T.StructField("variant", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("notes", T.ArrayType(T.StringType())),
    ]
)

# --- fixed values -----------------------------------------------------------

SOURCE_KINDS = ("postgres", "duckdb", "rest_api", "kafka", "debezium", "snowflake", "bigquery")
ACTIONS = ("ignore", "alert_only", "open_draft_pr", "open_pr")
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}

# Severity each change type starts from; an event may be raised above it, never lowered.
SEVERITY = {
    "column_added_nullable": "low",
    "column_added_not_null": "low",
    "column_added_not_null_no_default": "medium",
    "column_dropped": "high",
    "type_widened": "low",
    "type_narrowed": "high",
    "type_incompatible": "high",
    "column_renamed": "high",
    "precision_changed": "medium",
    "pk_changed": "high",
    "enum_value_added": "low",
    "default_changed": "medium",
    "nullability_tightened": "medium",
    "partition_key_changed": "high",
}
# Never merged without a human.
DESTRUCTIVE = (
    "column_dropped",
    "type_narrowed",
    "type_incompatible",
    "pk_changed",
    "partition_key_changed",
)
NEEDS_BACKFILL = (
    "column_added_not_null",
    "column_added_not_null_no_default",
    "type_narrowed",
    "type_incompatible",
    "nullability_tightened",
)

# --- literal lookups --------------------------------------------------------


def lookup(mapping: dict, key: Column) -> Column:
    """Small fixed dictionary as a codegen'd map literal (NULL when absent)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[key]


def severity_of(change_type: Column) -> Column:
    return lookup(SEVERITY, change_type)


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_RANK, severity)


def spec_struct(prefix: str = "") -> Column:
    """Column-spec struct from flat columns named like the spec fields."""
    return F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in SPEC_FIELDS])


def spec_of(fields: dict[str, Column]) -> Column:
    """Column-spec struct from the given fields; the others are NULL."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COLUMN_SPEC.fields])
