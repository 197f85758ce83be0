"""Catalogue rows of four database kinds -> column rows of one snapshot relation.

Inputs are catalogue-shaped DataFrames: a JDBC read, an exported file, or any query.
The schema filter is a plain predicate, so a JDBC or Parquet scan receives it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shiftlens.schemas import SPEC_FIELDS

KEY = ("table_schema", "table_name")


def read_catalogue(spark: SparkSession, url: str, view: str, **options: str) -> DataFrame:
    """One information_schema view over JDBC; later filters and selects are pushed to the database."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=f"information_schema.{view}", **options)
        .load()
    )


def lower_names(df: DataFrame) -> DataFrame:
    """Catalogues that report upper-case view columns, read with the lower-case names."""
    return df.toDF(*[c.lower() for c in df.columns])


def primary_keys(constraints: DataFrame, usage: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """(table_schema, table_name, column_name, ordinal_position) of primary-key columns."""
    pk = constraints.where(
        (F.col("constraint_type") == "PRIMARY KEY") & F.col("table_schema").isin(*schemas)
    ).select("constraint_name", "table_schema", F.col("table_name"))
    used = usage.select("constraint_name", "table_schema", "column_name", "ordinal_position")
    return pk.join(used, ["constraint_name", "table_schema"]).drop("constraint_name")


def constraint_list_keys(constraints: DataFrame, schema: str) -> DataFrame:
    """Primary keys from a catalogue that lists the constrained columns as an array."""
    return constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(
        F.lit(schema).alias("table_schema"),
        "table_name",
        F.posexplode("constraint_column_names").alias("ordinal_position", "column_name"),
    )


def key_arrays(keys: DataFrame) -> DataFrame:
    """Ordered primary-key array per table."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name")))
    return keys.groupBy(*KEY).agg(ordered["column_name"].alias("primary_key"))


def _columns(
    cols: DataFrame,
    keys: DataFrame | None,
    *,
    kind: str,
    source: str | Column,
    data_type: Column,
    nullable: Column,
    default: Column,
    max_length: Column,
    precision: Column,
    scale: Column,
) -> DataFrame:
    if keys is None:
        flagged = cols.withColumn("__pk", F.lit(False))
    else:
        marks = keys.select(*KEY, "column_name", F.lit(True).alias("__pk")).distinct()
        flagged = cols.join(marks, [*KEY, "column_name"], "left")
    source = F.lit(source) if isinstance(source, str) else source
    return flagged.select(
        F.lit(kind).alias("source_kind"),
        source.alias("source_identifier"),
        F.concat_ws(".", *KEY).alias("table_identifier"),
        F.col("column_name").alias("name"),
        data_type.alias("data_type"),
        nullable.alias("nullable"),
        default.alias("default"),
        F.coalesce("__pk", F.lit(False)).alias("is_primary_key"),
        F.col("ordinal_position").cast("int").alias("ordinal_position"),
        max_length.alias("character_max_length"),
        precision.alias("numeric_precision"),
        scale.alias("numeric_scale"),
        F.lit(None).cast("array<string>").alias("enum_values"),
    ).select("source_kind", "source_identifier", "table_identifier", *SPEC_FIELDS)


def _yes(flag: str) -> Column:
    return F.coalesce(F.upper(F.col(flag)) == "YES", F.lit(False))


def _int(name: str) -> Column:
    return F.expr(f"try_cast({name} AS INT)")


def postgres_columns(
    cols: DataFrame, keys: DataFrame, schemas: Sequence[str] = ("source_raw",), source: str | Column = "postgres"
) -> DataFrame:
    """The short type name wins over the long one; only an exact 'YES' is nullable."""
    return _columns(
        cols.where(F.col("table_schema").isin(*schemas)),
        keys,
        kind="postgres",
        source=source,
        data_type=F.coalesce(F.nullif(F.col("udt_name"), F.lit("")), F.col("data_type")),
        nullable=F.coalesce(F.col("is_nullable") == "YES", F.lit(False)),
        default=F.col("column_default"),
        max_length=_int("character_maximum_length"),
        precision=_int("numeric_precision"),
        scale=_int("numeric_scale"),
    )


def duckdb_columns(
    cols: DataFrame, constraints: DataFrame, schema: str = "main", source: str | Column = "duckdb"
) -> DataFrame:
    return _columns(
        cols.where(F.col("table_schema") == schema),
        constraint_list_keys(constraints, schema),
        kind="duckdb",
        source=source,
        data_type=F.lower("data_type"),
        nullable=_yes("is_nullable"),
        default=F.col("column_default").cast("string"),
        max_length=_int("character_maximum_length"),
        precision=_int("numeric_precision"),
        scale=_int("numeric_scale"),
    )


def rebuilt_type(data_type: Column, precision: Column, scale: Column, max_length: Column) -> Column:
    """Type text with its parameters put back from the separate catalogue columns."""
    base = F.lower(data_type)
    number = base.isin("number", "numeric", "decimal") & precision.isNotNull()
    text = base.isin("varchar", "char", "text", "string") & max_length.isNotNull()
    return (
        F.when(number, F.format_string("numeric(%d,%d)", precision, F.coalesce(scale, F.lit(0))))
        .when(text, F.format_string("varchar(%d)", max_length))
        .otherwise(base)
    )


def snowflake_columns(
    cols: DataFrame, keys: DataFrame, schemas: Sequence[str], source: str | Column = "snowflake"
) -> DataFrame:
    cols = lower_names(cols).where(F.col("table_schema").isin(*[s.upper() for s in schemas]))
    p, s, n = _int("numeric_precision"), _int("numeric_scale"), _int("character_maximum_length")
    return _columns(
        cols,
        lower_names(keys),
        kind="snowflake",
        source=source,
        data_type=rebuilt_type(F.col("data_type"), p, s, n),
        nullable=_yes("is_nullable"),
        default=F.col("column_default").cast("string"),
        max_length=n,
        precision=p,
        scale=s,
    )


def bigquery_columns(cols: DataFrame, dataset: str, source: str | Column = "bigquery") -> DataFrame:
    """No defaults and no keys in this catalogue; the dataset names the schema."""
    none_int = F.lit(None).cast("int")
    return _columns(
        cols.withColumn("table_schema", F.lit(dataset)),
        None,
        kind="bigquery",
        source=source,
        data_type=F.lower("data_type"),
        nullable=_yes("is_nullable"),
        default=F.lit(None).cast("string"),
        max_length=none_int,
        precision=none_int,
        scale=none_int,
    )


def snapshot_tables(columns: DataFrame, *keys: str) -> DataFrame:
    """Table rows of a snapshot from its column rows, with the ordered primary-key array."""
    pk = F.collect_list(
        F.when(F.col("is_primary_key"), F.struct("ordinal_position", "name"))
    )
    return columns.groupBy(*keys, "table_identifier").agg(
        F.array_sort(pk)["name"].alias("primary_key"),
        F.array().cast("array<string>").alias("partition_keys"),
    )
