"""File-based inputs: Parquet footers, scenario corpora, dashboard cards, lineage manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shiftlens.schemas import SCENARIO

# --- Parquet footers --------------------------------------------------------

_FOOTER = (
    "path string, table_identifier string, name string, data_type string, nullable boolean, "
    "ordinal_position int"
)

# Arrow type text -> SQL type; anything else keeps the Arrow text.
ARROW_TO_SQL = {
    "int8": "smallint",
    "int16": "smallint",
    "int32": "integer",
    "int64": "bigint",
    "float": "real",
    "double": "double precision",
    "string": "text",
    "large_string": "text",
    "bool": "boolean",
    "date32[day]": "date",
    "binary": "bytea",
}


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for path, table in zip(batch["path"], batch["table_identifier"], strict=True):
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as handle:
                schema = pq.read_schema(handle)
            for pos, field in enumerate(schema):
                text = str(field.type)
                kind = "timestamp" if text.startswith("timestamp") else ARROW_TO_SQL.get(text, text)
                rows.append((path, table, field.name, kind, field.nullable, pos))
        yield pd.DataFrame(
            rows, columns=["path", "table_identifier", "name", "data_type", "nullable", "ordinal_position"]
        )


def lake_columns(spark: SparkSession, folder: str, table: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Catalogue rows of every Parquet file under ``folder``; footers are read on the executors.

    The listing is a DataFrame of paths, the file bytes are never loaded by Spark, and each
    task opens only the footers of its own paths. The files of a folder named ``x.parquet`` are the table ``x``.
    """
    paths = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
        .select("path", "length")
    )
    if table is None:
        folder_name = F.nullif(F.regexp_extract("path", r"^.*/([^/]+)\.parquet/", 1), F.lit(""))
        table = F.coalesce(folder_name, F.regexp_extract("path", r"([^/]+?)(?:/[^/]+=[^/]+)*/?(?:part-[^/]*)?\.parquet$", 1))
    listed = paths.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    listed = listed.withColumn("table_identifier", table)
    listed = listed.repartition(tasks) if tasks else listed.repartition("path")
    return listed.mapInPandas(_read_footers, _FOOTER)


# --- scenario corpus --------------------------------------------------------


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIO).option("multiLine", "true").json(path)


def scenarios_of(documents: DataFrame) -> DataFrame:
    """The scenarios of the lists in ``text``, a row each."""
    return documents.select(F.explode(F.from_json("text", T.ArrayType(SCENARIO))).alias("s")).select("s.*")


def scenario_changes(scenarios: DataFrame) -> DataFrame:
    """One raw change per row, numbered as in the scenario."""
    return scenarios.select(
        "scenario_id",
        "expected_change_type",
        "expected_severity",
        F.posexplode_outer("raw_changes").alias("position", "__change"),
    ).select("scenario_id", "expected_change_type", "expected_severity", "position", "__change.*")


# --- whole documents --------------------------------------------------------


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(text, partition columns of the folders): one row per file, read by Spark's own reader from any store it knows.

    Files are dealt to tasks by size, so their number is not bounded by a driver or a task.
    """
    return spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "text")


def write_bundles(docs: DataFrame, path: str) -> None:
    """Documents (text, and columns that name them) as lines of a few files: a file each costs more than all work on a small document."""
    docs.write.json(path)


def read_bundles(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """(text, names): the documents of :func:`write_bundles`, as :func:`read_documents` gives those of a file each."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in ("text", *names))).json(path)


# --- dashboard cards --------------------------------------------------------

_CARD = "struct<id:string,name:string,dataset_query:struct<native:struct<query:string>>>"


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Card exports, one list of cards a file -> (id, name, sql)."""
    return cards_of(read_documents(spark, path))


def cards_of(documents: DataFrame) -> DataFrame:
    """(id, name, sql) of the cards in ``text``. A document that is no list has no cards, nor have items that are no objects."""
    lists = documents.where(F.col("text").rlike(r"^\s*\["))
    items = lists.select(F.explode(F.from_json("text", "array<string>")).alias("item")).where(F.col("item").startswith("{"))
    cards = items.select(F.from_json("item", _CARD).alias("c"))
    return cards.select("c.id", "c.name", F.col("c.dataset_query.native.query").alias("sql"))


# --- lineage manifest -------------------------------------------------------

_NODE = (
    "struct<resource_type:string,name:string,`schema`:string,identifier:string,type:string,"
    "depends_on:struct<nodes:array<string>>,columns:map<string,string>>"
)
_MANIFEST = f"struct<nodes:map<string,{_NODE}>,sources:map<string,{_NODE}>,exposures:map<string,{_NODE}>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(project, text) of the manifest files under ``path``, one folder ``project=<name>`` each."""
    return read_documents(spark, path).select(F.col("project").cast("string").alias("project"), "text")


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(project, section, ord, node_id, entry) from (project, text) rows, in manifest order."""
    def section(name: str) -> Column:
        return F.transform(
            F.map_entries(f"m.{name}"),
            lambda kv, i: F.struct(F.lit(name).alias("section"), i.alias("ord"), kv["key"].alias("node_id"), kv["value"].alias("entry")),
        )

    parsed = manifests.select("project", F.from_json("text", _MANIFEST).alias("m"))
    sections = F.flatten(F.array_compact(F.array(*[section(s) for s in ("nodes", "sources", "exposures")])))
    return parsed.select("project", F.explode(sections).alias("__e")).select("project", "__e.*")


def lineage_nodes(entries: DataFrame) -> DataFrame:
    """(project, node_id, kind, name, schema, identifier, ord); file order decides lookups."""
    section = F.col("section")
    kind = (
        F.when(section == "sources", "source")
        .when(section == "exposures", "exposure")
        .otherwise(F.coalesce("entry.resource_type", F.lit("unknown")))
    )
    return entries.select(
        "project",
        "node_id",
        kind.alias("kind"),
        F.coalesce("entry.name", "node_id").alias("name"),
        F.col("entry.schema").alias("schema"),
        F.col("entry.identifier").alias("identifier"),
        F.col("ord").cast("long").alias("ord"),
    )


def lineage_edges(entries: DataFrame) -> DataFrame:
    """(project, src, dst, pos): dependency -> dependent, for nodes and exposures."""
    return (
        entries.where(F.col("section") != "sources")
        .select(
            "project",
            F.posexplode("entry.depends_on.nodes").alias("pos", "src"),
            F.col("node_id").alias("dst"),
        )
        .select("project", "src", "dst", "pos")
    )


def source_columns(entries: DataFrame) -> DataFrame:
    """(project, node_id, pos, column) declared on sources."""
    return entries.where(F.col("section") == "sources").select(
        "project", "node_id", F.posexplode(F.map_keys("entry.columns")).alias("pos", "column")
    )
