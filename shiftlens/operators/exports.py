"""Events as payload tables: lineage run events, alerts, audit rows, proposals, emit-once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Schema addresses of the public OpenLineage specification.
OL_RUN_EVENT = "https://openlineage.io/spec/1-0-5/OpenLineage.json#/definitions/RunEvent"
OL_PARENT_FACET = "https://openlineage.io/spec/facets/1-0-1/ParentRunFacet.json#/$defs/ParentRunFacet"
OL_SCHEMA_FACET = "https://openlineage.io/spec/facets/1-0-1/SchemaDatasetFacet.json#/$defs/SchemaDatasetFacet"

# Alert texts.
SEVERITY_EMOJI = {"low": ":large_blue_circle:", "medium": ":large_yellow_circle:", "high": ":red_circle:"}
ACTION_LABEL = {
    "ignore": "ignored",
    "alert_only": "alerted (no PR)",
    "open_draft_pr": "drafted PR (needs review)",
    "open_pr": "opened PR",
}

PREVIEW = 5


def _fixed(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


# --- lineage run events -----------------------------------------------------


def parent_runs(runs: DataFrame, namespace: str) -> DataFrame:
    """Usable parents: run id and job name both present; a missing namespace gets the default."""
    return runs.where(
        (F.coalesce("parent_run_id", F.lit("")) != "") & (F.coalesce("parent_job_name", F.lit("")) != "")
    ).select(
        "event_id",
        "parent_run_id",
        F.coalesce("parent_job_namespace", F.lit(namespace)).alias("parent_job_namespace"),
        "parent_job_name",
    )


def run_event_outputs(models: DataFrame, namespace: str) -> DataFrame:
    """(event_id, namespace, name): the output datasets of each run event, one row for each model.

    Rows, not an array: an event has as many outputs as its closure has models.
    """
    return models.select("event_id", F.lit(namespace).alias("namespace"), F.col("model").alias("name")).distinct()


def run_events(
    events: DataFrame,
    *,
    producer: str,
    namespace: str,
    drift_facet: str,
    job: str = "schema_change_detect",
    parents: DataFrame | None = None,
) -> DataFrame:
    """(event_id, payload): one COMPLETE run event per drift event, whatever its size.

    Its outputs are the rows of ``run_event_outputs``.
    """
    ns, out = F.lit(namespace), events
    if parents is not None:
        out = out.join(parent_runs(parents, namespace), "event_id", "left")
        parent = F.when(
            F.col("parent_run_id").isNotNull(),
            F.struct(
                F.lit(producer).alias("_producer"),
                F.lit(OL_PARENT_FACET).alias("_schemaURL"),
                F.struct(F.col("parent_run_id").alias("runId")).alias("run"),
                F.struct(F.col("parent_job_namespace").alias("namespace"), F.col("parent_job_name").alias("name")).alias("job"),
            ),
        )
    else:
        parent = F.lit(None).cast("struct<_producer:string>")
    drift = F.struct(
        F.lit(producer).alias("_producer"),
        F.lit(drift_facet).alias("_schemaURL"),
        "change_type",
        "severity",
        "confidence",
        "blast_radius_score",
        "fan_out_conservative",
    )

    def field(column: str) -> Column:
        spec = F.col(column)
        return F.when(spec.isNotNull(), F.struct(spec["name"].alias("name"), spec["data_type"].alias("type")))

    fields = F.array_compact(F.array(field("column_before"), field("column_after")))
    dataset = F.struct(
        ns.alias("namespace"),
        F.col("identifier").alias("name"),
        F.struct(
            F.struct(
                F.lit(producer).alias("_producer"),
                F.lit(OL_SCHEMA_FACET).alias("_schemaURL"),
                fields.alias("fields"),
            ).alias("schema")
        ).alias("facets"),
    )
    payload = F.to_json(
        F.struct(
            F.lit("COMPLETE").alias("eventType"),
            F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("eventTime"),
            F.lit(producer).alias("producer"),
            F.lit(OL_RUN_EVENT).alias("schemaURL"),
            F.struct(
                F.col("event_id").alias("runId"), F.struct(drift.alias("drift"), parent.alias("parent")).alias("facets")
            ).alias("run"),
            F.struct(ns.alias("namespace"), F.lit(job).alias("name")).alias("job"),
            F.array(dataset).alias("inputs"),
        )
    )
    return out.select("event_id", payload.alias("payload"))


# --- alerts -----------------------------------------------------------------


def model_preview(models: DataFrame, first: int = PREVIEW) -> DataFrame:
    """(event_id, preview): the first names, and how many more there are.

    Each task sends on its first names of an event and one count, however many models the event has.
    """
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("model"))
    kept = models.select("event_id", "model").withColumn("__k", place).where(F.col("__k") <= first)
    listed = kept.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("model")), ", ").alias("__names"))
    names = listed.join(models.groupBy("event_id").agg(F.count(F.lit(1)).alias("__size")), "event_id")
    more = F.when(F.col("__size") > first, F.format_string(" (+%d more)", F.col("__size") - first)).otherwise("")
    return names.select("event_id", F.concat("__names", more).alias("preview"))


def alert_header() -> Column:
    emoji = F.coalesce(_fixed(SEVERITY_EMOJI, F.col("severity")), F.lit(":grey_question:"))
    return F.concat(emoji, F.lit(" Schema drift: "), F.col("change_type"))


def alerts(decisions: DataFrame, models: DataFrame) -> DataFrame:
    """(event_id, header, payload): block message per decided event; empty parts are left out."""
    out = decisions.join(model_preview(models), "event_id", "left")
    text = lambda label, value: F.struct(
        F.lit("mrkdwn").alias("type"), F.concat(F.lit(f"*{label}*\n"), value).alias("text")
    )
    tick = F.lit("`")
    fields = F.array_compact(
        F.array(
            text("Source", F.concat(tick, F.col("identifier"), tick)),
            text("Severity", F.col("severity")),
            text("Action", _fixed(ACTION_LABEL, F.col("action"))),
            text("Confidence", F.format_string("%.2f", F.col("confidence"))),
            F.when(F.col("preview").isNotNull(), text("Affected models", F.col("preview"))),
            F.when(F.col("blast_radius_score") != 0, text("Blast radius", F.format_string("%.1f", F.col("blast_radius_score")))),
        )
    )
    header = alert_header()
    blocks = [
        F.to_json(
            F.struct(
                F.lit("header").alias("type"),
                F.struct(F.lit("plain_text").alias("type"), header.alias("text")).alias("text"),
            )
        ),
        F.to_json(F.struct(F.lit("section").alias("type"), fields.alias("fields"))),
    ]
    if "reason" in decisions.columns:
        note = F.struct(F.lit("mrkdwn").alias("type"), F.concat(F.lit(":memo: "), F.col("reason")).alias("text"))
        blocks.append(
            F.when(
                F.coalesce("reason", F.lit("")) != "",
                F.to_json(F.struct(F.lit("context").alias("type"), F.array(note).alias("elements"))),
            )
        )
    if "pr_url" in decisions.columns:
        button = F.struct(
            F.lit("button").alias("type"),
            F.struct(F.lit("plain_text").alias("type"), F.lit("Open PR").alias("text")).alias("text"),
            F.col("pr_url").alias("url"),
        )
        blocks.append(
            F.when(
                F.coalesce("pr_url", F.lit("")) != "",
                F.to_json(F.struct(F.lit("actions").alias("type"), F.array(button).alias("elements"))),
            )
        )
    body = F.array_join(F.array_compact(F.array(*blocks)), ",")
    head = F.regexp_extract(F.to_json(F.struct(header.alias("text"))), r"^(.*)\}$", 1)
    return out.select(
        "event_id", header.alias("header"), F.concat(head, F.lit(',"blocks":['), body, F.lit("]}")).alias("payload")
    )


# --- audit ------------------------------------------------------------------


def audit_rows(
    df: DataFrame, actor: str, action: str | Column, target: str, payload: Sequence[str], at: str = "detected_at"
) -> DataFrame:
    """One audit record per row; ``payload`` columns become a JSON object."""
    return df.select(
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"),
        F.lit(actor).alias("actor"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        F.col(target).alias("target"),
        F.to_json(F.struct(*sorted(payload))).alias("payload"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """JSON lines, keys in order, one file per task, only ever appended."""
    line = F.to_json(
        F.struct("action", "actor", "occurred_at", F.parse_json("payload").alias("payload"), "target")
    )
    rows.select(line.alias("value")).write.mode("append").text(path)


# --- proposals --------------------------------------------------------------


def identifier_parts(identifier: Column) -> tuple[Column, Column, Column]:
    """(parts, table, column) of ``schema.table.column``."""
    parts = F.split(identifier, r"\.")
    table = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    return parts, table, F.element_at(parts, -1)


def proposal_headers(events: DataFrame, title_prefix: str = "[drift] ", label: str = "drift") -> tuple[DataFrame, DataFrame]:
    """(headers, rejected rows with a reason). Only nullable additions are drafted."""
    parts, table, column = identifier_parts(F.col("identifier"))
    reason = (
        F.when(F.col("change_type") != "column_added_nullable", "unsupported_change_type")
        .when(F.col("column_after").isNull(), "column_missing")
        .when(F.size(parts) < 3, "identifier_not_schema_table_column")
    )
    checked = events.withColumn("reason", reason)
    headers = checked.where(F.col("reason").isNull()).select(
        "event_id",
        F.concat(F.lit("drift/"), F.lower("event_id")).alias("branch"),
        F.concat(F.lit(title_prefix), F.format_string("Add nullable column `%s` to `%s`", column, table)).alias("title"),
        F.array(F.lit(label), F.concat(F.lit("severity:"), F.col("severity"))).alias("labels"),
        F.lit(True).alias("is_draft"),
    )
    return headers, checked.where(F.col("reason").isNotNull()).select("event_id", "change_type", "reason")


# Description of a column that was declared automatically.
TODO_DESCRIPTION = "TODO(reviewer): describe this newly-detected column."


def declared_patch(events: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns to declare, events whose table is not declared).

    ``declared`` are (schema, table, column) rows; a table without columns has a NULL column.
    Each new column is added once however many events name it.
    """
    parts, table, column = identifier_parts(F.col("identifier"))
    wanted = events.where(F.col("change_type") == "column_added_nullable").select(
        parts[0].alias("schema"),
        F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), ".").alias("table"),
        column.alias("column"),
        "event_id",
    )
    tables = declared.select("schema", "table").distinct()
    fresh = (
        wanted.join(tables, ["schema", "table"], "left_semi")
        .join(declared.where(F.col("column").isNotNull()), ["schema", "table", "column"], "left_anti")
        .select("schema", "table", "column")
        .distinct()
        .withColumn("description", F.lit(TODO_DESCRIPTION))
    )
    return fresh, wanted.join(tables, ["schema", "table"], "left_anti")


# --- emit once --------------------------------------------------------------


def emit_once(candidates: DataFrame, emitted: DataFrame, key: str = "branch") -> DataFrame:
    """Candidates with ``skipped_reason``: set when the key was emitted before, else NULL."""
    seen = emitted.select(key).distinct().withColumn("__seen", F.lit(True))
    return (
        candidates.join(seen, key, "left")
        .withColumn("skipped_reason", F.when(F.col("__seen"), "branch_exists"))
        .drop("__seen")
    )
