"""Registered queries that run as streams over the given files and read back what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions.durable import new_path
from shiftlens.operators import policy
from shiftlens.operators.classify import classify_single
from shiftlens.plans import derive
from shiftlens.plans.policy_queries import _EVENTS, limiter_sql
from shiftlens.plans.register import Registry
from shiftlens.plans.source_queries import _DOCS, _MSG, PREFIX, payload_rows_of
from shiftlens.sources.cdc import avro_columns
from shiftlens.streaming import batches, cdc, limiter

registry = Registry()
query = registry.query


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = derive.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


@query("WITH " + _MSG + 'SELECT topic, off "offset", is_change FROM chg')
def cdc_stream(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate suppression with the last schema of each topic in keyed state."""
    stream = cdc.marked_stream(derive.messages_of(events_stream(spark, d)))
    out = cdc.run_to_table(stream, new_path(spark, "cdc"), new_path(spark, "cdc-progress"))
    return out.select("topic", "offset", "is_change")


@query(
    "WITH "
    + _DOCS
    + """SELECT src source_identifier, bucket, nm AS name, ty data_type, nl nullable, CAST(n AS BIGINT) payloads FROM obs
    WHERE strptime(bucket, '%Y-%m-%d') + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def payload_stream(spark: SparkSession, d: str) -> DataFrame:
    """Payload schema per source and closed day; the open day is still in state."""
    rows = payload_rows_of(events_stream(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    windows = batches.payload_windows(rows, "source", "ts", "doc", "1 day", "1 hour")
    closed = cdc.run_to_table(windows, new_path(spark, "payload"), new_path(spark, "payload-progress"))
    return batches.window_columns(closed).select(
        "source_identifier", F.date_format("window_start", "yyyy-MM-dd").alias("bucket"), "name", "data_type", "nullable", "payloads"
    )


@query(
    "WITH "
    + _DOCS
    + """, st AS (SELECT src, bucket, lag(bucket) OVER (PARTITION BY src ORDER BY bucket) prev FROM (SELECT DISTINCT src, bucket FROM doc)
        WHERE strptime(bucket, '%Y-%m-%d') + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
    x AS (SELECT obs.*, st.bucket nb FROM obs JOIN st ON obs.src = st.src AND obs.bucket = st.prev),
    y AS (SELECT obs.* FROM obs JOIN st USING (src, bucket) WHERE prev IS NOT NULL),
    j AS (SELECT coalesce(x.src, y.src) src, coalesce(x.nb, y.bucket) bucket, coalesce(x.nm, y.nm) nm,
        CASE WHEN x.nm IS NULL THEN CASE WHEN y.nl THEN 'column_added_nullable' ELSE 'column_added_not_null_no_default' END WHEN y.nm IS NULL THEN 'column_dropped'
            WHEN x.nl AND NOT y.nl THEN 'nullability_tightened' WHEN x.ty <> y.ty THEN CASE WHEN x.ty = 'bigint' AND y.ty = 'numeric' THEN 'type_widened'
                WHEN x.ty = 'numeric' AND y.ty = 'bigint' THEN 'type_narrowed' ELSE 'type_incompatible' END END ct
        FROM x FULL JOIN y ON x.src = y.src AND x.nb = y.bucket AND x.nm = y.nm)
    SELECT src source_identifier, bucket, nm AS name, ct change_type FROM j WHERE ct IS NOT NULL"""
)
def payload_stream_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift events from each closed day to the next one of its source, compared in the stream."""
    rows = payload_rows_of(events_stream(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    raw = batches.payload_drift(batches.payload_windows(rows, "source", "ts", "doc", "1 day", "1 hour"))
    group = ["source_identifier", "window_start", "table_identifier"]
    events = cdc.run_to_table(classify_single(raw, group), new_path(spark, "drift"), new_path(spark, "drift-progress"))
    return events.select(
        "source_identifier", F.date_format("window_start", "yyyy-MM-dd").alias("bucket"), F.substring_index("identifier", ".", -1).alias("name"), "change_type"
    )


@query(
    "WITH "
    + _MSG
    + """, l AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY topic ORDER BY off DESC) = 1)
    SELECT topic, off "offset", nm AS name, ty data_type FROM (
        SELECT topic, off, 'id' nm, 'integer' ty FROM l UNION ALL SELECT topic, off, 'amount', aty FROM l
        UNION ALL SELECT topic, off, 'at', tty FROM l UNION ALL SELECT topic, off, 'email', 'text' FROM l WHERE em)"""
)
def cdc_state_schema(spark: SparkSession, d: str) -> DataFrame:
    """The schema of every topic as the stream's state holds it."""
    progress = new_path(spark, "cdc-progress")
    cdc.run_to_table(cdc.marked_stream(derive.messages_of(events_stream(spark, d))), new_path(spark, "cdc"), progress)
    return avro_columns(cdc.current_state(spark, progress), PREFIX).select("topic", "offset", "name", "data_type")


@query(
    "WITH RECURSIVE "
    + _EVENTS
    + ","
    + limiter_sql("team")
    + """SELECT event_id, team, coalesce(lim_full, false) rate_limited FROM dv JOIN lim USING (event_id)
    WHERE (epoch_us(ts) // 600000000 + 1) * 600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)"""
)
def limiter_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hourly limit per team as keyed state; the last hour's events are still in it."""
    events = derive.drift_events_of(events_stream(spark, d)).withColumn(
        "takes_slot", policy.takes_slot(policy.has_impact("models"))
    )
    stream = limiter.limited_stream(events, "takes_slot", scope="team", lateness="1 hour", cell_seconds=600)
    judged = cdc.run_to_table(stream, new_path(spark, "judged"), new_path(spark, "limiter-progress"))
    return judged.select("event_id", F.col("scope").alias("team"), "rate_limited")


_POLL = """
WITH h AS (SELECT DISTINCT 's' || (user_id % 20) src, date_trunc('day', ts) d, 'raw.' || event_type tbl, CAST(json_extract(props, '$.k') AS BIGINT) % 25 kk FROM events),
hs AS (SELECT src, d, row_number() OVER (PARTITION BY src ORDER BY d) seq FROM (SELECT DISTINCT src, d FROM h)),
hc AS (SELECT h.*, seq, (kk + day(d)) % 4 ty, (kk + day(d)) % 2 = 0 nl FROM h JOIN hs USING (src, d)),
hb AS (SELECT DISTINCT y.src, y.seq, y.tbl FROM hc x JOIN hc y ON x.src = y.src AND x.tbl = y.tbl AND y.seq = x.seq + 1),
j AS (SELECT coalesce(x.src, y.src) src, coalesce(x.seq + 1, y.seq) seq, coalesce(x.tbl, y.tbl) tbl, coalesce(x.kk, y.kk) kk, x.ty bty, y.ty aty, x.nl bnl, y.nl anl
    FROM hc x FULL JOIN hc y ON x.src = y.src AND x.tbl = y.tbl AND x.kk = y.kk AND y.seq = x.seq + 1),
e AS (SELECT j.*, CASE WHEN bty IS NULL THEN CASE WHEN anl THEN 'column_added_nullable' ELSE 'column_added_not_null_no_default' END WHEN aty IS NULL THEN 'column_dropped'
        WHEN bnl AND NOT anl THEN 'nullability_tightened' WHEN bty <> aty THEN CASE WHEN (bty, aty) IN ((0, 1), (0, 2), (1, 2)) THEN 'type_widened'
            WHEN (aty, bty) IN ((0, 1), (0, 2), (1, 2)) THEN 'type_narrowed' ELSE 'type_incompatible' END END ct
    FROM j JOIN hb USING (src, seq, tbl))
SELECT src source_identifier, src || '@' || strftime(d, '%Y-%m-%d') snapshot_id, ct change_type, CAST(count(*) AS BIGINT) n
FROM e JOIN hs USING (src, seq) WHERE ct IS NOT NULL GROUP BY ALL
"""


def catalogue_arrivals(e: DataFrame) -> DataFrame:
    """Catalogue rows as they arrive: a column's type and nullability follow its number and the day."""
    k = derive.payload_key() % 25
    source, day = F.concat(F.lit("s"), F.col("user_id") % 20), F.date_trunc("day", "ts")
    turn = k + F.dayofmonth(day)
    none = F.lit(None)
    return e.select(
        source.alias("source_identifier"),
        F.concat_ws("@", source, F.date_format(day, "yyyy-MM-dd")).alias("snapshot_id"),
        day.alias("captured_at"),
        F.concat(F.lit("raw."), "event_type").alias("table_identifier"),
        F.concat(F.lit("k"), k).alias("name"),
        derive._pick(turn % 4, ["integer", "bigint", "numeric(10,2)", "text"]).alias("data_type"),
        (turn % 2 == 0).alias("nullable"),
        none.cast("string").alias("default"),
        F.lit(False).alias("is_primary_key"),
        k.cast("int").alias("ordinal_position"),
        none.cast("int").alias("character_max_length"),
        none.cast("int").alias("numeric_precision"),
        none.cast("int").alias("numeric_scale"),
        none.cast("array<string>").alias("enum_values"),
    )


@query(_POLL)
def polling_stream(spark: SparkSession, d: str) -> DataFrame:
    """Arriving snapshots are stored, compared with the one before, and classified."""
    store, events = new_path(spark, "store"), new_path(spark, "events")
    step = batches.polling_step(store, events)
    batches.run_batches(catalogue_arrivals(events_stream(spark, d)), step, new_path(spark, "polling-progress"))
    return spark.read.parquet(events).groupBy("source_identifier", "snapshot_id", "change_type").agg(F.count(F.lit(1)).alias("n"))
