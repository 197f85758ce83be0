"""Registered queries: hold-out, baselines, recall, confusion, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions.durable import cut
from shiftlens.operators import evaluate
from shiftlens.plans import derive
from shiftlens.plans import oracle_parts as o
from shiftlens.plans.register import Registry

registry = Registry()
query = registry.query

_HELD = "CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) % 10 IN (7, 8, 9)"

_RESULTS = o.changes(
    """fst AS (SELECT tbl id, change_type ect, severity es FROM single QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY n) = 1),
    expd AS (SELECT 'raw.t' || o_orderkey id, ect, es FROM orders LEFT JOIN fst ON id = 'raw.t' || o_orderkey),
    best AS (SELECT tbl id, change_type ct, severity s FROM batch QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY rnk DESC, emit, ord) = 1),
    vt AS (SELECT tbl id, CASE kind WHEN 'removed' THEN 'high' ELSE 'medium' END s FROM raw WHERE kind <> 'added' QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY n) = 1),
    mtall AS (SELECT tbl, n, CASE WHEN kind = 'removed' THEN 'high' WHEN kind = 'modified' AND bnl AND NOT anl THEN 'medium'
        WHEN kind = 'modified' AND split_part(bty, '(', 1) <> split_part(aty, '(', 1) THEN 'high' END s FROM raw),
    mt AS (SELECT tbl id, s FROM mtall WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY n) = 1),
    res AS (SELECT 'rule' AS method, id, ect, es, ct pct, s ps FROM expd LEFT JOIN best USING (id)
        UNION ALL SELECT 'value_test', id, ect, es, CASE WHEN s IS NOT NULL THEN 'unknown' END, s FROM expd LEFT JOIN vt USING (id)
        UNION ALL SELECT 'model_test', id, ect, es, CASE WHEN s IS NOT NULL THEN 'unknown' END, s FROM expd LEFT JOIN mt USING (id)),
    rp AS (SELECT method, CAST(count(*) AS BIGINT) total, CAST(count(pct) AS BIGINT) detected, CAST(count_if(pct IS NOT DISTINCT FROM ect) AS BIGINT) correct FROM res GROUP BY 1),
    cls AS (SELECT method, coalesce(es, '<none>') c FROM res UNION SELECT method, coalesce(ps, '<none>') FROM res),
    pc AS (SELECT cls.method, c, count_if(coalesce(es, '<none>') = c AND coalesce(ps, '<none>') = c) tp, count_if(coalesce(es, '<none>') <> c AND coalesce(ps, '<none>') = c) fp,
        count_if(coalesce(es, '<none>') = c AND coalesce(ps, '<none>') <> c) fn
        FROM cls JOIN res USING (method) GROUP BY 1, 2),
    f1 AS (SELECT method, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) f FROM pc GROUP BY 1)"""
)


def _results(spark: SparkSession, d: str) -> DataFrame:
    expected, changes = derive.scenarios(spark, d)
    return evaluate.all_methods(expected, changes)


@query(f"SELECT doc_id, {_HELD.format('CAST(doc_id AS VARCHAR)')} held_out FROM documents")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    docs = derive.table(spark, d, "documents")
    return docs.select("doc_id", evaluate.held_out(F.col("doc_id").cast("string")).alias("held_out"))


@query(_RESULTS + "SELECT method, id scenario_id, pct predicted_change_type, ps predicted_severity FROM res")
def predictions(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("method", "scenario_id", "predicted_change_type", "predicted_severity")


@query(
    _RESULTS
    + """SELECT method, total, detected, correct, round(detected / total, 6) drift_recall, round(correct / total, 6) classification_recall,
    round(CASE WHEN detected = 0 THEN 0 ELSE correct / detected END, 6) classification_precision FROM rp"""
)
def recall_precision(spark: SparkSession, d: str) -> DataFrame:
    scores = evaluate.recall_precision(_results(spark, d))
    ratios = ["drift_recall", "classification_recall", "classification_precision"]
    return scores.withColumns({c: F.round(c, 6) for c in ratios})


@query(_RESULTS + "SELECT method, coalesce(ect, '<none>') expected, coalesce(pct, '<none>') predicted, CAST(count(*) AS BIGINT) n FROM res GROUP BY 1, 2, 3")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_results(spark, d))


@query(
    _RESULTS
    + """SELECT method, ec expected, pc predicted, CAST(count(*) AS BIGINT) n, CAST(grouping_id(ec, pc) AS BIGINT) margin
    FROM (SELECT method, coalesce(ect, '<none>') ec, coalesce(pct, '<none>') pc FROM res) GROUP BY method, CUBE (ec, pc)"""
)
def confusion_margins(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_margins(evaluate.confusion(_results(spark, d)))


@query(_RESULTS + "SELECT method, f severity_macro_f1 FROM f1")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.severity_macro_f1(_results(spark, d)).withColumn("severity_macro_f1", F.round("severity_macro_f1", 6))


@query(
    _RESULTS
    + f""", h AS (SELECT * FROM res WHERE {_HELD.format('id')}),
    hrp AS (SELECT method, CAST(count(*) AS BIGINT) total, CAST(count(pct) AS BIGINT) detected, CAST(count_if(pct IS NOT DISTINCT FROM ect) AS BIGINT) correct, avg(length(id)) lat FROM h GROUP BY 1),
    hcls AS (SELECT method, coalesce(es, '<none>') c FROM h UNION SELECT method, coalesce(ps, '<none>') FROM h),
    hpc AS (SELECT hcls.method, c, count_if(coalesce(es, '<none>') = c AND coalesce(ps, '<none>') = c) tp, count_if(coalesce(es, '<none>') <> c AND coalesce(ps, '<none>') = c) fp,
        count_if(coalesce(es, '<none>') = c AND coalesce(ps, '<none>') <> c) fn
        FROM hcls JOIN h USING (method) GROUP BY 1, 2),
    hf1 AS (SELECT method, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) f FROM hpc GROUP BY 1)
    SELECT method, total, detected, correct, round(detected / total, 6) drift_recall, round(correct / total, 6) classification_recall,
    round(CASE WHEN detected = 0 THEN 0 ELSE correct / detected END, 6) classification_precision, round(f, 6) severity_macro_f1, round(lat, 6) mean_latency_ms FROM hrp JOIN hf1 USING (method)"""
)
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """All methods on the held-out scenarios only; a supplied number stands for the latency."""
    held = _results(spark, d).where(evaluate.held_out(F.col("scenario_id")))
    table = evaluate.compare_methods(cut(held.withColumn("elapsed_ms", F.length("scenario_id").cast("double"))), "elapsed_ms")
    ratios = ["drift_recall", "classification_recall", "classification_precision", "severity_macro_f1", "mean_latency_ms"]
    return table.withColumns({c: F.round(c, 6) for c in ratios})


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey s, l_partkey % 20 c FROM lineitem WHERE l_linenumber <= 4), p AS (SELECT DISTINCT l_orderkey s, l_partkey % 20 c FROM lineitem WHERE l_linenumber >= 3),
    j AS (SELECT coalesce(e.s, p.s) s, count(e.s) ne, count(p.s) np, count_if(e.s IS NOT NULL AND p.s IS NOT NULL) h FROM e FULL JOIN p ON e.s = p.s AND e.c = p.c GROUP BY 1)
    SELECT s scenario_id, round(CASE WHEN ne = 0 THEN 0 ELSE h / ne END, 6) recall, round(CASE WHEN np = 0 THEN 0 ELSE h / np END, 6) AS precision FROM j"""
)
def impact_scores(spark: SparkSession, d: str) -> DataFrame:
    line = derive.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scenario_id"), F.lit("m").alias("name"), (F.col("l_partkey") % 20).cast("string").alias("column"), "l_linenumber"
    )
    scores = evaluate.impact_scores(line.where(F.col("l_linenumber") <= 4), line.where(F.col("l_linenumber") >= 3))
    return scores.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})
