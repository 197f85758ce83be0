"""Registered queries: policy decisions, exports, counters, costs, data tests, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.operators import exports, limiter, metrics, policy, quality
from shiftlens.plans import derive
from shiftlens.plans.register import Registry

registry = Registry()
query = registry.query

_EVENTS = """
ev AS (SELECT event_id, ts, 'team' || (user_id % 7) team, user_id, CAST(json_extract(props, '$.k') AS BIGINT) k, event_type, value FROM events),
de AS (SELECT *, 'raw.t' || user_id || '.k' || k identifier,
    CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'column_renamed' WHEN event_type = 'error' AND k % 2 = 0 THEN 'precision_changed'
        WHEN event_type = 'view' THEN 'column_added_nullable' WHEN event_type = 'click' THEN 'type_widened' WHEN event_type = 'signup' THEN 'default_changed'
        WHEN event_type = 'purchase' THEN 'column_dropped' ELSE 'pk_changed' END change_type,
    CASE WHEN value < 5 THEN 0.0 ELSE floor(value) END score, CASE WHEN value < 5 THEN 0 ELSE CAST(floor(value) AS INTEGER) % 8 END models, k % 10 = 0 wide FROM ev),
dv AS (SELECT *, CASE change_type WHEN 'column_added_nullable' THEN 'low' WHEN 'type_widened' THEN 'low' WHEN 'default_changed' THEN 'medium'
    WHEN 'precision_changed' THEN 'medium' ELSE 'high' END severity, change_type IN ('column_dropped', 'pk_changed') destr FROM de),
dd AS (SELECT *, CASE WHEN destr OR severity = 'high' THEN 'open_draft_pr' WHEN severity = 'low' AND models = 0 THEN 'alert_only'
        WHEN score > 25 THEN 'open_draft_pr' ELSE 'open_pr' END action,
    CASE WHEN destr THEN 'destructive change ''' || change_type || ''' requires human review' WHEN severity = 'high' THEN 'HIGH severity'
        WHEN severity = 'medium' AND score > 25 THEN 'MEDIUM severity with blast_radius ' || printf('%.1f', score) || ' > cap 25.0'
        WHEN severity = 'medium' THEN 'MEDIUM severity within blast cap' WHEN models = 0 THEN 'LOW severity with no downstream impact'
        WHEN score > 25 THEN 'LOW severity but blast_radius ' || printf('%.1f', score) || ' > cap 25.0' ELSE 'LOW severity with downstream impact' END reason,
    concat_ws(',', 'drift:' || change_type, 'severity:' || severity, CASE WHEN wide THEN 'fan-out-widened' END,
        CASE WHEN destr OR severity = 'high' OR (score > 25 AND NOT (severity = 'low' AND models = 0)) THEN 'requires-human' END,
        CASE WHEN destr THEN 'destructive' WHEN severity <> 'high' AND score > 25 AND NOT (severity = 'low' AND models = 0) THEN 'large-blast' END) labels FROM dv)
"""


def _decided(spark: SparkSession, d: str, **options) -> DataFrame:
    return policy.decide(derive.drift_events(spark, d), policy.has_impact("models"), **options)


# --- policy -----------------------------------------------------------------


@query("WITH " + _EVENTS + "SELECT event_id, action, reason FROM dd")
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("event_id", "action", "reason")


@query("WITH " + _EVENTS + "SELECT event_id, labels || CASE WHEN destr THEN ',team:' || team ELSE ',team:' || team END labels FROM dd")
def policy_labels(spark: SparkSession, d: str) -> DataFrame:
    team = F.concat(F.lit("team:"), "team")
    extra = F.array(F.concat(F.lit("severity:"), "severity"), team, team)
    merged = policy.merge_labels(F.col("labels"), extra)
    return _decided(spark, d).select("event_id", F.array_join(merged, ",").alias("labels"))


@query("SELECT event_id, 'ignore' AS action, 'kill switch active' reason, 'kill-switch' labels FROM events")
def kill_switch(spark: SparkSession, d: str) -> DataFrame:
    out = _decided(spark, d, kill_switch=True)
    return out.select("event_id", "action", "reason", F.array_join("labels", ",").alias("labels"))


def limited_events(spark: SparkSession, d: str, scope: str | None) -> DataFrame:
    events = derive.drift_events(spark, d).withColumn("takes_slot", policy.takes_slot(policy.has_impact("models")))
    judged, _ = limiter.rate_limit(events, "takes_slot", scope=scope)
    return policy.decide(judged, policy.has_impact("models"), limited=F.col("rate_limited"))


def limiter_sql(scope: str) -> str:
    """CTE ``lim`` (event_id, scope, full): a walk over the events that take a place, one by one, then a look back for every event."""
    return f"""
tk AS (SELECT {scope} scope, event_id id, epoch_us(ts) t, destr OR severity IN ('high', 'medium') OR models > 0 takes FROM dv),
cn AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t, id) rn FROM tk WHERE takes),
walk AS (
    SELECT scope, rn, t, id, true let, [t] w FROM cn WHERE rn = 1
    UNION ALL
    SELECT scope, rn, t, id, NOT f, CASE WHEN f THEN w ELSE list_append(w, t)[-{policy.MAX_EVENTS}:] END
    FROM (SELECT cn.*, w, len(w) = {policy.MAX_EVENTS} AND w[1] >= cn.t - {policy.WINDOW_SECONDS * 1_000_000} f FROM walk JOIN cn ON cn.scope = walk.scope AND cn.rn = walk.rn + 1)),
lt AS (SELECT scope, t, id, true let FROM walk WHERE let),
sl AS (SELECT scope, id, t, list(CASE WHEN let THEN t END) FILTER (let) OVER (PARTITION BY scope ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) seen
    FROM tk LEFT JOIN lt USING (scope, t, id)),
lim AS (SELECT id event_id, scope, len(coalesce(seen, [])) >= {policy.MAX_EVENTS} AND seen[-{policy.MAX_EVENTS}] >= t - {policy.WINDOW_SECONDS * 1_000_000} lim_full FROM sl)
"""


@query(
    "WITH RECURSIVE "
    + _EVENTS
    + ","
    + limiter_sql("'global'")
    + """SELECT event_id, CASE WHEN lim_full THEN 'alert_only' ELSE action END action, CASE WHEN lim_full THEN 'rate limit exceeded (>10/3600s)' ELSE reason END reason,
    CASE WHEN lim_full THEN 'rate-limited' ELSE labels END labels FROM dd JOIN lim USING (event_id)"""
)
def rate_limited_decisions(spark: SparkSession, d: str) -> DataFrame:
    """One global window of ten per hour over all events."""
    return limited_events(spark, d, None).select("event_id", "action", "reason", F.array_join("labels", ",").alias("labels"))


@query(
    "WITH RECURSIVE "
    + _EVENTS
    + ","
    + limiter_sql("team")
    + "SELECT event_id, team, CASE WHEN lim_full THEN 'alert_only' ELSE action END action, coalesce(lim_full, false) rate_limited FROM dd JOIN lim USING (event_id)"
)
def rate_limited_by_team(spark: SparkSession, d: str) -> DataFrame:
    return limited_events(spark, d, "team").select("event_id", "team", "action", "rate_limited")


# --- exports ----------------------------------------------------------------

PRODUCER = "https://example.com/shiftlens"


def _event_specs(events: DataFrame) -> DataFrame:
    """Column specs for the payloads: an added column has no before, a dropped one no after."""
    spec = lambda t: F.struct(F.element_at(F.split("identifier", r"\."), -1).alias("name"), F.lit(t).alias("data_type"))
    return events.withColumn("column_before", F.when(F.col("change_type") != "column_added_nullable", spec("integer"))).withColumn(
        "column_after", F.when(F.col("change_type") != "column_dropped", spec("bigint"))
    )


@query(
    "WITH "
    + _EVENTS
    + """SELECT event_id, 'COMPLETE' event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' event_time, identifier dataset, change_type, score,
        CASE WHEN user_id % 3 = 0 THEN 'run' || user_id END parent_run, CASE WHEN user_id % 3 = 0 THEN 'elt' END parent_ns,
        CASE WHEN change_type <> 'column_added_nullable' THEN 'integer' ELSE 'bigint' END first_type,
        CAST(CASE WHEN change_type IN ('column_added_nullable', 'column_dropped') THEN 1 ELSE 2 END AS INTEGER) fields FROM dv"""
)
def run_event_fields(spark: SparkSession, d: str) -> DataFrame:
    """Scalars read back from the run-event payloads."""
    events = _event_specs(derive.drift_events(spark, d))
    user = F.regexp_extract("identifier", r"^raw\.t(\d+)", 1).cast("long")
    runs = events.select(
        "event_id",
        F.concat(F.lit("run"), user).alias("parent_run_id"),
        F.when(user % 3 == 0, "nightly").alias("parent_job_name"),
        F.lit(None).cast("string").alias("parent_job_namespace"),
    )
    out = exports.run_events(
        events, producer=PRODUCER, namespace="elt", drift_facet=f"{PRODUCER}#drift", parents=runs
    )
    at = lambda path: F.get_json_object("payload", path)
    return out.select(
        "event_id",
        at("$.eventType").alias("event_type"),
        at("$.eventTime").alias("event_time"),
        at("$.inputs[0].name").alias("dataset"),
        at("$.run.facets.drift.change_type").alias("change_type"),
        at("$.run.facets.drift.blast_radius_score").cast("double").alias("score"),
        at("$.run.facets.parent.run.runId").alias("parent_run"),
        at("$.run.facets.parent.job.namespace").alias("parent_ns"),
        at("$.inputs[0].facets.schema.fields[0].type").alias("first_type"),
        F.json_array_length(at("$.inputs[0].facets.schema.fields")).alias("fields"),
    )


@query("WITH " + _EVENTS + "SELECT event_id, 'elt' namespace, 'm' || k AS name FROM (SELECT event_id, unnest(range(1, models + 1)) k FROM dv)")
def run_event_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Output datasets of the run events, one row each."""
    return exports.run_event_outputs(derive.event_models(spark, d), "elt")


@query(
    "WITH "
    + _EVENTS
    + """SELECT event_id, CASE severity WHEN 'low' THEN ':large_blue_circle:' WHEN 'medium' THEN ':large_yellow_circle:' ELSE ':red_circle:' END || ' Schema drift: ' || change_type header,
        '*Source*' || chr(10) || '`' || identifier || '`' source_text,
        '*Action*' || chr(10) || CASE action WHEN 'alert_only' THEN 'alerted (no PR)' WHEN 'open_draft_pr' THEN 'drafted PR (needs review)' ELSE 'opened PR' END action_text,
        CASE WHEN models > 0 THEN '*Affected models*' || chr(10) || array_to_string(list_transform(range(1, least(models, 5) + 1), lambda x: 'm' || x), ', ')
            || CASE WHEN models > 5 THEN ' (+' || (models - 5) || ' more)' ELSE '' END
          WHEN score <> 0 THEN '*Blast radius*' || chr(10) || printf('%.1f', score) END fifth_text,
        CAST(4 + CASE WHEN models > 0 THEN 1 ELSE 0 END + CASE WHEN score <> 0 THEN 1 ELSE 0 END AS INTEGER) fields,
        ':memo: ' || reason note, CASE WHEN action LIKE 'open%' THEN 'https://git.local/pr/' || event_id END button FROM dd"""
)
def alert_fields(spark: SparkSession, d: str) -> DataFrame:
    """Scalars read back from the alert payloads."""
    decided = _decided(spark, d).withColumn(
        "pr_url", F.when(F.col("action").startswith("open"), F.concat(F.lit("https://git.local/pr/"), "event_id"))
    )
    out = exports.alerts(decided, derive.event_models(spark, d))
    at = lambda path: F.get_json_object("payload", path)
    return out.select(
        "event_id",
        at("$.text").alias("header"),
        at("$.blocks[1].fields[0].text").alias("source_text"),
        at("$.blocks[1].fields[2].text").alias("action_text"),
        at("$.blocks[1].fields[4].text").alias("fifth_text"),
        F.json_array_length(at("$.blocks[1].fields")).alias("fields"),
        at("$.blocks[2].elements[0].text").alias("note"),
        at("$.blocks[3].elements[0].url").alias("button"),
    )


@query(
    "WITH "
    + _EVENTS
    + """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' occurred_at, 'PolicyEngine' actor, action, identifier target,
    '{"change_type":"' || change_type || '","reason":"' || reason || '"}' payload FROM dd"""
)
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.audit_rows(_decided(spark, d), "PolicyEngine", F.col("action"), "identifier", ["reason", "change_type"])


@query(
    "WITH "
    + _EVENTS
    + """SELECT event_id, 'drift/' || event_id branch, '[drift] Add nullable column `k' || k || '` to `raw.t' || user_id || '`' title,
    'drift,severity:low' labels, CASE WHEN event_id % 4 = 0 THEN 'branch_exists' END skipped_reason FROM dv WHERE change_type = 'column_added_nullable'"""
)
def emit_once(spark: SparkSession, d: str) -> DataFrame:
    """Proposal headers, with the ones whose branch was emitted before marked."""
    events = _event_specs(derive.drift_events(spark, d)).withColumn("event_id", F.col("event_id").cast("string"))
    headers, _ = exports.proposal_headers(events)
    emitted = derive.table(spark, d, "events").where(F.col("event_id") % 4 == 0).select(
        F.concat(F.lit("drift/"), "event_id").alias("branch")
    )
    marked = exports.emit_once(headers, emitted)
    return marked.select(
        F.col("event_id").cast("long").alias("event_id"), "branch", "title", F.array_join("labels", ",").alias("labels"), "skipped_reason"
    )


@query(
    "WITH " + _EVENTS + "SELECT change_type, 'unsupported_change_type' reason, CAST(count(*) AS BIGINT) n FROM dv WHERE change_type <> 'column_added_nullable' GROUP BY 1"
)
def proposal_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = exports.proposal_headers(_event_specs(derive.drift_events(spark, d)).withColumn("event_id", F.col("event_id").cast("string")))
    return rejected.groupBy("change_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH "
    + _EVENTS
    + """, decl AS (SELECT DISTINCT user_id, k FROM ev WHERE user_id % 5 <> 0 AND k % 2 = 0), tabs AS (SELECT DISTINCT user_id FROM decl)
    SELECT DISTINCT 'raw' "schema", 't' || user_id "table", 'k' || k "column", 'TODO(reviewer): describe this newly-detected column.' description FROM dv
    WHERE change_type = 'column_added_nullable' AND user_id IN (SELECT user_id FROM tabs) AND (user_id, k) NOT IN (SELECT user_id, k FROM decl)"""
)
def declared_patch(spark: SparkSession, d: str) -> DataFrame:
    fresh, _ = exports.declared_patch(derive.drift_events(spark, d), _declared(spark, d))
    return fresh


def _declared(spark: SparkSession, d: str) -> DataFrame:
    k, user = derive.payload_key(), F.col("user_id")
    return derive.table(spark, d, "events").where((user % 5 != 0) & (k % 2 == 0)).select(
        F.lit("raw").alias("schema"), F.concat(F.lit("t"), user).alias("table"), F.concat(F.lit("k"), k).alias("column")
    ).distinct()


@query(
    "WITH "
    + _EVENTS
    + """, tabs AS (SELECT DISTINCT user_id FROM ev WHERE user_id % 5 <> 0 AND k % 2 = 0)
    SELECT event_id, 't' || user_id "table" FROM dv WHERE change_type = 'column_added_nullable' AND user_id NOT IN (SELECT user_id FROM tabs)"""
)
def undeclared_tables(spark: SparkSession, d: str) -> DataFrame:
    _, missing = exports.declared_patch(derive.drift_events(spark, d), _declared(spark, d))
    return missing.select("event_id", "table")


# --- counters and costs -----------------------------------------------------


@query("WITH " + _EVENTS + "SELECT action, severity, CAST(count(*) AS BIGINT) n FROM dd GROUP BY 1, 2")
def action_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.action_counters(_decided(spark, d))


@query("WITH " + _EVENTS + "SELECT CAST(action = 'open_draft_pr' AS VARCHAR) is_draft, CAST(count(*) AS BIGINT) n FROM dd WHERE action LIKE 'open%' GROUP BY 1")
def pr_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pr_counters(_decided(spark, d))


@query("SELECT event_type component, CAST(count(*) AS BIGINT) n FROM events GROUP BY 1")
def error_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_counters(derive.table(spark, d, "events").withColumnRenamed("event_type", "component"))


def _bounds_sql(bounds) -> str:
    return ",".join(f"({b}, '{b}')" for b in bounds)


@query(
    f"""WITH b(bound, le) AS (VALUES {_bounds_sql(metrics.LATENCY_BOUNDS)}), s AS (SELECT event_type, value / 100 v FROM events)
    SELECT event_type, le, CAST(count_if(v <= bound) AS BIGINT) n, round(sum(v), 4) total, CAST(count(*) AS BIGINT) observations FROM s, b GROUP BY 1, 2
    UNION ALL SELECT event_type, '+Inf', count(*), round(sum(v), 4), count(*) FROM s GROUP BY 1"""
)
def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = derive.table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("v"))
    return metrics.histogram(e, "v", metrics.LATENCY_BOUNDS, ["event_type"]).withColumn("total", F.round("total", 4))


_DRAFTS = """
dr AS (SELECT o_orderkey event_id, o_custkey user_id, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END provider, 'model' || (o_custkey % 4) model,
    o_orderkey % 1000 + 100 tokens_in, o_custkey % 300 tokens_out, o_orderstatus <> 'F' ok
    FROM orders),
pr(provider, model, ri, ro) AS (VALUES ('a', 'model0', 3.0, 15.0), ('b', 'model1', 0.15, 0.6), ('b', 'model3', 2.5, 10.0)),
co AS (SELECT dr.*, (tokens_in * coalesce(ri, CASE provider WHEN 'a' THEN 3.0 ELSE 0.15 END) + tokens_out * coalesce(ro, CASE provider WHEN 'a' THEN 15.0 ELSE 0.6 END)) / 1000000.0 cost
    FROM dr LEFT JOIN pr USING (provider, model))
"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """A draft for every order."""
    return derive.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("provider"),
        F.concat(F.lit("model"), F.col("o_custkey") % 4).alias("model"),
        (F.col("o_orderkey") % 1000 + 100).alias("tokens_in"),
        (F.col("o_custkey") % 300).alias("tokens_out"),
        (F.col("o_orderstatus") != "F").alias("ok"),
    )


def _costs(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame(
        [("a", "model0", 3.0, 15.0), ("b", "model1", 0.15, 0.6), ("b", "model3", 2.5, 10.0)],
        "provider string, model string, rate_in double, rate_out double",
    )
    default = F.when(F.col("provider") == "a", F.struct(F.lit(3.0).alias("rate_in"), F.lit(15.0).alias("rate_out"))).otherwise(
        F.struct(F.lit(0.15).alias("rate_in"), F.lit(0.6).alias("rate_out"))
    )
    return metrics.draft_costs(_drafts(spark, d), prices, default)


@query(
    "WITH "
    + _DRAFTS
    + """SELECT provider, model, CAST(count(*) AS BIGINT) attempts, CAST(count_if(NOT ok) AS BIGINT) failures, round(CAST(sum(cost) AS DOUBLE), 4) cost_usd FROM co GROUP BY ROLLUP (provider, model)"""
)
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cost_rollup(_costs(spark, d)).withColumn("cost_usd", F.round("cost_usd", 4))


@query("WITH " + _DRAFTS + "SELECT event_id % 50 event_id, CAST(count(*) AS BIGINT) attempts, round(CAST(sum(cost) AS DOUBLE), 4) total_cost_usd, bool_or(ok) succeeded FROM co GROUP BY 1")
def cost_per_event(spark: SparkSession, d: str) -> DataFrame:
    grouped = _costs(spark, d).withColumn("event_id", F.col("event_id") % 50)
    return metrics.cost_per_event(grouped).withColumn("total_cost_usd", F.round("total_cost_usd", 4))


@query(
    "WITH "
    + _DRAFTS
    + """SELECT 'in' direction, provider, model, CAST(sum(tokens_in) AS BIGINT) tokens FROM dr GROUP BY 2, 3 UNION ALL SELECT 'out', provider, model, CAST(sum(tokens_out) AS BIGINT) FROM dr GROUP BY 2, 3"""
)
def token_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_counters(_drafts(spark, d))


# --- proposals --------------------------------------------------------------


@query(
    """WITH p AS (SELECT conv_id || '_' || turn id, role, CASE WHEN turn % 3 = 0 THEN '' ELSE text END summary, text, turn FROM conversations)
    SELECT id, concat_ws(',', CASE WHEN length(summary) NOT BETWEEN 1 AND 400 THEN 'summary_length' END, CASE WHEN length(text) = 0 THEN 'patch_missing' END,
        CASE WHEN turn % 2 = 1 THEN 'test_not_allowed' END, CASE WHEN role <> 'user' THEN 'column_not_in_source' END) reasons FROM p"""
)
def proposal_checks(spark: SparkSession, d: str) -> DataFrame:
    c = derive.table(spark, d, "conversations")
    tests = F.when(F.col("turn") % 2 == 1, F.array(F.lit("unique"), F.lit("positive"))).otherwise(F.array(F.lit("not_null")))
    proposals = c.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.lit("raw.t").alias("table"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("summary"),
        F.col("text").alias("patched_sources_yml"),
        tests.alias("tests_to_add"),
        F.array(F.lit("user"), F.col("role")).alias("referenced_columns"),
    )
    allowed = c.where(F.col("role") == "user").select(F.lit("raw.t").alias("table"), F.col("role").alias("column")).distinct()
    return quality.check_proposals(proposals, allowed).select("id", F.array_join("reasons", ",").alias("reasons"))


# --- data tests -------------------------------------------------------------


@query(
    """SELECT 'quality' "column", CAST(count_if(quality IS NULL) AS BIGINT) violations FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'lang', CAST(count_if(lang IS NULL) AS BIGINT) FROM documents UNION ALL SELECT 'text', CAST(count_if(text IS NULL) AS BIGINT) FROM documents"""
)
def not_null(spark: SparkSession, d: str) -> DataFrame:
    joined = derive.table(spark, d, "documents").join(derive.table(spark, d, "labels"), "doc_id", "left")
    return quality.not_null(joined, ["quality", "lang", "text"])


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.unique(derive.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def accepted_values(spark: SparkSession, d: str) -> DataFrame:
    return quality.accepted_values(derive.table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT user_id, CAST(count(*) AS BIGINT) n FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def relationships(spark: SparkSession, d: str) -> DataFrame:
    return quality.relationships(derive.table(spark, d, "events"), "user_id", derive.table(spark, d, "supplier"), "s_suppkey")


@query(
    """SELECT unnest(['narrow_price', 'narrow_key', 'shorten_priority', 'tighten_status', 'precision_price']) "check",
    unnest(['o_totalprice', 'o_custkey', 'o_orderpriority', 'o_orderstatus', 'o_totalprice']) "column",
    unnest([count_if(o_totalprice <> trunc(o_totalprice)), count_if(o_custkey > 127), count_if(length(o_orderpriority) > 6), count_if(o_orderstatus IS NULL),
        count_if(abs(o_totalprice) >= 100000)]) blocking_rows FROM orders"""
)
def preflight(spark: SparkSession, d: str) -> DataFrame:
    return quality.preflight(
        derive.table(spark, d, "orders"),
        {
            "narrow_price": ("o_totalprice", quality.does_not_cast("o_totalprice", "INT")),
            "narrow_key": ("o_custkey", quality.does_not_cast("o_custkey", "TINYINT")),
            "shorten_priority": ("o_orderpriority", quality.too_long("o_orderpriority", 6)),
            "tighten_status": ("o_orderstatus", F.col("o_orderstatus").isNull()),
            "precision_price": ("o_totalprice", quality.out_of_range("o_totalprice", 7, 2)),
        },
    )


# --- sample models ----------------------------------------------------------


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = quality.stage(
        derive.table(spark, d, "orders"),
        {"order_id": "o_orderkey", "customer_id": "o_custkey", "amount": "o_totalprice", "status": "o_orderstatus", "created_at": "o_orderdate"},
    )
    customers = quality.stage(
        derive.table(spark, d, "customer"),
        {"customer_id": "c_custkey", "name": "c_name", "email": "c_mktsegment", "created_at": "c_nationkey"},
    )
    return orders, customers


@query("SELECT o_orderkey order_id, o_custkey customer_id, o_totalprice amount, o_orderstatus status, strftime(o_orderdate, '%Y-%m-%d') created_on FROM orders")
def staging_orders(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d)[0].withColumn("created_on", F.date_format("created_at", "yyyy-MM-dd")).drop("created_at")


@query("SELECT c_custkey customer_id, c_name AS name, c_mktsegment email, c_nationkey created_at FROM customer")
def staging_customers(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d)[1]


@query(
    """SELECT o_orderkey order_id, o_custkey customer_id, c_name customer_name, c_mktsegment customer_email, o_totalprice amount, o_orderstatus status,
    strftime(o_orderdate, '%Y-%m-%d') ordered_on FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def orders_fact(spark: SparkSession, d: str) -> DataFrame:
    fact = quality.orders_fact(*_staged(spark, d))
    return fact.withColumn("ordered_on", F.date_format("ordered_at", "yyyy-MM-dd")).drop("ordered_at")


@query(
    """SELECT strftime(o_orderdate, '%Y-%m-%d') order_date, CAST(count(*) AS BIGINT) orders, round(sum(o_totalprice), 2) gross_revenue,
    CAST(count(DISTINCT o_custkey) AS BIGINT) unique_customers FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"""
)
def daily_revenue(spark: SparkSession, d: str) -> DataFrame:
    daily = quality.daily_revenue(quality.orders_fact(*_staged(spark, d)), "P")
    return daily.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")).withColumn(
        "gross_revenue", F.round("gross_revenue", 2)
    )
