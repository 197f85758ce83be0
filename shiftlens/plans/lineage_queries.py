"""Registered queries: graph closure, impact, column lineage, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions.durable import cut
from shiftlens.operators import column_lineage as cl
from shiftlens.operators import dashboards, graph, lineage
from shiftlens.plans import derive
from shiftlens.plans.register import Registry

registry = Registry()
query = registry.query

# --- node graph -------------------------------------------------------------

_GRAPH = """
li AS (SELECT DISTINCT l_orderkey ok, l_linenumber n, l_partkey pk, l_suppkey sk FROM lineitem),
edges AS (
    SELECT 'source.geo.r' || n_regionkey src, 'model.n' || n_nationkey dst FROM nation
    UNION SELECT 'model.n' || c_nationkey, 'model.c' || c_custkey FROM customer
    UNION SELECT 'model.n' || s_nationkey, 'model.s' || s_suppkey FROM supplier
    UNION SELECT 'model.c' || o_custkey, 'model.o' || o_orderkey FROM orders
    UNION SELECT 'model.o' || o_orderkey, 'exposure.' || o_orderpriority FROM orders
    UNION SELECT 'model.o' || ok, 'model.l' || ok || '_' || n FROM li
    UNION SELECT 'model.s' || sk, 'model.l' || ok || '_' || n FROM li
    UNION SELECT 'source.cat.p' || pk, 'model.l' || ok || '_' || n FROM li),
seeds AS (SELECT 'source.geo.r' || r_regionkey seed FROM region UNION ALL SELECT 'source.cat.p' || p_partkey FROM part),
clo AS (SELECT seed, dst node FROM seeds JOIN edges ON src = seed UNION SELECT seed, dst FROM clo JOIN edges ON src = node)
"""


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = derive.graph(spark, d)
    return nodes.where(F.col("kind") == "source").select("project", F.col("node_id").alias("seed")), nodes, edges


@query("WITH RECURSIVE " + _GRAPH + "SELECT seed, node node_id FROM clo")
def node_closure(spark: SparkSession, d: str) -> DataFrame:
    seeds, nodes, edges = _sources(spark, d)
    return lineage.node_closure(seeds, edges, nodes).select("seed", "node_id")


_REQUESTS = """
req AS (SELECT 'geo.r' || r_regionkey || '.name' source_identifier, 'source.geo.r' || r_regionkey seed FROM region
    UNION ALL SELECT 'cat' || p_size || '.p' || p_partkey, 'source.cat.p' || p_partkey FROM part
    UNION ALL SELECT 'nowhere.s' || s_suppkey, NULL FROM supplier
    UNION ALL SELECT 'cat' || p_size, 'source.cat.p' || min(p_partkey) FROM part GROUP BY p_size)
"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: derive.table(spark, d, name)
    cat = F.concat(F.lit("cat"), "p_size")
    rows = (
        t("region").select(F.concat(F.lit("geo.r"), "r_regionkey", F.lit(".name")).alias("source_identifier"))
        .unionByName(t("part").select(F.concat(cat, F.lit(".p"), "p_partkey").alias("source_identifier")))
        .unionByName(t("supplier").select(F.concat(F.lit("nowhere.s"), "s_suppkey").alias("source_identifier")))
        .unionByName(t("part").select(cat.alias("source_identifier")).distinct())
    )
    return rows.withColumn("project", F.lit("tpc"))


@query("WITH RECURSIVE " + _GRAPH + "," + _REQUESTS + "SELECT source_identifier, seed node_id FROM req")
def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = derive.graph(spark, d)
    return lineage.find_sources(_requests(spark, d), nodes).select("source_identifier", "node_id")


@query(
    "WITH RECURSIVE "
    + _GRAPH
    + ","
    + _REQUESTS
    + """, fan AS (SELECT 'model.o' || o_orderkey node FROM orders WHERE o_orderkey % 100 = 0),
    s AS (SELECT seed, CAST(count_if(node LIKE 'model.%') AS BIGINT) models, CAST(count_if(node LIKE 'exposure.%') AS BIGINT) exposures,
        bool_or(node IN (SELECT node FROM fan)) wide FROM clo GROUP BY 1)
    SELECT source_identifier, coalesce(models, 0) models, coalesce(exposures, 0) exposures,
        CAST(coalesce(models, 0) + 3 * coalesce(exposures, 0) AS DOUBLE) blast_radius_score,
        CASE WHEN req.seed IS NULL THEN 'low' WHEN wide THEN 'medium' ELSE 'high' END lineage_confidence, coalesce(wide, false) fan_out_conservative
    FROM req LEFT JOIN s ON s.seed = req.seed"""
)
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by masks: no row for each source and node below it."""
    nodes, edges = derive.graph(spark, d)
    located = cut(lineage.find_sources(_requests(spark, d), nodes), "located")
    seeds = located.where(F.col("node_id").isNotNull()).select("project", F.col("node_id").alias("seed"))
    fan_out = derive.table(spark, d, "orders").where(F.col("o_orderkey") % 100 == 0).select(
        F.lit("tpc").alias("project"), F.concat(F.lit("model.o"), "o_orderkey").alias("node_id")
    )
    return lineage.summary(located, lineage.impact_counts(seeds, nodes, edges, fan_out)).drop("project", "node_id")


@query(
    "WITH RECURSIVE "
    + _GRAPH
    + """SELECT seed, CASE WHEN node LIKE 'model.%' THEN 'model' ELSE 'exposure' END kind, CASE WHEN node LIKE 'model.%' THEN substr(node, 7) ELSE substr(node, 10) END AS name FROM clo"""
)
def impact_models(spark: SparkSession, d: str) -> DataFrame:
    return lineage.affected(*_sources(spark, d)).select("seed", "kind", "name")


_LEVELS = """
lev AS (
    SELECT 'source.geo.r' || r_regionkey node_id, 0 AS lvl FROM region WHERE 'source.geo.r' || r_regionkey NOT IN (SELECT dst FROM edges)
    UNION ALL SELECT 'source.cat.p' || p_partkey, 0 FROM part
    UNION ALL SELECT 'model.n' || n_nationkey, 1 FROM nation
    UNION ALL SELECT 'model.c' || c_custkey, 2 FROM customer
    UNION ALL SELECT 'model.s' || s_suppkey, 2 FROM supplier
    UNION ALL SELECT 'model.o' || o_orderkey, 3 FROM orders
    UNION ALL SELECT DISTINCT 'model.l' || ok || '_' || n, 4 FROM li
    UNION ALL SELECT DISTINCT 'exposure.' || o_orderpriority, 4 FROM orders)
"""


@query("WITH RECURSIVE " + _GRAPH + "," + _LEVELS + "SELECT node_id, CAST(lvl AS INTEGER) AS level FROM lev")
def topo_levels(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = derive.graph(spark, d)
    return graph.levels(nodes, edges, ["project", "node_id"], ["project", "src"], ["project", "dst"]).drop("project")


# --- column lineage ---------------------------------------------------------

# The oracle spells out each kind of select the derivation uses.
_COLS = """
cu AS (SELECT c_custkey ck, c_nationkey % 5 w FROM customer),
dec AS (SELECT 'source.raw.cust' || ck node, i pos, 'a' || i col, ck, w FROM cu, range(4) r(i) WHERE i < w),
o AS (SELECT o_orderkey k, o_custkey ck, o_orderkey % 6 v, 'model.ord' || o_orderkey node, 'source.raw.cust' || o_custkey src, w FROM orders JOIN cu ON ck = o_custkey),
ocol AS (  -- node, pos, col, src columns
    SELECT node, src, 1 pos, 'x0' col, ['a0'] refs, v FROM o WHERE v IN (0, 3)
    UNION ALL SELECT node, src, 2, 'x1', ['a1'], v FROM o WHERE v = 0
    UNION ALL SELECT o.node, src, pos + 1, col, [col], v FROM o JOIN dec USING (ck) WHERE v IN (1, 2)
    UNION ALL SELECT node, src, w + 1, 'extra', ['a0'], v FROM o WHERE v = 2 AND w > 0
    UNION ALL SELECT node, src, 2, 'both', ['a1', 'a2'], v FROM o WHERE v = 3
    UNION ALL SELECT node, src, 3, 'one', [], v FROM o WHERE v = 3
    UNION ALL SELECT node, src, 1, 'y0', ['a0'], v FROM o WHERE v = 4
    UNION ALL SELECT node, src, 2, 'z1', ['a1'], v FROM o WHERE v = 4
    UNION ALL SELECT node, src, 3, 'gone', [], v FROM o WHERE v = 4
    UNION ALL SELECT node, src, 1, 'u0', ['a0', 'a2'], v FROM o WHERE v = 5 AND k % 12 <> 11
    UNION ALL SELECT node, src, 2, 'u1', ['a1', 'a3'], v FROM o WHERE v = 5 AND k % 12 <> 11),
ofail AS (SELECT node FROM o WHERE (v IN (1, 2) AND w = 0) OR k % 12 = 11),
l AS (SELECT DISTINCT l_orderkey k, l_linenumber n, l_linenumber % 3 v, 'model.li' || l_orderkey || '_' || l_linenumber node, 'model.ord' || l_orderkey src FROM lineitem),
lcol AS (
    SELECT l.node, l.src, pos, col, [col] refs FROM l JOIN ocol ON ocol.node = l.src WHERE l.v = 0
    UNION ALL SELECT node, src, 1, 'h', ['x0'] FROM l WHERE v = 1
    UNION ALL SELECT node, src, 1, 'k', ['u0'] FROM l WHERE v = 2
    UNION ALL SELECT node, src, 2, 'k2', [] FROM l WHERE v = 2),
lfail AS (SELECT l.node FROM l WHERE v = 0 AND src NOT IN (SELECT node FROM ocol)),
mcol AS (SELECT node, pos, col FROM ocol UNION ALL SELECT node, pos, col FROM lcol),
cedge AS (SELECT DISTINCT src src_node, unnest(refs) src_col, node dst_node, col dst_col FROM (SELECT node, src, col, refs FROM ocol UNION ALL SELECT node, src, col, refs FROM lcol)),
fan AS (SELECT node FROM ofail UNION ALL SELECT node FROM lfail),
nedge AS (SELECT src, node dst FROM o UNION ALL SELECT src, node FROM l)
"""


def _lineage(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], cl.ColumnLineage]:
    t = derive.projection_tables(spark, d)
    return t, cl.column_lineage(t["nodes"], t["edges"], t["scopes"], t["projections"], t["source_columns"])


@query("WITH " + _COLS + "SELECT src_node, src_col, dst_node, dst_col FROM cedge")
def column_edges(spark: SparkSession, d: str) -> DataFrame:
    return _lineage(spark, d)[1].column_edges.drop("project")


@query("WITH " + _COLS + 'SELECT node node_id, CAST(pos AS BIGINT) pos, col "column" FROM mcol')
def star_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Output columns of every model, stars expanded in table order."""
    return _lineage(spark, d)[1].model_columns.drop("project")


@query("WITH " + _COLS + "SELECT node node_id FROM fan")
def fan_out_models(spark: SparkSession, d: str) -> DataFrame:
    return _lineage(spark, d)[1].fan_out.drop("project")


@query(
    "WITH "
    + _COLS
    + """SELECT src_node, src_col, dst_node, dst_col FROM cedge JOIN o ON o.node = dst_node WHERE o.v = 5"""
)
def union_merge(spark: SparkSession, d: str) -> DataFrame:
    """Edges of union models: names of the first leg, references of every leg."""
    return _lineage(spark, d)[1].union_edges.drop("project")


@query(
    "WITH "
    + _COLS
    + """SELECT src_node, src_col, dst_node, dst_col FROM cedge WHERE dst_node IN (SELECT node FROM o WHERE v = 4 UNION ALL SELECT node FROM l WHERE v = 1)"""
)
def cte_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Edges of models with CTEs: references through CTEs, and CTEs over CTEs, end at nodes."""
    return _lineage(spark, d)[1].cte_edges.drop("project")


@query(
    "WITH "
    + _COLS
    + """, sc AS (
        SELECT node, 'main' scope, 0 leg, CASE WHEN v = 4 THEN 'q' ELSE 'c' END al, CASE WHEN v = 4 THEN node ELSE src END rel_node, CASE WHEN v = 4 THEN 'q' ELSE 'main' END rel_scope FROM o
        UNION ALL SELECT node, 'q', 0, 'c', src, 'main' FROM o WHERE v = 4
        UNION ALL SELECT node, 'main', 1, 'd', src, 'main' FROM o WHERE v = 5
        UNION ALL SELECT node, 'main', 0, CASE WHEN v = 1 THEN 'f2' ELSE 'o' END, CASE WHEN v = 1 THEN node ELSE src END, CASE WHEN v = 1 THEN 'f2' ELSE 'main' END FROM l
        UNION ALL SELECT node, 'f2', 0, 'f1', node, 'f1' FROM l WHERE v = 1
        UNION ALL SELECT node, 'f1', 0, 'ord' || k, src, 'main' FROM l WHERE v = 1)
    SELECT node, scope, CAST(leg AS INTEGER) leg, al alias, rel_node, rel_scope FROM sc"""
)
def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    t = derive.projection_tables(spark, d)
    return cl.resolve_tables(t["scopes"], t["edges"]).select("node", "scope", "leg", "alias", "rel_node", "rel_scope")


@query(
    "WITH RECURSIVE "
    + _COLS
    + """, seeds AS (SELECT 'source.raw.cust' || ck seed, ck FROM cu),
    nc AS (SELECT DISTINCT seed, dst n FROM seeds JOIN nedge ON src = seed UNION SELECT seed, dst FROM nc JOIN nedge ON src = n),
    s AS (SELECT seed, count(*) models, bool_or(n IN (SELECT node FROM fan)) wide FROM nc GROUP BY 1)
    SELECT 'raw.cust' || ck || '.a0' source_identifier, CAST(coalesce(models, 0) AS BIGINT) models, CAST(coalesce(models, 0) AS DOUBLE) blast_radius_score,
        CASE WHEN wide THEN 'medium' ELSE 'high' END lineage_confidence, coalesce(wide, false) fan_out_conservative
    FROM seeds LEFT JOIN s USING (seed)"""
)
def impact_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Impact of every source, less certain where column lineage could not resolve a model below it."""
    t, found = _lineage(spark, d)
    customers = derive.table(spark, d, "customer")
    requests = customers.select(F.lit("tpc").alias("project"), F.concat(F.lit("raw.cust"), "c_custkey", F.lit(".a0")).alias("source_identifier"))
    located = cut(lineage.find_sources(requests, t["nodes"]), "located")
    counted = lineage.impact_counts(located.select("project", F.col("node_id").alias("seed")), t["nodes"], t["edges"], cut(found.fan_out, "fan-out"))
    return lineage.summary(located, counted).select("source_identifier", "models", "blast_radius_score", "lineage_confidence", "fan_out_conservative")


_SEEDS = """
seeds AS (SELECT 'source.raw.cust' || ck seed, 'a0' sc FROM cu UNION ALL SELECT 'source.raw.cust' || ck, 'a1' FROM cu),
known AS (SELECT node, col FROM dec UNION SELECT node, col FROM mcol UNION SELECT src_node, src_col FROM cedge)
"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return derive.table(spark, d, "customer").select(
        F.lit("tpc").alias("project"),
        F.concat(F.lit("source.raw.cust"), "c_custkey").alias("seed"),
        F.explode(F.array(F.lit("a0"), F.lit("a1"))).alias("seed_column"),
    )


@query(
    "WITH RECURSIVE "
    + _COLS
    + ","
    + _SEEDS
    + """, c AS (SELECT seed, sc, dst_node n, dst_col col FROM seeds JOIN cedge ON src_node = seed AND src_col = sc
        UNION SELECT seed, sc, dst_node, dst_col FROM c JOIN cedge ON src_node = n AND src_col = col)
    SELECT seed, sc seed_column, n node_id, col "column" FROM c"""
)
def column_closure(spark: SparkSession, d: str) -> DataFrame:
    _, found = _lineage(spark, d)
    return lineage.column_closure(_seeds(spark, d), found.column_edges).drop("project")


@query(
    "WITH RECURSIVE "
    + _COLS
    + ","
    + _SEEDS
    + """, c AS (SELECT seed, sc, dst_node n, dst_col col FROM seeds JOIN cedge ON src_node = seed AND src_col = sc
        UNION SELECT seed, sc, dst_node, dst_col FROM c JOIN cedge ON src_node = n AND src_col = col),
    nc AS (SELECT DISTINCT seed, dst n FROM seeds JOIN nedge ON src = seed UNION SELECT seed, dst FROM nc JOIN nedge ON src = n),
    hit AS (SELECT seed, n FROM nc WHERE n IN (SELECT node FROM fan)),
    wide AS (SELECT seed, n FROM hit UNION SELECT seed, dst FROM wide JOIN nedge ON src = n),
    res AS (SELECT seed, sc, n, col FROM c
        UNION SELECT seed, sc, n, col FROM seeds JOIN wide USING (seed) JOIN mcol ON node = n WHERE (seed, sc) IN (SELECT node, col FROM known)
        UNION SELECT seed, sc, n, col FROM seeds JOIN nc USING (seed) JOIN mcol ON node = n WHERE (seed, sc) NOT IN (SELECT node, col FROM known))
    SELECT seed, sc seed_column, substr(n, 7) AS name, col "column" FROM res"""
)
def widened_columns(spark: SparkSession, d: str) -> DataFrame:
    """Affected columns, widened below unresolved models, with the fallback for unknown columns."""
    t, found = _lineage(spark, d)
    return lineage.impact_columns(
        _seeds(spark, d), t["nodes"], t["edges"], cut(found.column_edges), t["source_columns"], cut(found.model_columns), cut(found.fan_out)
    ).drop("project")


@query(
    "WITH RECURSIVE "
    + _COLS
    + """, seeds AS (SELECT 'source.raw.cust' || ck seed FROM cu),
    nc AS (SELECT DISTINCT seed, dst n FROM seeds JOIN nedge ON src = seed UNION SELECT seed, dst FROM nc JOIN nedge ON src = n)
    SELECT DISTINCT seed, substr(n, 7) AS name, col "column" FROM nc JOIN mcol ON node = n"""
)
def unknown_column_fallback(spark: SparkSession, d: str) -> DataFrame:
    t, found = _lineage(spark, d)
    seeds = derive.table(spark, d, "customer").select(
        F.lit("tpc").alias("project"),
        F.concat(F.lit("source.raw.cust"), "c_custkey").alias("seed"),
        F.lit("never_declared").alias("seed_column"),
    )
    rows = lineage.impact_columns(
        seeds, t["nodes"], t["edges"], cut(found.column_edges), t["source_columns"], cut(found.model_columns), cut(found.fan_out)
    )
    return rows.select("seed", "name", "column")


@query(
    "WITH "
    + _COLS
    + """, known AS (SELECT node, col FROM dec UNION SELECT node, col FROM mcol UNION SELECT src_node, src_col FROM cedge)
    SELECT CAST((SELECT count(*) FROM cu) + (SELECT count(*) FROM o) + (SELECT count(*) FROM l) AS BIGINT) nodes,
        CAST((SELECT count(*) FROM nedge) AS BIGINT) edges, CAST((SELECT count(*) FROM known) AS BIGINT) column_nodes, CAST((SELECT count(*) FROM fan) AS BIGINT) fan_out"""
)
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    t, found = _lineage(spark, d)
    known = lineage.column_nodes(t["source_columns"], found.model_columns, found.column_edges)
    return lineage.graph_summary(t["nodes"], t["edges"], known, found.fan_out).drop("project")


@query("WITH " + _COLS + """SELECT rule, CAST(count(*) AS BIGINT) n FROM (SELECT 'self_loop' rule FROM cedge WHERE src_node = dst_node AND src_col = dst_col
    UNION ALL SELECT 'unknown_node' FROM dec WHERE node NOT IN (SELECT src FROM nedge) AND node NOT IN (SELECT 'source.raw.cust' || ck FROM cu)
    UNION ALL SELECT 'checked' FROM cedge) GROUP BY 1""")
def graph_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Violations per rule next to the number of checked edges; a sound graph has only the latter."""
    t, found = _lineage(spark, d)
    edges = found.column_edges
    known = lineage.column_nodes(t["source_columns"], found.model_columns, edges)
    broken = lineage.graph_violations(t["nodes"], t["edges"], known, edges).select("rule")
    return broken.unionByName(edges.select(F.lit("checked").alias("rule"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# --- dashboards -------------------------------------------------------------

_WORDS = """
card AS (SELECT 'page' || page_id id, html txt, url nm FROM pages UNION ALL SELECT 'doc' || doc_id, text, source || ' finance' FROM documents
    UNION ALL SELECT 'order' || o_orderkey, 'select x from analytics.c' || o_custkey || ', b join ("model"."o' || o_orderkey || '") on 1=1 FROM (SELECT 1)',
        CASE WHEN o_orderkey % 3 = 0 THEN 'Exec ' || o_orderpriority ELSE o_orderpriority END FROM orders),
tok AS (SELECT id, nm, unnest(list_filter(string_split(trim(regexp_replace(txt, '[\\s,]+', ' ', 'g')), ' '), lambda x: x <> '')) t,
    generate_subscripts(list_filter(string_split(trim(regexp_replace(txt, '[\\s,]+', ' ', 'g')), ' '), lambda x: x <> ''), 1) i FROM card),
nxt AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY i) nt FROM tok),
refs AS (SELECT DISTINCT id, nm, lower(trim(split_part(trim(nt, '();'), '.', -1), '"`')) model FROM nxt
    WHERE upper(trim(t, '();')) IN ('FROM', 'JOIN') AND nt IS NOT NULL),
good AS (SELECT *, CASE WHEN regexp_matches(lower(nm), 'exec|board|finance') THEN 'critical' ELSE 'normal' END tier FROM refs WHERE model NOT IN ('', 'select'))
"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Card texts: whole pages, whole documents, and one query per order."""
    t = lambda name: derive.table(spark, d, name)
    key = F.col("o_orderkey")
    sql = F.concat(
        F.lit("select x from analytics.c"), "o_custkey", F.lit(', b join ("model"."o'), key, F.lit('") on 1=1 FROM (SELECT 1)')
    )
    name = F.when(key % 3 == 0, F.concat(F.lit("Exec "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return (
        t("pages").select(F.concat(F.lit("page"), "page_id").alias("id"), F.col("url").alias("name"), F.col("html").alias("sql"))
        .unionByName(
            t("documents").select(
                F.concat(F.lit("doc"), "doc_id").alias("id"), F.concat("source", F.lit(" finance")).alias("name"), F.col("text").alias("sql")
            )
        )
        .unionByName(t("orders").select(F.concat(F.lit("order"), key).alias("id"), name.alias("name"), sql.alias("sql")))
    )


@query("WITH " + _WORDS + "SELECT id, model FROM good")
def dashboard_refs(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.dashboard_refs(cards(spark, d)).select("id", "model")


@query(
    "WITH "
    + _WORDS
    + "SELECT DISTINCT id, nm AS name, tier, 'metabase' tool, 'http://bi.local/question/' || id url FROM good"
)
def dashboard_tiers(spark: SparkSession, d: str) -> DataFrame:
    refs = dashboards.dashboard_refs(cards(spark, d), "http://bi.local")
    return refs.select("id", "name", "tier", "tool", "url").distinct()


@query(
    "WITH "
    + _WORDS
    + "SELECT model, CAST(count(*) AS BIGINT) dashboards, CAST(count_if(tier = 'critical') AS BIGINT) critical FROM good GROUP BY 1"
)
def model_dashboards(spark: SparkSession, d: str) -> DataFrame:
    refs = dashboards.dashboard_refs(cards(spark, d))
    return refs.groupBy("model").agg(
        F.count(F.lit(1)).alias("dashboards"), F.count_if(F.col("tier") == "critical").alias("critical")
    )


@query(
    "WITH RECURSIVE "
    + _GRAPH
    + ","
    + _WORDS
    + ","
    + _REQUESTS
    + """, im AS (SELECT seed, substr(node, 7) model FROM clo WHERE node LIKE 'model.%'),
    dd AS (SELECT DISTINCT seed, id, tier FROM im JOIN good USING (model)),
    s AS (SELECT seed, count_if(node LIKE 'model.%') models, count_if(node LIKE 'exposure.%') exposures FROM clo GROUP BY 1),
    x AS (SELECT seed, count(*) n, count_if(tier = 'critical') c FROM dd GROUP BY 1),
    ft AS (SELECT seed, count(*) f FROM im JOIN orders ON model = 'o' || o_orderkey WHERE o_orderkey % 50 = 0 GROUP BY 1),
    sv AS (SELECT *, CASE length(source_identifier) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END sev FROM req)
    SELECT source_identifier, CAST(coalesce(models, 0) AS BIGINT) models, CAST(coalesce(exposures, 0) AS BIGINT) exposures, CAST(coalesce(n, 0) AS BIGINT) dashboards,
        CAST(coalesce(c, 0) AS BIGINT) critical_dashboards, CAST(coalesce(f, 0) AS BIGINT) ml_features, coalesce(c, 0) > 0 critical_gate,
        CAST(coalesce(models, 0) + 3 * coalesce(n, 0) + CASE WHEN f > 0 THEN 5 ELSE 0 END + CASE sev WHEN 'high' THEN 10 WHEN 'medium' THEN 3 ELSE 1 END AS DOUBLE) weighted_score
    FROM sv LEFT JOIN s USING (seed) LEFT JOIN x USING (seed) LEFT JOIN ft USING (seed)"""
)
def impact_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Every request with its models, exposures, dashboards and features, counted in one pass of masks."""
    nodes, edges = derive.graph(spark, d)
    located = cut(lineage.find_sources(_requests(spark, d), nodes), "located")
    seeds = located.where(F.col("node_id").isNotNull()).select("project", F.col("node_id").alias("seed"))
    project = F.lit("tpc").alias("project")
    order = F.col("o_orderkey")
    features = derive.table(spark, d, "orders").where(order % 50 == 0).select(project, F.concat(F.lit("o"), order).alias("model"), F.concat(F.lit("f"), order).alias("feature"))
    more_nodes, more_edges = dashboards.consumers(nodes, dashboards.dashboard_refs(cards(spark, d)).withColumn("project", project), features)
    every = nodes.select("project", "node_id", "kind").unionByName(cut(more_nodes, "consumers"))
    counted = lineage.impact_counts(seeds, every, edges.select("project", "src", "dst").unionByName(cut(more_edges, "reads")))
    numbers = list(lineage.KINDS.values())
    out = located.join(counted.withColumnRenamed("seed", "node_id"), ["project", "node_id"], "left").fillna(0, numbers)
    third = F.length("source_identifier") % 3
    out = out.withColumns({"critical_gate": F.col("critical_dashboards") > 0, "severity": F.when(third == 0, "high").when(third == 1, "medium").otherwise("low")})
    return dashboards.weighted_score(out).select("source_identifier", *numbers, "critical_gate", "weighted_score")
