"""Registered queries: diff, history, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.functions import types as ty
from shiftlens.functions.durable import cut, new_path
from shiftlens.operators import classify, diff, snapshots, store
from shiftlens.operators.metrics import event_counters
from shiftlens.plans import derive
from shiftlens.plans import oracle_parts as o
from shiftlens.plans.register import Registry

from shiftlens.sources import contract

registry = Registry()
query = registry.query


# --- diff -------------------------------------------------------------------


@query(
    o.changes()
    + """SELECT src source_identifier, tbl table_identifier, 'table_added' kind FROM ta WHERE (src, tbl) NOT IN (SELECT src, tbl FROM tb)
    UNION ALL SELECT src, tbl, 'table_removed' FROM tb WHERE (src, tbl) NOT IN (SELECT src, tbl FROM ta)"""
)
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    sides = derive.catalogue_pair(spark, d).select("source_identifier", "seq", "table_identifier", "is_curr")
    return diff.table_changes(diff.table_presence(sides)).drop("seq")


@query(
    o.changes()
    + "SELECT src source_identifier, tbl table_identifier, nm AS name, kind, bty before_type, aty after_type FROM raw"
)
def column_diff(spark: SparkSession, d: str) -> DataFrame:
    return derive.pair_changes(spark, d).where(F.col("name").isNotNull()).select(
        "source_identifier",
        "table_identifier",
        "name",
        "kind",
        F.col("column_before.data_type").alias("before_type"),
        F.col("column_after.data_type").alias("after_type"),
    )


@query(
    o.changes()
    + """SELECT field, CAST(count(*) AS BIGINT) n FROM (
        SELECT unnest([CASE WHEN bty <> aty THEN 'data_type' END, CASE WHEN bnl <> anl THEN 'nullable' END,
            CASE WHEN bdf IS DISTINCT FROM adf THEN 'default' END, CASE WHEN bpk <> apk THEN 'is_primary_key' END,
            CASE WHEN bml IS DISTINCT FROM aml THEN 'character_max_length' END, CASE WHEN bnp IS DISTINCT FROM anp THEN 'numeric_precision' END,
            CASE WHEN bns IS DISTINCT FROM ans THEN 'numeric_scale' END, CASE WHEN ben IS DISTINCT FROM aen THEN 'enum_values' END]) field
        FROM raw WHERE kind = 'modified') WHERE field IS NOT NULL GROUP BY 1"""
)
def modified_fields(spark: SparkSession, d: str) -> DataFrame:
    return diff.modified_fields(derive.pair_changes(spark, d)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(
    o.changes(
        """allch AS (SELECT src, tbl, '' nm, 'table_added' kind, 0 lvl, 0 kr FROM ta WHERE (src, tbl) NOT IN (SELECT src, tbl FROM tb)
        UNION ALL SELECT src, tbl, '', 'table_removed', 1, 1 FROM tb WHERE (src, tbl) NOT IN (SELECT src, tbl FROM ta)
        UNION ALL SELECT src, tbl, nm, kind, 2, CASE kind WHEN 'added' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END FROM raw)"""
    )
    + """SELECT src source_identifier, tbl table_identifier, nm AS name, kind,
        row_number() OVER (PARTITION BY src ORDER BY lvl, tbl, kr, nm) change_seq FROM allch"""
)
def ordered_changes(spark: SparkSession, d: str) -> DataFrame:
    from shiftlens.functions.ranking import ordered_rank

    ordered = diff.change_order(derive.pair_changes(spark, d)).select(
        "source_identifier", "table_identifier", F.coalesce("name", F.lit("")).alias("name"), "kind", "change_order"
    )
    # ranking reads its rows several times
    return ordered_rank(cut(ordered, "ordered"), ["source_identifier"], ["change_order"], "change_seq").drop("change_order")


@query(
    "WITH "
    + o.HISTORY
    + """SELECT src source_identifier, seq, tbl table_identifier, nm AS name, kind, bty before_type, aty after_type FROM hraw
    UNION ALL SELECT src, seq, tbl, NULL, kind, NULL, NULL FROM htabch"""
)
def history_diff(spark: SparkSession, d: str) -> DataFrame:
    return derive.history_changes(spark, d).select(
        "source_identifier",
        "seq",
        "table_identifier",
        "name",
        "kind",
        F.col("column_before.data_type").alias("before_type"),
        F.col("column_after.data_type").alias("after_type"),
    )


# --- snapshot store ---------------------------------------------------------


@query(
    "WITH "
    + o.HISTORY
    + "SELECT src source_identifier, src || '@' || strftime(d, '%Y-%m-%d') snapshot_id, seq, seq = 1 is_baseline, seq = cnt is_last FROM hs"
)
def snapshot_sequence(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.sequence(derive.history_headers(spark, d)).select(
        "source_identifier", "snapshot_id", "seq", "is_baseline", "is_last"
    )


@query(
    "WITH "
    + o.HISTORY
    + ","
    + o.SEVERITY
    + ","
    + o.LATTICE
    + """SELECT hs.src source_identifier, hs.seq, hs.seq = 1 is_baseline, CAST(coalesce(n, 0) AS BIGINT) event_count FROM hs LEFT JOIN (
        SELECT src, seq, count(*) n FROM hraw
        WHERE kind <> 'modified' OR bty <> aty OR (bnl AND NOT anl) GROUP BY 1, 2) e USING (src, seq)"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    events = classify.classify_single(derive.history_changes(spark, d))
    return snapshots.run_summary(snapshots.sequence(derive.history_headers(spark, d)), events)


@query(
    "WITH "
    + o.HISTORY
    + """SELECT src source_identifier, src || '@' || strftime(max(d), '%Y-%m-%d') snapshot_id, strftime(max(d), '%Y-%m-%d') captured_on FROM hs GROUP BY 1"""
)
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    newest = snapshots.latest(derive.history_headers(spark, d))
    return newest.select("source_identifier", "snapshot_id", F.date_format("captured_at", "yyyy-MM-dd").alias("captured_on"))


@query("WITH " + o.HISTORY + "SELECT src source_identifier, CAST(count(*) AS BIGINT) snapshots FROM hs GROUP BY ROLLUP (src)")
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.counts(derive.history_headers(spark, d))


@query(
    "WITH "
    + o.HISTORY
    + """SELECT src source_identifier, src || '@' || strftime(d, '%Y-%m-%d') snapshot_id FROM hs WHERE day(d) % 3 <> 0"""
)
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    """Every event brings its snapshot header; ids of every third day are stored already."""
    e = derive.table(spark, d, "events")
    source, day = F.concat(F.lit("s"), F.col("user_id") % 20), F.date_trunc("day", "ts")
    incoming = e.select(
        source.alias("source_identifier"),
        F.concat_ws("@", source, F.date_format(day, "yyyy-MM-dd")).alias("snapshot_id"),
        F.col("ts").alias("captured_at"),
    )
    stored = derive.history_headers(spark, d).where(F.dayofmonth("captured_at") % 3 == 0)
    return snapshots.new_snapshots(incoming, stored).drop("captured_at")


@query(
    "WITH "
    + o.HISTORY
    + """SELECT src source_identifier, src || '@' || strftime(d, '%Y-%m-%d') snapshot_id, CAST(count(*) AS BIGINT) column_rows,
    d = max(d) OVER (PARTITION BY src) newest FROM he GROUP BY src, d"""
)
def snapshot_store(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot with its columns, stored in three appends of which the last brings nothing new."""
    headers, columns = derive.history_headers(spark, d), derive.history_columns(spark, d)
    held = store.SnapshotStore(spark, new_path(spark, "store"))
    for some in (headers.where(F.dayofmonth("captured_at") % 3 == 0), headers, headers):
        held.append(some, columns)
    rows = held.columns(columns.schema).groupBy("source_identifier", "snapshot_id").agg(F.count(F.lit(1)).alias("column_rows"))
    newest = held.latest_columns(headers.schema, columns.schema).select("snapshot_id").distinct().withColumn("newest", F.lit(True))
    out = held.headers(headers.schema).join(rows, ["source_identifier", "snapshot_id"]).join(newest, "snapshot_id", "left")
    return out.select("source_identifier", "snapshot_id", "column_rows", F.coalesce("newest", F.lit(False)).alias("newest"))


@query(
    o.changes()
    + """SELECT src source_identifier, tbl table_identifier, nm AS name, ty data_type, nl nullable, df "default", pk is_primary_key, n ordinal_position, ml character_max_length,
    np numeric_precision, ns numeric_scale, en enum_text FROM aft"""
)
def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every column row, through its document and back."""
    curr = derive.catalogue_pair(spark, d).where("is_curr")
    keys = ("source_identifier", "table_identifier")
    back = snapshots.from_documents(snapshots.to_documents(curr, *keys), *keys)
    return back.withColumn("enum_text", F.array_join("enum_values", ",")).drop("enum_values")


@query(
    "WITH "
    + o.HISTORY
    + """SELECT src source_identifier, src || '@' || strftime(d, '%Y-%m-%d') snapshot_id, nm AS name, CAST(substr(nm, 2) AS INTEGER) ordinal_position, ty data_type, nl nullable
    FROM hc WHERE tbl = 'raw.click' AND nm = 'k3'"""
)
def column_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One column in every snapshot, out of all stored rows; of a column's repeated rows the last one counts."""
    found = snapshots.column_lookup(derive.history_columns(spark, d), "raw.click", "k3", "position")
    return found.select("source_identifier", "snapshot_id", "name", "ordinal_position", "data_type", "nullable")


@query(
    "WITH "
    + o.HISTORY
    + """SELECT src source_identifier, src || '@' || strftime(d, '%Y-%m-%d') snapshot_id, 'k' || kk AS name, (['integer','bigint','numeric(10,2)','text'])[v + 1] data_type,
    event_id % 2 = 0 nullable, CAST(kk AS INTEGER) ordinal_position FROM he WHERE tbl = 'raw.purchase'"""
)
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All rows of one table in every snapshot."""
    found = snapshots.table_lookup(derive.history_columns(spark, d), "raw.purchase")
    return found.select("source_identifier", "snapshot_id", "name", "data_type", "nullable", "ordinal_position")


# --- type predicates --------------------------------------------------------


@query(
    o.changes()
    + """SELECT ty data_type, regexp_replace(lower(trim(ty)), '\\s*\\(.*\\)\\s*$', '') family, CAST(count(*) AS BIGINT) n
    FROM (SELECT ty FROM bef UNION ALL SELECT ty FROM aft) GROUP BY 1, 2"""
)
def type_family(spark: SparkSession, d: str) -> DataFrame:
    pair = derive.catalogue_pair(spark, d)
    return pair.groupBy("data_type", ty.type_family(F.col("data_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    o.changes()
    + """SELECT bfam before_family, afam after_family, (bfam, afam) IN (SELECT lo, hi FROM lattice) widening,
        (afam, bfam) IN (SELECT lo, hi FROM lattice) narrowing,
        coalesce(aml > bml, false) grew, coalesce(aml < bml, false) shrank,
        bnp IS DISTINCT FROM anp OR bns IS DISTINCT FROM ans precision_moved,
        coalesce(starts_with(aen, ben || ','), false) enum_grew, CAST(count(*) AS BIGINT) n
    FROM raw WHERE kind = 'modified' GROUP BY ALL"""
)
def type_lattice_pairs(spark: SparkSession, d: str) -> DataFrame:
    raw = derive.pair_changes(spark, d).where(F.col("kind") == "modified")
    b, a = F.col("column_before"), F.col("column_after")
    bf, af = ty.type_family(b["data_type"]), ty.type_family(a["data_type"])
    return (
        raw.select(
            bf.alias("before_family"),
            af.alias("after_family"),
            ty.is_widening(bf, af).alias("widening"),
            ty.is_narrowing(bf, af).alias("narrowing"),
            ty.capacity_grew(b, a).alias("grew"),
            ty.capacity_shrank(b, a).alias("shrank"),
            ty.precision_moved(b, a).alias("precision_moved"),
            ty.enum_grew(b, a).alias("enum_grew"),
        )
        .groupBy("before_family", "after_family", "widening", "narrowing", "grew", "shrank", "precision_moved", "enum_grew")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_ALIAS_SQL = """CASE regexp_replace(lower(trim(t)), '\\s*\\(.*\\)\\s*$', '') WHEN 'int4' THEN 'integer' WHEN 'int8' THEN 'bigint'
    WHEN 'bpchar' THEN 'char' || regexp_extract(lower(t), '(\\(.*\\))\\s*$', 1) WHEN 'float8' THEN 'double precision' ELSE t END"""


@query(
    f"""WITH t AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'int4' WHEN 1 THEN 'int8' WHEN 2 THEN 'bpchar(' || p_size || ')' WHEN 3 THEN 'float8' ELSE 'text' END t FROM part)
    SELECT t data_type, {_ALIAS_SQL} canonical, CAST(count(*) AS BIGINT) n FROM t GROUP BY 1, 2"""
)
def type_aliases(spark: SparkSession, d: str) -> DataFrame:
    p = derive.table(spark, d, "part")
    spelled = F.get(
        F.array(F.lit("int4"), F.lit("int8"), F.concat(F.lit("bpchar("), "p_size", F.lit(")")), F.lit("float8"), F.lit("text")),
        (F.col("p_partkey") % 5).cast("int"),
    )
    rows = p.select(spelled.alias("data_type"))
    return rows.groupBy("data_type", ty.canonical_type(F.col("data_type")).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


# --- classification ---------------------------------------------------------

_SINGLE_COLS = f"""src source_identifier, tbl || '.' || nm identifier, change_type, severity,
    change_type IN {o.DESTRUCTIVE} destructive, change_type IN {o.BACKFILL} requires_backfill"""


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "source_identifier", "identifier", "change_type", "severity", "destructive", "requires_backfill"
    )


@query(o.changes() + f"SELECT {_SINGLE_COLS} FROM single")
def classify_single(spark: SparkSession, d: str) -> DataFrame:
    return _event_columns(classify.classify_single(derive.pair_changes(spark, d)))


@query(o.changes() + f"SELECT {_SINGLE_COLS} FROM batch")
def classify_batch(spark: SparkSession, d: str) -> DataFrame:
    return _event_columns(classify.classify_batch(derive.pair_changes(spark, d)))


@query(
    o.changes()
    + """SELECT src source_identifier, tbl table_identifier, old_name, new_name,
    'renamed from ''' || old_name || ''' → ''' || new_name || '''' note FROM matched WHERE kind = 'renamed'"""
)
def rename_pairs(spark: SparkSession, d: str) -> DataFrame:
    events = classify.classify_batch(derive.pair_changes(spark, d)).where(F.col("change_type") == "column_renamed")
    return events.select(
        "source_identifier",
        "table_identifier",
        F.col("column_before.name").alias("old_name"),
        F.col("column_after.name").alias("new_name"),
        F.get("notes", F.lit(0)).alias("note"),
    )


@query(o.changes() + "SELECT change_type, severity, CAST(count(*) AS BIGINT) n FROM batch GROUP BY 1, 2")
def drift_counters(spark: SparkSession, d: str) -> DataFrame:
    return event_counters(classify.classify_batch(derive.pair_changes(spark, d)))


@query(
    "WITH "
    + o.HISTORY
    + ","
    + o.SEVERITY
    + ","
    + o.LATTICE
    + """, fam AS (SELECT *, regexp_replace(bty, '\\s*\\(.*\\)\\s*$', '') bf, regexp_replace(aty, '\\s*\\(.*\\)\\s*$', '') af FROM hraw),
    t AS (SELECT CASE kind WHEN 'added' THEN CASE WHEN anl THEN 'column_added_nullable' ELSE 'column_added_not_null_no_default' END
        WHEN 'removed' THEN 'column_dropped' ELSE CASE WHEN bnl AND NOT anl THEN 'nullability_tightened'
        WHEN bf <> af THEN CASE WHEN (bf, af) IN (SELECT lo, hi FROM lattice) THEN 'type_widened'
            WHEN (af, bf) IN (SELECT lo, hi FROM lattice) THEN 'type_narrowed' ELSE 'type_incompatible' END END END change_type FROM fam)
    SELECT change_type, severity, CAST(count(*) AS BIGINT) n FROM t JOIN sev USING (change_type) GROUP BY 1, 2"""
)
def history_counters(spark: SparkSession, d: str) -> DataFrame:
    return event_counters(classify.classify_single(derive.history_changes(spark, d)))


@query(
    o.changes()
    + """SELECT kind, CAST(count(*) AS BIGINT) n FROM (SELECT 'table_added' kind FROM ta WHERE (src, tbl) NOT IN (SELECT src, tbl FROM tb)
    UNION ALL SELECT 'table_removed' FROM tb WHERE (src, tbl) NOT IN (SELECT src, tbl FROM ta)) GROUP BY 1"""
)
def table_notes(spark: SparkSession, d: str) -> DataFrame:
    return classify.table_notes(derive.pair_changes(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    o.changes()
    + """SELECT src source_identifier, tbl table_identifier, tbl || '.' || nm identifier, change_type, severity FROM batch
    QUALIFY row_number() OVER (PARTITION BY src, tbl ORDER BY rnk DESC, emit, ord) = 1"""
)
def top_event_per_table(spark: SparkSession, d: str) -> DataFrame:
    events = classify.classify_batch(derive.pair_changes(spark, d))
    return classify.top_event(events, ["source_identifier", "table_identifier"])


@query(
    "WITH "
    + o.SEVERITY
    + """, e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'column_added_nullable' WHEN 'click' THEN 'type_widened'
        WHEN 'signup' THEN 'default_changed' WHEN 'purchase' THEN 'column_dropped' ELSE 'pk_changed' END change_type,
        (['low','medium','high'])[event_id % 3 + 1] severity, event_id % 3 r, user_id % 2 = 0 auto FROM events),
    f AS (SELECT e.*, CASE WHEN change_type IN ('column_dropped','pk_changed') AND auto THEN 'destructive_auto_merge' END a,
        CASE WHEN r < rnk THEN 'severity_below_default' END b FROM e JOIN sev USING (change_type))
    SELECT change_type, e_severity severity, reasons, CAST(count(*) AS BIGINT) n FROM (
        SELECT change_type, severity_1 e_severity, concat_ws(',', a, b) reasons FROM (SELECT f.*, (['low','medium','high'])[r + 1] severity_1 FROM f)) GROUP BY ALL"""
)
def destructive_gate(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in derive.CHANGE_OF_EVENT.items() for x in kv])
    e = derive.table(spark, d, "events").select(
        kinds[F.col("event_type")].alias("change_type"),
        F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("event_id") % 3).cast("int")).alias("severity"),
        (F.col("user_id") % 2 == 0).alias("auto_mergeable"),
    )
    checked = contract.with_reasons(e, contract.event_rules())
    return checked.groupBy("change_type", "severity", F.array_join("reasons", ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """WITH r AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 10 = 0 THEN '   ' WHEN p_partkey % 10 = 1 THEN repeat(p_name, 20) ELSE ' ' || p_name END) nm,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 2 = 0 END nl, p_size - 5 ord, CASE WHEN p_partkey % 4 = 0 THEN p_size - 40 END ml FROM part)
    SELECT p_partkey, concat_ws(',', CASE WHEN length(nm) NOT BETWEEN 1 AND 128 THEN 'name_length' END,
        CASE WHEN nl IS NULL THEN 'nullable_missing' END, CASE WHEN ord < 0 THEN 'ordinal_position_negative' END,
        CASE WHEN ml < 0 THEN 'character_max_length_negative' END) reasons FROM r
    WHERE length(nm) NOT BETWEEN 1 AND 128 OR nl IS NULL OR ord < 0 OR ml < 0"""
)
def contract_quarantine(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = derive.table(spark, d, "part").select(
        "p_partkey",
        F.when(key % 10 == 0, "   ").when(key % 10 == 1, F.repeat("p_name", F.lit(20))).otherwise(F.concat(F.lit(" "), "p_name")).alias("name"),
        F.lit("text").alias("data_type"),
        F.when(key % 7 != 0, F.col("p_size") % 2 == 0).alias("nullable"),
        (F.col("p_size") - 5).alias("ordinal_position"),
        F.when(key % 4 == 0, F.col("p_size") - 40).alias("character_max_length"),
        F.lit(None).cast("int").alias("numeric_precision"),
        F.lit(None).cast("int").alias("numeric_scale"),
    )
    _, bad = contract.split(contract.trim_strings(rows), contract.column_rules())
    return bad.select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH t AS (SELECT 'src' || (l_orderkey % 8) source_identifier, 'raw.t' || l_orderkey table_identifier, sum(l_partkey) s FROM lineitem GROUP BY l_orderkey)
    SELECT source_identifier, table_identifier, 'partition_keys' which, 'c1' keys_before, 'c2' keys_after FROM t WHERE s % 5 = 0
    UNION ALL SELECT source_identifier, table_identifier, 'primary_key', 'c1,c2', CASE WHEN s % 7 = 0 THEN 'c2,c1' ELSE 'c1' END FROM t WHERE s % 7 < 2"""
)
def key_array_changes(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose primary or partition key array differs, in members or order."""
    changed = classify.key_array_changes(derive.table_sides(spark, d))
    text = lambda c: F.array_join(c, ",").alias(c)
    return changed.select("source_identifier", "table_identifier", "which", text("keys_before"), text("keys_after"))


@query(
    """SELECT 'src' || (l_orderkey % 8) source_identifier, 'raw.t' || l_orderkey table_identifier, 'partition_key_changed' change_type,
    'high' severity, 'c1' keys_before, 'c2' keys_after FROM lineitem GROUP BY l_orderkey HAVING sum(l_partkey) % 5 = 0"""
)
def partition_key_changes(spark: SparkSession, d: str) -> DataFrame:
    changed = classify.partition_key_changes(derive.table_sides(spark, d))
    return changed.select(
        "source_identifier", "table_identifier", "change_type", "severity",
        F.array_join("keys_before", ",").alias("keys_before"), F.array_join("keys_after", ",").alias("keys_after"),
    )
