"""Shared SQL fragments of the oracle queries: the derived relations, once more, in DuckDB SQL."""

from __future__ import annotations

# --- catalogue pair ---------------------------------------------------------

PAIR = """
base AS (SELECT l_orderkey k, l_linenumber n, min(l_partkey) a, max(l_suppkey) b FROM lineitem GROUP BY 1, 2),
c AS (SELECT k, n, a, b, a % 6 i, (a + b) % 13 m, 'src' || (k % 8) src, 'raw.t' || k tbl, 'c' || n nm FROM base),
old AS (SELECT *,
    CASE i WHEN 0 THEN 'integer' WHEN 1 THEN 'varchar(25)' WHEN 2 THEN 'numeric' WHEN 3 THEN 'date' WHEN 4 THEN 'char(10)' ELSE 'bigint' END ty,
    a % 3 <> 0 nl, CASE WHEN a % 2 = 1 THEN '0' END df, n = 1 pk,
    CASE i WHEN 1 THEN 25 WHEN 4 THEN 10 END ml, CASE WHEN i = 2 THEN 12 END np, CASE WHEN i = 2 THEN 2 END ns,
    CASE WHEN i = 4 THEN 'A,B' END en FROM c),
bef AS (SELECT src, tbl, nm, n, ty, nl, df, pk, ml, np, ns, en FROM old WHERE b % 11 <> 0),
aft AS (SELECT src, tbl, nm, n,
    CASE WHEN m = 3 THEN CASE i WHEN 0 THEN 'bigint' WHEN 1 THEN 'text' WHEN 2 THEN 'numeric' WHEN 3 THEN 'timestamp' WHEN 4 THEN 'varchar(10)' ELSE 'numeric' END
         WHEN m = 4 AND i = 0 THEN 'smallint' WHEN m = 4 AND i = 5 THEN 'integer' WHEN m = 5 THEN 'boolean' ELSE ty END ty,
    CASE m WHEN 1 THEN false WHEN 9 THEN true ELSE nl END nl,
    CASE WHEN m = 8 THEN CASE WHEN df IS NULL THEN '0' END ELSE df END df,
    CASE WHEN m = 0 THEN NOT pk ELSE pk END pk,
    CASE m WHEN 4 THEN ml // 2 WHEN 6 THEN ml * 2 ELSE ml END ml,
    CASE WHEN m = 7 THEN np + 2 ELSE np END np, CASE WHEN m = 7 THEN ns + 1 ELSE ns END ns,
    CASE WHEN m = 2 THEN en || ',C' ELSE en END en FROM old WHERE b % 11 <> 1),
tb AS (SELECT DISTINCT src, tbl FROM bef), ta AS (SELECT DISTINCT src, tbl FROM aft),
raw AS (SELECT * FROM (
    SELECT coalesce(x.src, y.src) src, coalesce(x.tbl, y.tbl) tbl, coalesce(x.nm, y.nm) nm, coalesce(x.n, y.n) n,
        CASE WHEN x.nm IS NULL THEN 'added' WHEN y.nm IS NULL THEN 'removed'
             WHEN (x.ty, x.nl, x.df, x.pk, x.ml, x.np, x.ns, x.en) IS DISTINCT FROM (y.ty, y.nl, y.df, y.pk, y.ml, y.np, y.ns, y.en) THEN 'modified' END kind,
        x.ty bty, y.ty aty, x.nl bnl, y.nl anl, x.df bdf, y.df adf, x.pk bpk, y.pk apk, x.ml bml, y.ml aml,
        x.np bnp, y.np anp, x.ns bns, y.ns ans, x.en ben, y.en aen,
        regexp_replace(lower(trim(x.ty)), '\\s*\\(.*\\)\\s*$', '') bfam, regexp_replace(lower(trim(y.ty)), '\\s*\\(.*\\)\\s*$', '') afam
    FROM bef x FULL JOIN aft y ON x.src = y.src AND x.tbl = y.tbl AND x.nm = y.nm)
    WHERE kind IS NOT NULL AND (src, tbl) IN (SELECT src, tbl FROM tb) AND (src, tbl) IN (SELECT src, tbl FROM ta))
"""

LATTICE = """
lattice(lo, hi) AS (VALUES ('smallint','integer'),('smallint','int'),('smallint','bigint'),('smallint','numeric'),('smallint','decimal'),
    ('integer','bigint'),('integer','numeric'),('integer','decimal'),('int','bigint'),('int','numeric'),('int','decimal'),
    ('bigint','numeric'),('bigint','decimal'),('real','double precision'),('real','numeric'),('real','decimal'),
    ('float','double precision'),('float','numeric'),('float','decimal'),('char','varchar'),('char','text'),('varchar','text'),
    ('character varying','text'),('date','timestamp'),('date','timestamp without time zone'),('date','timestamptz'),
    ('time','timestamp'),('time','timestamptz'),('timestamp','timestamptz'),
    ('timestamp without time zone','timestamptz'),('timestamp without time zone','timestamp with time zone'))
"""

_RULES = """
    CASE kind WHEN 'added' THEN CASE WHEN anl THEN 'column_added_nullable' WHEN adf IS NOT NULL THEN 'column_added_not_null' ELSE 'column_added_not_null_no_default' END
         WHEN 'removed' THEN 'column_dropped' WHEN 'renamed' THEN 'column_renamed'
         ELSE CASE WHEN bpk <> apk THEN 'pk_changed' WHEN bnl AND NOT anl THEN 'nullability_tightened'
              WHEN ben IS NOT NULL AND aen IS NOT NULL AND aen <> ben AND starts_with(aen, ben || ',') THEN 'enum_value_added'
              WHEN bfam <> afam THEN CASE WHEN (bfam, afam) IN (SELECT lo, hi FROM lattice) THEN 'type_widened'
                   WHEN (afam, bfam) IN (SELECT lo, hi FROM lattice) THEN 'type_narrowed' ELSE 'type_incompatible' END
              WHEN aml > bml THEN 'type_widened' WHEN aml < bml THEN 'type_narrowed'
              WHEN bnp IS DISTINCT FROM anp OR bns IS DISTINCT FROM ans THEN 'precision_changed'
              WHEN bdf IS DISTINCT FROM adf THEN 'default_changed' END END
"""

SEVERITY = """
sev(change_type, severity, rnk) AS (VALUES ('column_added_nullable','low',0),('column_added_not_null','low',0),
    ('column_added_not_null_no_default','medium',1),('column_dropped','high',2),('type_widened','low',0),('type_narrowed','high',2),
    ('type_incompatible','high',2),('column_renamed','high',2),('precision_changed','medium',1),('pk_changed','high',2),
    ('enum_value_added','low',0),('default_changed','medium',1),('nullability_tightened','medium',1),('partition_key_changed','high',2))
"""

DESTRUCTIVE = "('column_dropped','type_narrowed','type_incompatible','pk_changed','partition_key_changed')"
BACKFILL = "('column_added_not_null','column_added_not_null_no_default','type_narrowed','type_incompatible','nullability_tightened')"

SINGLE = f"""
single AS (SELECT t.*, s.severity, s.rnk, src || '' source_identifier FROM (SELECT *, {_RULES} change_type FROM raw) t JOIN sev s USING (change_type))
"""

BATCH = f"""
ranked AS (SELECT *, coalesce(bfam, afam) fam, row_number() OVER (PARTITION BY src, tbl, kind, coalesce(bfam, afam) ORDER BY nm) r
    FROM raw WHERE kind IN ('added', 'removed')),
matched AS (SELECT coalesce(x.src, y.src) src, coalesce(x.tbl, y.tbl) tbl,
        CASE WHEN x.nm IS NULL THEN 'added' WHEN y.nm IS NULL THEN 'removed' ELSE 'renamed' END kind,
        coalesce(x.fam, y.fam) fam, x.nm old_name, y.nm new_name, coalesce(y.nm, x.nm) nm, coalesce(x.n, y.n) ord,
        y.anl, y.adf
    FROM (SELECT * FROM ranked WHERE kind = 'removed') x FULL JOIN (SELECT * FROM ranked WHERE kind = 'added') y
    ON x.src = y.src AND x.tbl = y.tbl AND x.fam = y.fam AND x.r = y.r),
batch AS (SELECT t.src, t.tbl, t.nm, t.kind, t.emit, t.ord, t.change_type, s.severity, s.rnk FROM (
    SELECT src, tbl, nm, kind, CASE kind WHEN 'added' THEN 1 ELSE 0 END emit, ord,
        CASE kind WHEN 'renamed' THEN 'column_renamed' WHEN 'removed' THEN 'column_dropped'
            ELSE CASE WHEN anl THEN 'column_added_nullable' WHEN adf IS NOT NULL THEN 'column_added_not_null' ELSE 'column_added_not_null_no_default' END END change_type
    FROM matched
    UNION ALL
    SELECT src, tbl, nm, kind, 2, n, change_type FROM single WHERE kind = 'modified') t JOIN sev s USING (change_type))
"""


def changes(*extra: str) -> str:
    return "WITH " + ",".join([PAIR, LATTICE, SEVERITY, SINGLE, BATCH, *extra])


# --- snapshot history -------------------------------------------------------

HISTORY = """
he AS (SELECT 's' || (user_id % 20) src, date_trunc('day', ts) d, 'raw.' || event_type tbl,
        CAST(json_extract(props, '$.k') AS BIGINT) % 25 kk, CAST(floor(value) AS BIGINT) % 4 v, event_id, ts FROM events),
hc AS (SELECT src, d, tbl, 'k' || kk nm, (['integer','bigint','numeric(10,2)','text'])[v + 1] ty, event_id % 2 = 0 nl FROM he
    QUALIFY row_number() OVER (PARTITION BY src, d, tbl, kk ORDER BY ts DESC, event_id DESC) = 1),
hs AS (SELECT src, d, row_number() OVER (PARTITION BY src ORDER BY d) seq, count(*) OVER (PARTITION BY src) cnt
    FROM (SELECT DISTINCT src, d FROM he)),
hcol AS (SELECT hc.*, seq FROM hc JOIN hs USING (src, d)),
htab AS (SELECT DISTINCT src, seq, tbl FROM hcol),
hsteps AS (SELECT src, seq FROM hs WHERE seq > 1),
htabch AS (
    SELECT t.src, t.seq, t.tbl, 'table_added' kind FROM htab t WHERE t.seq > 1 AND NOT EXISTS (SELECT 1 FROM htab p WHERE p.src = t.src AND p.tbl = t.tbl AND p.seq = t.seq - 1)
    UNION ALL
    SELECT s.src, s.seq, p.tbl, 'table_removed' FROM hsteps s JOIN htab p ON p.src = s.src AND p.seq = s.seq - 1
    WHERE NOT EXISTS (SELECT 1 FROM htab t WHERE t.src = s.src AND t.seq = s.seq AND t.tbl = p.tbl)),
hboth AS (SELECT t.src, t.seq, t.tbl FROM htab t JOIN htab p ON p.src = t.src AND p.tbl = t.tbl AND p.seq = t.seq - 1),
hraw AS (SELECT * FROM (
    SELECT coalesce(x.src, y.src) src, coalesce(x.seq + 1, y.seq) seq, coalesce(x.tbl, y.tbl) tbl, coalesce(x.nm, y.nm) nm,
        CASE WHEN x.nm IS NULL THEN 'added' WHEN y.nm IS NULL THEN 'removed'
             WHEN x.ty <> y.ty OR x.nl <> y.nl THEN 'modified' END kind, x.ty bty, y.ty aty, x.nl bnl, y.nl anl
    FROM hcol x FULL JOIN hcol y ON x.src = y.src AND x.tbl = y.tbl AND x.nm = y.nm AND y.seq = x.seq + 1)
    WHERE kind IS NOT NULL AND (src, seq, tbl) IN (SELECT src, seq, tbl FROM hboth))
"""
