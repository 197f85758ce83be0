"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import bpe, decontaminate, divergence, html_extract, language, licenses, line_dedup, near_dup, neighbours, substring_dedup, token_output, url_filter, vector_codes
from shiftlens.llm.common import table
from shiftlens.plans.register import Registry

registry = Registry()


@registry.query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


@registry.query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and where."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registry.query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated line chunks."""
    return line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))


@registry.query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and spans of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@registry.query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return language.predictions(docs, language.train(docs))


@registry.query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


@registry.query()
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@registry.query()
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of sentences that an earlier document has too, with the document that keeps it."""
    return substring_dedup.repeated_runs(table(spark, sf_dir, "documents"))


@registry.query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return token_output.checksums(token_output.read_files(spark, token_output.write_files(table(spark, sf_dir, "documents"))))


_OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), sides AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS doc_id, u AS other FROM sides UNION SELECT r.doc_id, s.v FROM reach r JOIN sides s ON s.u = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@registry.query(_OP10)
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose shingle sets are alike by at least 0.85."""
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


_OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (SELECT k, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT k) >= 30),
cells AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
groups AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL) USING (lang, source) LEFT JOIN sizes USING (lang)
), p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v) AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), items AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM items QUALIFY part = 'pair' OR rank <= 50
"""


@registry.query(_OP11)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and the terms each uses most beyond its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def _op12() -> str:
    """Every round of the codebooks as a table of its own."""
    near = """SELECT t.k, t.part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
      SELECT p.k, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN {book} b ON p.part = b.part AND p.place = b.place GROUP BY ALL) t GROUP BY t.k, t.part"""
    sql = """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (SELECT k, unnest(range(len(embedding))) AS i, len(embedding) // 8 AS w, unnest(embedding) AS x FROM kept),
parts AS MATERIALIZED (SELECT k, (i // w)::INTEGER AS part, (i % w)::INTEGER AS place, floor(4096 * x::DOUBLE)::BIGINT AS x FROM cells),
b0 AS MATERIALIZED (SELECT (k - 1)::INTEGER AS entry, part, place, x FROM parts WHERE k <= 16),"""
    for r in range(vector_codes.ROUNDS):
        sql += f"""
n{r} AS ({near.format(book=f"b{r}")}),
b{r + 1} AS MATERIALIZED (
  SELECT b.entry, b.part, b.place, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT entry, part, place, floor(sum(x) / count(*))::BIGINT AS x FROM parts JOIN n{r} USING (k, part) GROUP BY ALL) m USING (entry, part, place)),"""
    last = f"b{vector_codes.ROUNDS}"
    return sql + f"""
final AS ({near.format(book=last)}),
coded AS (SELECT k, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM {last}) AS codebooks_sha256
FROM coded JOIN kept USING (k)"""


@registry.query(_op12())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every vector, and its error."""
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


def _op13() -> str:
    """Rules as a table, and every round of both propagations as a table of its own."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)
    link = url_filter.LINK.replace("'", "''")
    sql = rf"""WITH rules AS (SELECT * FROM (VALUES {rules}) r(verdict, rhost, rpath)),
parts AS MATERIALIZED (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(coalesce(url, ''), '{url_filter.URL}', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{url_filter.URL}', 2) AS path, regexp_replace(coalesce(html, ''), '{url_filter.NO_LINKS}', ' ', 'g') AS html FROM pages
), fits AS (
  SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS by_rule
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k
), ruled AS MATERIALIZED (SELECT page_id, host, path, rule, by_rule FROM parts LEFT JOIN fits USING (k)),
links AS (SELECT DISTINCT k, host AS source, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{url_filter.UPPER}', '{url_filter.LOWER}') AS target FROM parts WHERE host <> ''),
edges AS (SELECT source, target, count(*) AS weight FROM links WHERE source <> target GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, source AS near, target AS far, weight FROM edges UNION ALL SELECT 'distrust', target, source, weight FROM edges),
shares AS MATERIALIZED (SELECT *, sum(weight) OVER (PARTITION BY kind, near)::HUGEINT AS all_weights FROM ways),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM ruled WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (
  SELECT 'trust' AS kind, host, {url_filter.UNIT}::HUGEINT AS rank FROM hosts WHERE 2 * good >= pages
  UNION ALL SELECT 'distrust', host, {url_filter.UNIT} FROM hosts WHERE 2 * bad >= pages
),"""
    for i in range(1, url_filter.ROUNDS + 1):
        sql += f"""
r{i} AS MATERIALIZED (SELECT kind, host, sum(rank)::HUGEINT AS rank FROM (
  SELECT s.kind, far AS host, (rank * weight * {url_filter.DAMPING}) // (all_weights * 100) AS rank FROM r{i - 1} r JOIN shares s ON r.kind = s.kind AND r.host = s.near
  UNION ALL SELECT * FROM r0) GROUP BY kind, host),"""
    return sql + f"""
bad AS (SELECT host FROM r{url_filter.ROUNDS} GROUP BY host HAVING coalesce(sum(rank) FILTER (kind = 'distrust'), 0) > coalesce(sum(rank) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


@registry.query(_op13())
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))
