"""URL filters: rules for hosts and paths, and for the rest trust and distrust along the links between hosts.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest fitting rule judges a
URL (equal lengths: the longer host, then the first in byte order). What no rule judges is judged by its host: hosts are
the nodes and links from pages of one host to another the edges, weighted by the number of pages that hold one. Hosts at
least half of whose pages the rules allow are trusted seeds, hosts at least half of whose pages they block are blocked
seeds. Personalised PageRank runs from the trusted seeds along the links and from the blocked ones against them, so that
who links to a blocked host is distrusted, not whom it links to. A host whose distrust exceeds its trust is blocked.

Ranks are whole numbers: a seed brings ``UNIT`` a round, and a host passes floor(rank * DAMPING / 100 * weight / all its
weights) along each edge. So sums do not depend on their order, a result is the same on every run, and ``ROUNDS`` rounds leave
out less than 0.85 ** 16, a thirteenth, of the mass. Only hosts with a rank and sums by (from, to) are shuffled; a hub is one
row on the ranks' side of a join that Spark can split. Written tables every ``CUT`` rounds bound what a lost executor costs.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is no node; a path may be empty
and then starts with no rule's path but an empty one. Links are absolute or begin with ``//``, in tags ``a`` and ``area``
outside comments, scripts and styles; links to the own host do not count, nor a second link of a page to the same host.
Null and empty html has no links. Without links or seeds every unruled URL is allowed, as is a tie of trust and distrust.
Repeated rows and ids are judged row by row and count as pages. Other columns of the table are not read, so their names
cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.durable import cut

UNIT, DAMPING, ROUNDS, CUT = 10**9, 85, 16, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NO_LINKS = r"(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style"
LINK = r"""(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ruled(pages: DataFrame, rules: tuple[Rule, ...], *others: str) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``by_rule`` and the named columns of every page."""
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        _lower(F.regexp_extract(F.coalesce("url", F.lit("")), URL, 1)).alias("host"),
        F.regexp_extract(F.coalesce("url", F.lit("")), URL, 2).alias("path"),
        *others,
    )
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name), reverse=True):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), *others)


def host_edges(pages: DataFrame) -> DataFrame:
    """``source``, ``target``, ``weight``: pages of a host that link to another. Pages are rows of ``host`` and ``html``."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), NO_LINKS, " ")
    targets = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(LINK), F.lit(1)), _lower))
    links = pages.filter("host <> ''").select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return links.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind``, ``host``, ``rank``: what reaches each host from seeds ``kind``, ``host`` over edges ``kind``, ``near``, ``far``, ``weight``."""
    totals = edges.groupBy("kind", "near").agg(F.sum("weight").alias("all_weights"))
    shares = cut(edges.join(totals, ["kind", "near"]), "shares")
    base = cut(seeds.select("kind", "host", F.lit(UNIT).cast("long").alias("rank")), "seeds")
    if shares.isEmpty():
        return base
    passed = F.expr(f"(cast(rank as decimal(19,0)) * cast(weight * {DAMPING} as decimal(17,0))) div cast(all_weights * 100 as decimal(20,0))")
    ranks = base
    for i in range(1, rounds + 1):
        given = ranks.withColumnRenamed("host", "near").join(shares, ["kind", "near"]).select("kind", F.col("far").alias("host"), passed.alias("rank"))
        ranks = given.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % CUT == 0:
            ranks = cut(ranks, "ranks")
    return ranks


def host_scores(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of the hosts that a seed reaches."""
    rows = ruled(pages, rules, "html").filter("host <> ''")
    edges = host_edges(rows)
    both = F.explode(
        F.array(
            F.struct(F.lit("trust").alias("kind"), F.col("source").alias("near"), F.col("target").alias("far"), "weight"),
            F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("near"), F.col("source").alias("far"), "weight"),
        )
    )
    share = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    kinds = F.array(F.when(2 * F.col("good") >= F.col("pages"), "trust"), F.when(2 * F.col("bad") >= F.col("pages"), "distrust"))
    seeds = share.select(F.explode(F.array_compact(kinds)).alias("kind"), "host")
    ranks = propagate(edges.select(both.alias("e")).select("e.*"), seeds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row of ``pages`` (``page_id``, ``url``, ``html``)."""
    bad = host_scores(pages.select("page_id", "url", "html"), rules).filter("distrust > trust").select(F.col("host").alias("bad_host"))
    rows = ruled(pages.select("page_id", "url"), rules)
    verdict = F.coalesce("by_rule", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow"))
    return rows.join(bad, F.col("host") == F.col("bad_host"), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
