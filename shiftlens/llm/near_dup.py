"""MinHash near-dedup with odd sketches.

Each document's distinct word shingles give MinHash samples: the smallest values of many hash functions, whose bands
choose candidates, and the smallest hashes of one function, which are folded into a parity bitmap (an odd
sketch). Two bitmaps differ only where the samples differ, so the population count of their XOR is at most the samples'
difference and close to it for similar sets. Candidates that it does not rule out are confirmed on the full shingle
sets. For sets no larger than a sample, nothing above the threshold can be ruled out.

Documents with equal sets form one class first, so exact copies cost one row each, whatever their number.
Within a bucket of classes only links that can join two groups are tried: first every class against the
bucket's pivot, then, where several groups are left, the classes outside the largest group against all
others. A pair inside one group needs no test, so no link that changes a group is lost.

Defined cases: null or word-less text has an empty set and is linked with nothing; a text below
``size`` words is one shingle; equal rows and equal ``doc_id`` give one result row each; a null
``doc_id`` is never the smallest of its group, unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.durable import counted, packed
from shiftlens.llm.common import fresh, map_batches, slices, texts
from shiftlens.llm.components import PAIR_BYTES, components
from shiftlens.llm.hashing import many_word_hashes, mix, shingle_hashes

BANDS, ROWS = 32, 4  # a pair of similarity 0.85 shares no band with probability 5e-11, one of 0.8 with 6e-8
SAMPLES = BANDS * ROWS
SKETCHED, BITS = 1024, 1024
SIGMAS = 6  # where sets are larger than their samples, a candidate goes only if it is so many deviations off
MARKS = [f"s{i}" for i in range(BITS // 64)]
ROW_BYTES = 8 * len(MARKS) + 64  # of a class or member with its sketch
ROUNDS_BELOW = 0.5  # pivot rounds go on while each at least halves the pairs that are left
_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)).astype(np.uint32)


def samples_of(found: np.ndarray) -> np.ndarray:
    """The smallest value of each sampling function over distinct shingle hashes."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    folded = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 4096):
        np.minimum(low, (folded[at : at + 4096, None] * _A + _B).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + rows[:, i])
    return key.view(np.int64)


def odd_sketch(found: np.ndarray) -> list[int]:
    """Words of the parity bitmap: each of the ``SKETCHED`` smallest hashes (all of a smaller set) flips one bit."""
    place = (mix(found[:SKETCHED]) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


def _sets(size: int):
    """(row, distinct shingle hashes) of each text of a batch."""

    def of(batch: pa.RecordBatch):
        column = batch.column("text")
        for start, end in slices(batch, "text"):
            raw = [x.encode("utf-8", "surrogatepass").lower() for x in column.slice(start, end - start).to_pylist()]
            words, first = many_word_hashes(raw)
            for i in range(end - start):
                yield start + i, np.unique(shingle_hashes(words[first[i] : first[i + 1]], size))

    return of


def _key(found: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a, b = mix(found), mix(found ^ np.uint64(0xD6E8FEB86659FD93))
    return np.array([a.sum() + np.uint64(len(found)), b.sum()], np.uint64).tobytes()


SKETCH = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{m} long" for m in MARKS)


def sketches(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, set name, band keys and odd sketch of each document. One pass, no shuffle."""
    sets = _sets(size)

    def run(batches):
        for batch in batches:
            ids, out = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash")), strict=True)), [[] for _ in range(5 + len(MARKS))]
            for i, found in sets(batch):
                if len(found):
                    low = samples_of(found)
                    row = (*ids[i], len(found), _key(found), band_keys(low), *odd_sketch(found))
                else:
                    row = (*ids[i], 0, None, None, *[None] * len(MARKS))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield out

    return map_batches(texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")), run, SKETCH)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``set_key`` and ``shingles`` of the wanted classes, from the text of one document of each."""
    sets = _sets(size)

    def run(batches):
        for batch in batches:
            key, out = batch.column("set_key").to_pylist(), [[], []]
            held = 0
            for i, found in sets(batch):
                if len(found) and _key(found) == key[i]:
                    out[0].append(key[i])
                    out[1].append(found.view(np.int64))
                    held += len(found)
                if held > 1 << 20:
                    yield out
                    out, held = [[], []], 0
            yield out

    wanted = wanted.select(F.col("doc_id").alias("wanted_id"), "set_key")
    chosen = texts(docs, id_col, text_col).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    return map_batches(chosen.select("set_key", "text"), run, "set_key binary, shingles array<long>").dropDuplicates(["set_key"])


def _not_ruled_out(left: str, right: str, threshold: float):
    """Whether two sketches (columns with these prefixes) can belong to sets as similar as the threshold."""
    per_cent = round(threshold * 100)
    n, m = F.col(f"{left}n_shingles"), F.col(f"{right}n_shingles")
    large, small = F.greatest(n, m), F.least(n, m)
    common = (n + m) * per_cent / (100 + per_cent)  # of sets just as similar as asked for
    sampled = common * F.least(F.lit(1.0), SKETCHED / large)
    spread = F.when(large <= SKETCHED, 0.0).otherwise(F.sqrt(F.greatest(F.lit(1.0), sampled * (1 - sampled / SKETCHED))))
    most = F.least(n, F.lit(SKETCHED)) + F.least(m, F.lit(SKETCHED)) - 2 * sampled + 2 * SIGMAS * spread
    differ = sum((F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in MARKS), F.lit(0))
    return (100 * small >= per_cent * large) & (differ <= most + 1e-6)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``u``, ``v`` whose full sets have at least the similarity asked for, in whole numbers."""
    per_cent = round(threshold * 100)
    one = sets.select(F.col("set_key").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("set_key").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(one, "u").join(two, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.filter(100 * F.col("common") >= per_cent * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v")


def _with_roots(members: DataFrame, links: DataFrame | None, n_links: int) -> DataFrame:
    if links is None:
        return members.withColumn("root", F.col("set_key"))
    roots = components(links, n_links).withColumnRenamed("node", "set_key")
    return members.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))


def class_links(sketched: DataFrame, rows: int, docs: DataFrame, threshold: float, size: int, id_col: str, text_col: str) -> tuple[DataFrame | None, int]:
    """Confirmed links ``u``, ``v`` between set classes, enough to give every group of similar sets, and their number. ``rows``: of ``sketched``."""
    marks = ["n_shingles", *MARKS]
    classes = sketched.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in marks))
    classes, seen = packed(classes, "classes", rows * (ROW_BYTES + 8 * BANDS))
    banded = classes.select("set_key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets, seen = packed(banded.join(shared, "band"), "buckets", seen["rows"] * BANDS * 48)
    # A class that agrees with many others in many bands is near the middle of its group: the best pivot.
    weight = buckets.groupBy("set_key").agg(F.sum("n").alias("weight")).join(classes.drop("bands"), "set_key")
    weight, held = packed(weight, "weights", seen["rows"] * ROW_BYTES, shingles=F.sum("n_shingles"))
    sets, _ = packed(shingle_sets(docs, weight.select("doc_id", "set_key"), size, id_col, text_col), "sets", 8 * held["shingles"] + 48 * held["rows"])
    members = buckets.select("band", "set_key").join(weight.drop("doc_id"), "set_key")
    members, seen = packed(members, "members", seen["rows"] * ROW_BYTES)
    links, n_links, before = None, 0, None
    while True:
        rooted = _with_roots(members, links, n_links)
        by_root = rooted.groupBy("band", "root").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
        groups = by_root.groupBy("band").agg(
            F.count("*").alias("roots"), F.sum("n").alias("all"), F.max_by("root", F.struct("n", "root")).alias("big"), F.max("n").alias("most"))
        open_ = rooted.join(groups.filter("roots > 1").select("band", "big", (F.col("all") - F.col("most")).alias("few"), "all"), "band")
        open_, seen = packed(open_, "open", seen["rows"] * (ROW_BYTES + 64))
        opened = seen["rows"]
        left = open_.agg(F.coalesce(F.sum(F.when(F.col("root") != F.col("big"), F.col("all"))), F.lit(0)).alias("n")).first()["n"]
        if not left:
            return links, n_links
        last = before is not None and left > ROUNDS_BELOW * before
        before = left
        if last:  # every pair that could still join two groups
            other = open_.select("band", F.col("set_key").alias("v"), F.col("root").alias("v_root"), *(F.col(c).alias(f"v_{c}") for c in marks))
            pairs = open_.filter("root <> big").join(other, "band").filter(F.col("root") != F.col("v_root")).filter(_not_ruled_out("", "v_", threshold))
        else:
            pivot = open_.groupBy("band").agg(F.max(F.struct("weight", "set_key", *marks)).alias("p"))
            pairs = open_.join(pivot, "band").select("*", F.col("p.set_key").alias("v"), *(F.col(f"p.{c}").alias(f"v_{c}") for c in marks))
            rest = open_.join(pivot.select("band", F.col("p.set_key").alias("set_key")), ["band", "set_key"], "left_anti").select(*members.columns)
            members, seen = packed(rest, "members", seen["rows"] * ROW_BYTES)
            pairs = pairs.filter(F.col("set_key") != F.col("v")).filter(_not_ruled_out("", "v_", threshold))
        tried = pairs.select(F.least("set_key", "v").alias("u"), F.greatest("set_key", "v").alias("v")).distinct()
        found = _confirm(tried, sets, threshold)
        # a pivot is paired with each row of its bucket once, the rest with all of it
        most = n_links + (left if last else opened)
        links, made = packed(found if links is None else links.union(found), "links", most * PAIR_BYTES)
        n_links = made["rows"]
        if last:
            return links, n_links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    sketched, seen = counted(sketches(docs, size, id_col, text_col), "sketches")
    links, n_links = class_links(sketched, seen["rows"], docs, threshold, size, id_col, text_col)
    named = sketched.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    if links is None:
        named = named.select("set_key", F.col("doc_id").alias("component_id"))
    else:
        rooted = _with_roots(named, links, n_links)
        low = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = rooted.join(low, "root").select("set_key", "component_id")
    out = sketched.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group; of equal rows (id and text) one."""
    known, row, text_hash, place = fresh(docs, 4)
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(row), F.col(id_col).isNotNull().alias(known), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(text_hash))
    kept = near_duplicates(docs, threshold, size, id_col, text_col).filter("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias(row), F.col("doc_id").isNotNull().alias(known), F.col("text_hash").alias(text_hash))
    same = [row, known, text_hash]
    left = keyed.join(kept, same, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(*same).orderBy(*same)))
    return left.filter(F.col(place) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
