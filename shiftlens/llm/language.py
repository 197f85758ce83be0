"""Language ID by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3, held as counts of what follows each context. A byte
that its context has seen costs -log2(count / (total + distinct)); else the escape costs
-log2(distinct / (total + distinct)) and the next shorter context decides, down to a uniform byte. The
statistics are frozen after training, so a text's cost is its exact code length under each language and the
shortest code names the language. Letters are lower-cased and everything else is one blank.

Training counts come from at most about ``TRAIN_DOCS`` whole documents of each language, chosen by a hash of
doc_id among those outside the held-out fold; the tree of a sample that size is bounded and is broadcast.

Defined cases: null text or text without a letter is ``und`` with score 0; without any labelled document every
text is ``und``; ties go to the first language in order; equal rows get equal answers; a null doc_id is neither
learned from nor held out; a text of any length is scored whole, slice by slice; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import fresh, map_batches, runs

ORDER = 3
TRAIN_DOCS = 1500  # about so many documents of each language are learned from
FOLDS, HELD_OUT = 4, 2
CELLS = 1 << 20  # costs gathered at once
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def letters(text: Column) -> Column:
    """Lower-case letters and marks; every other stretch is a blank. Empty without a letter."""
    plain = F.trim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{M}]+", " "))
    return F.when(plain.rlike(r"\p{L}"), plain).otherwise("")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number."""
    wide = data.astype(np.uint32)
    return wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]


def padded(text: str) -> bytes:
    return b"   " + text.encode("utf-8", "surrogatepass") + b" "


class Lookup:
    """Row numbers of known keys: one slot each, the few that share a slot in a sorted list."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint32(32 - max(8, min(22, int(np.ceil(np.log2(max(1, len(keys)))) + 2))))
        self.slot = np.zeros(1 << int(32 - self.shift), np.int32)
        self.slot[self._slots(keys)] = np.arange(len(keys), dtype=np.int32)
        lost = self.slot[self._slots(keys)] != np.arange(len(keys))
        self.rest, self.rest_at = keys[lost], np.flatnonzero(lost).astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.slot[self._slots(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            near = np.minimum(np.searchsorted(self.rest, keys[missed]), max(0, len(self.rest) - 1))
            at[missed] = np.where(self.rest[near] == keys[missed], self.rest_at[near], -1) if len(self.rest) else -1
        return at


@dataclass
class Level:
    """One order: code lengths of known context and byte, escape costs of known contexts, a column per language."""

    known: Lookup
    cost: np.ndarray
    context: Lookup
    escape: np.ndarray


class Model:
    """Frozen trees of all languages."""

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys``: sorted four-byte grams; ``counts``: their counts, a column per language."""
        self.languages, self.levels = languages, []
        lower = lambda wanted: np.full((len(wanted), len(languages)), 8.0)  # noqa: E731  a uniform byte
        for order in range(ORDER + 1):
            known, place = np.unique(keys & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(known), len(languages)))
            np.add.at(seen, place, counts)
            context, of = np.unique(known >> np.uint32(8), return_inverse=True)
            total, distinct = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                cost = np.where(seen > 0, np.log2((total + distinct)[of] / seen), escape[of] + lower(known))
            self.levels.append(Level(Lookup(known), cost.astype(np.float32), Lookup(context), escape.astype(np.float32)))
            lower = lambda wanted, top=order: self._costs(wanted, top)

    def _costs(self, wanted: np.ndarray, top: int) -> np.ndarray:
        """Code length of the last byte of each gram in each language, contexts of up to ``top`` bytes."""
        out = np.zeros((len(wanted), len(self.languages)), np.float32)
        left = np.arange(len(wanted))
        for order in range(top, -1, -1):
            level, mask = self.levels[order], np.uint32((1 << 8 * (order + 1)) - 1)
            key = wanted[left] & mask
            row = level.known(key)
            found = row >= 0
            out[left[found]] += level.cost[row[found]]
            left, key = left[~found], key[~found]
            if not len(left):
                return out
            context = level.context(key >> np.uint32(8))
            out[left[context >= 0]] += level.escape[context[context >= 0]]
        out[left] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language; the texts run through one array in slices."""
        raw = [padded(x) for x in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        bits = np.zeros((len(raw), len(self.languages)))
        step = max(1024, CELLS // max(1, len(self.languages)))
        owner_at = ends - [len(x) for x in raw]
        for start in range(3, len(data), step):
            part = self._costs(grams(data[start - 3 : start + step]), ORDER)
            at = np.arange(start, start + len(part))
            owner = np.searchsorted(ends, at, side="right")
            part[at - owner_at[owner] < 3] = 0  # padding is not scored
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            bits[owner[first]] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
        return bits

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, its posterior probability under equal priors, and bits per byte."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        score = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(axis=1)
        none = [not x for x in texts]
        names = [UNDETERMINED if n else self.languages[b] for n, b in zip(none, best, strict=True)]
        rate = low / [max(1, len(x.encode("utf-8", "surrogatepass")) + 1) for x in texts]
        return names, np.where(none, 0.0, score).tolist(), np.where(none, 0.0, rate).tolist()


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([grams(np.frombuffer(padded(x), np.uint8)) for x in texts]), return_counts=True)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Trees from the labelled documents outside the held-out fold. Counts are summed by Spark; the driver gets the trees."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), letters(F.col(text_col)).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    share = {r["lang"]: min(1.0, train_docs / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], np.empty(0, np.uint32), np.empty((0, 0)))
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    sample = labelled.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit * (1 << 20)) & (F.col("text") != ""))

    def run(batches):
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, found in by_lang.items():
                key, n = gram_counts(found)
                yield [[lang] * len(key), key.astype(np.int64), n]

    counted = map_batches(sample.select("lang", "text"), run, "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    keys, place = np.unique(rows["gram"].to_numpy().astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(keys), len(languages)))
    counts[place, np.searchsorted(languages, rows["lang"])] = rows["n"]
    return Model(languages, keys, counts)


def identified(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with the column ``name``: struct of lang_pred, score, bits_per_byte."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def language(text: pd.Series) -> pd.DataFrame:
        texts, out = text.tolist(), ([], [], [])
        for start, stop in runs(map(len, texts)):  # a batch may hold 10,000 texts
            for column, found in zip(out, frozen.value.predict(texts[start:stop]), strict=True):
                column += found
        return pd.DataFrame(dict(zip(("lang_pred", "score", "bits_per_byte"), out, strict=True)))

    return docs.withColumn(name, language(letters(F.coalesce(F.col(text_col), F.lit("")))))


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``bits_per_byte`` of every row."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return identified(plain, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


def drop_rejected(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs``, all columns, without documents that are ``und`` or whose language is less sure than ``least``."""
    (name,) = fresh(docs, 1)
    marked = identified(docs, train(docs, lang_col, id_col, text_col), text_col, name)
    return marked.filter((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= least)).drop(name)
