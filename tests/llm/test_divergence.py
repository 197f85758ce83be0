import re
from collections import Counter, defaultdict

import numpy as np

from shiftlens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, part int, own_0 int, term string"


def brute(docs, least, top):
    """The contract's rows, read from its words."""
    used, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        used[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in used}:
        kept = {t for t, n in seen[lang].items() if n >= least}
        sources = sorted(s for x, s in used if x == lang)
        whole = sum((used[lang, s] for s in sources), Counter())

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = p(whole)
        for s in sources:
            own = p(used[lang, s])
            pairs = [(o, sum(abs(own[t] - x) for t, x in p(used[lang, o]).items())) for o in sources if o != s]
            terms = [(t, own[t] - q[t]) for t in kept if used[lang, s][t] > 0 and own[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def some_docs():
    rng = np.random.default_rng(3)
    words = ["the", "The", "été", "a", "b's", "x9y", "ÄÖ", "京都", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = [(" ".join(rng.choice(words, rng.integers(0, 30))), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 9)}") for _ in range(150)]
    return [*docs, (None, None, None), (None, "en", "s0"), ("", "de", "only"), ("", "de", "other"), ("the the", "en", None), docs[0], docs[0]]


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, 1, 2, "x") for i, d in enumerate(docs)], SCHEMA)


def test_audit_equals_brute_force(spark, monkeypatch):
    docs = some_docs()
    assert rows(divergence.audit(frame(spark, docs), least=3, top=7)) == brute(docs, 3, 7)
    monkeypatch.setattr(divergence, "TERMS", 4)  # many blocks of terms, many parts of groups
    monkeypatch.setattr(divergence, "GROUPS", 2)
    assert rows(divergence.audit(frame(spark, docs), least=3, top=7)) == brute(docs, 3, 7)


def test_nothing_kept_and_empty_table(spark):
    docs = [("a b", "en", "x"), ("a b", "en", "y"), ("", None, "z")]
    assert rows(divergence.audit(frame(spark, docs))) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert rows(divergence.audit(frame(spark, []))) == []


def test_odd_rows(spark, odd):
    docs = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert rows(divergence.audit(odd, least=1)) == brute(docs, 1, 50)


def test_slices_keep_words_whole(monkeypatch):
    text = "abc Défg " * 50 + "z" * 300
    whole = [w for ws in divergence._pieces(text) for w in ws]
    monkeypatch.setattr(divergence, "SLICE", 7)
    pieces = list(divergence._pieces(text))
    assert len(pieces) > 20 and [w for ws in pieces for w in ws] == whole


def test_equal_node_pairs_are_priced_once():
    counts = np.zeros((2, 1024), np.int64)
    counts[0, 5], counts[1, 900] = 3, 2
    trees = divergence.Trees(counts)
    p = np.stack([divergence.shares(trees.leaves, 10), divergence.shares(trees.leaves, 20)])
    price, priced = trees.prices(p, np.array([0]), np.array([1]))
    at = {n: i for i, n in enumerate(trees.leaves)}
    assert price[0] == sum(abs(int(p[0, at[a]]) - int(p[1, at[b]])) for a, b in zip(*counts, strict=True))
    assert priced < 50  # of 2047 pairs of places


def test_counts_beyond_a_long_product():
    big = np.array([0, 7, 9_000_000_001, 5 * 10**12], np.int64)
    below = int(big.sum()) + 20
    assert divergence.shares(big, below).tolist() == [1 + 10**9 * (int(c) + 5) // below for c in big]
