import re

import numpy as np
import pytest

from shiftlens.llm import decontaminate, html_extract, language, licenses, line_dedup, neighbours, substring_dedup

PASSAGE = "The first thing here is long enough to count. A second one follows it with more words than that. And a third ends the whole passage now."


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_repeated_sentences_are_found_and_the_first_stays(spark):
    docs = docs_of(spark, f"Own start of one. {PASSAGE} Own end.", f"some host text without a mark\n{PASSAGE}\nand on.", "Nothing of that. Nor here. Clean it is.")
    runs = substring_dedup.repeated_runs(docs).collect()
    assert [(r.doc_id, r.keep_id) for r in runs] == [(1, 0)] and runs[0].removed == PASSAGE
    left = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert PASSAGE in left[0] and "passage" not in left[1] and left[2].startswith("Nothing")


def test_spans_are_the_shortest_runs_by_brute_force():
    text = "a b c. d e f g. h. i j k l m n. o p. q r s t u v w x.".encode()
    found = [len(text[a:b].split()) for a, b in substring_dedup.sentences_of(text)]
    first, size, _ = substring_dedup.spans_in(text, 2, 7)
    want = set()
    for i in range(len(found)):
        for j in range(i + 2, len(found) + 1):
            if sum(found[i:j]) >= 7 and (j - i == 2 or sum(found[i : j - 1]) < 7 or sum(found[i + 1 : j]) < 7):
                want.add((i, j - i))
    assert set(zip(first.tolist(), size.tolist(), strict=True)) == want


def test_line_chunks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    lines = [f"line number {i} of many" for i in range(60)]
    texts = ["\n".join(lines[i] for i in rng.integers(0, 60, 3)) + "\n" + "\n".join(lines[10:30]) for _ in range(12)] + ["one line", "", lines[0]]
    docs = docs_of(spark, *texts)
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.without_repeated_lines(docs).collect()}
    seen, want = set(), set()
    for doc, text in enumerate(texts):
        kept, gone = [], 0
        split = text.split("\n")
        first, end, _, _ = line_dedup.chunks_of(text.encode()) if text else ([], [], None, None)
        for a, b in zip(first, end, strict=True):
            chunk = tuple(split[a:b])
            if b - a >= 2 and chunk in seen:
                gone += b - a
            else:
                kept += chunk
                seen.add(chunk)
        want.add((doc, "\n".join(kept), gone))
    assert got == want and sum(n for *_, n in got) > 50


def test_base_phrases_equal_brute_force(spark):
    texts = ["MIT License mit license", "the gnu general public license, cc by", "Released under the MIT License.", "cc-by-nc gnu general public licenses", "é apache\tLicense 2", None, ""]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, *texts)).collect()}
    for doc, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(1, 4, 9).tolist() for _ in range(4)]
    automaton, words = licenses.Automaton(sequences), rng.integers(1, 5, 300).tolist()
    runs = {tuple(s[i:j]) for s in sequences for i in range(9) for j in range(i + 1, 10)}
    for at, (_, length) in enumerate(automaton.statistics(words), 1):
        assert length == max([n for n in range(1, 10) if n <= at and tuple(words[at - n : at]) in runs], default=0)


def test_a_notice_with_changed_words_is_chained(spark):
    words = licenses.TEMPLATES[1][1].split()
    words[9], words[30] = "everyone", "replaced"
    (r,) = licenses.scan_licenses(docs_of(spark, "before " + " ".join(words) + " after")).collect()
    assert r.labels == "mit" and r.n_base == 0 and 0.8 <= r.score < 1


def test_benchmark_hits_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"v{x}" for x in rng.zipf(1.3, n) % 500)
    items = [(i, word(int(rng.integers(8, 40))) + ". " + word(6) + ".") for i in range(50)]
    texts = [word(200) + (" " + items[i % 50][1] + " " if i % 4 == 0 else " ") + word(150) for i in range(60)]
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, *texts), bench).collect()}
    tokens = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if len(grams(tokens(x)) & grams(tokens(t))) >= 0.8 * len(grams(tokens(x)))}
    assert got == want and len(want) >= 15


def test_bounds_lose_no_item_above_the_threshold():
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 60, 12))) for i in range(100)]
    index = decontaminate.Index.of(items)
    words, _ = decontaminate.many_word_hashes([" ".join(f"t{x}" for x in rng.integers(0, 60, 200)).encode()], decontaminate.WORDS)
    row = index.rows_of(words)
    got = {(p, i) for p, i, _ in index.retrieve(row, 0.4)}
    for p in range(-(-len(row) // index.stride)):
        terms = np.unique(row[p * index.stride : (p + 2) * index.stride])
        score = index.impact[terms[terms >= 0]].sum(axis=0)
        assert {i for q, i in got if q == p} == set(np.flatnonzero(score >= 0.4).tolist())


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 300, n)) + "."
    items = [(i, f"{text(int(rng.integers(12, 60)))} {text(8)}") for i in range(60)] + [(90, "..."), (91, None), (5, "yes")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(d, " ".join([text(40), items[d][1], text(25), items[(d * 7) % 60][1]])) for d in range(25)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(table, bench).collect()))
    assert {(r[0], r[1]) for r in one} >= {(d, d) for d in range(25)}
    monkeypatch.setattr(decontaminate, "ITEMS", 8)
    assert sorted(map(tuple, decontaminate.contaminated(table, bench).collect())) == one


def test_code_lengths_equal_a_plain_tree():
    texts = {"a": ["abab abba", "baab"], "b": ["cdcd dcdc", "abcd"]}
    rows = {k: dict(zip(*(x.tolist() for x in language.gram_counts(v)), strict=True)) for k, v in texts.items()}
    keys = np.array(sorted(set().union(*rows.values())), np.uint32)
    model = language.Model(["a", "b"], keys, np.array([[rows[k].get(int(g), 0) for k in "ab"] for g in keys], float))

    def cost(lang, data, order):
        if order < 0:
            return 8.0
        counts = {}
        for gram, n in rows[lang].items():
            gram = gram.to_bytes(4, "big")
            if gram[3 - order : 3] == data[3 - order : 3]:
                counts[gram[3]] = counts.get(gram[3], 0) + n
        total = sum(counts.values()) + len(counts)
        if not counts:
            return cost(lang, data, order - 1)
        return np.log2(total / counts[data[3]]) if data[3] in counts else np.log2(total / len(counts)) + cost(lang, data, order - 1)

    for text in ("abba", "dcab", "xyz", "é"):
        raw = language.padded(text)
        want = [sum(cost(k, raw[i - 3 : i + 1], 3) for i in range(3, len(raw))) for k in "ab"]
        assert model.code_lengths([text])[0] == pytest.approx(want, rel=1e-4)


def test_languages_of_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.predictions(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) > 0
    rows = language.predictions(odd, language.train(odd)).collect()
    assert {r.lang_pred for r in rows if r.doc_id == 1} == {"und"} and len(rows) == odd.count()
    assert language.train(odd.limit(0)).languages == []


def test_main_text_of_pages(spark):
    shell = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div>{}<footer>&copy; x</footer></body></html>"
    pages = [(i, "http://h.org/x", shell.format(f"<article><h1>Head {i}</h1><p><b>One  a&amp;b<br>c<p>two {i}</p></article><p>Sign up today</p>")) for i in range(12)]
    pages += [(20, None, None), (21, None, "plain &lt;text"), (22, "http://k.org", "<main><p>a<table><tr><td>1<td>2</table><div class=comments>no</div></main>tail"), (22, "http://k.org", "")]
    got = {}
    for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i] == [f"Head {i}\nOne a&b c\ntwo {i}"] for i in range(12))
    assert got[20] == [""] and got[21] == ["plain <text"] and sorted(got[22]) == ["", "a\n1 2"]


def test_text_runs_on_every_page_are_template(spark):
    pages = [(i, "http://h.org/x", f"<body><div><p>Follow us everywhere</p><p>text {i}</p></div></body>") for i in range(12)]
    found = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {f"text {i}" for i in range(12)}


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = neighbours.nearest(vectors, lambda c: c % 20 == 0).collect()
    hit = 0
    for query in ids[ids % 20 == 0]:
        score = points @ points[ids == query][0]
        score[ids == query] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = [r for r in found if r.query_id == query]
        assert [r.rank for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 21))
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hit += len(best & {r.vec_id for r in mine})
    assert hit >= 0.9 * len(found)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in neighbours.nearest(vectors, lambda c: c % 20 == 0).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 6, 0.5), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 6, 0.5)]
    assert neighbours.nearest(vectors.limit(0), lambda c: c % 20 == 0).count() == 0


@pytest.mark.parametrize("operator", [
    line_dedup.without_repeated_lines, line_dedup.drop_repeated_lines, licenses.scan_licenses, substring_dedup.without_repeats, substring_dedup.repeated_runs, language.drop_rejected,
])
def test_odd_rows_and_no_rows(odd, operator):
    operator(odd).collect()
    assert operator(odd.limit(0)).count() == 0


def test_attributes_are_read_by_their_whole_names():
    read = html_extract.attributes_of
    assert read(""" style="overflow:hidden" aria-hidden='false' href="/hidden-gems" data-id="ad" width="5" ID=x id=y""") == {
        "style": "overflow:hidden", "aria-hidden": "false", "href": "/hidden-gems", "data-id": "ad", "width": "5", "id": "x"}
    assert read(" hidden class = 'a b' href=/p?id=ad /") == {"hidden": "", "class": "a b", "href": "/p?id=ad"}
    assert read(" class=\"\" id='say \"hidden\"'/") == {"class": "", "id": 'say "hidden"'}


def test_article_text_with_ordinary_attributes_stays():
    kept = [
        '<div style="overflow:hidden">{}</div>', '<div aria-hidden="false">{}</div>', '<p><a href="/hidden-gems">{}</a></p>', '<p><a href="/p?id=ad">{}</a></p>', '<p data-class="ad">{}</p>',
        '<h2 id="market-share">{}</h2>', '<h3 id="social-impact">{}</h3>', '<h2 id="share">{}</h2>', '<section id="related-work"><p>{}</p></section>', '<p id="notice">{}</p>', '<div class="market-share">{}</div>',
    ]
    gone = ['<div hidden>{}</div>', '<p hidden="">{}</p>', '<div class="x ad">{}</div>', '<div id="comments">{}</div>', '<div class="share-buttons">{}</div>', '<ul class="social_links"><li>{}</ul>', '<aside>{}</aside>', '<div role="search">{}</div>']
    body = "".join(shape.format(f"{word} {i}") for word, shapes in (("kept", kept), ("gone", gone)) for i, shape in enumerate(shapes))
    text = html_extract.extract_page(f"<body><div id='ad-top'>gone</div><article>{body}</article></body>", html_extract.Template(None))
    assert text == "\n".join(f"kept {i}" for i in range(len(kept)))
    assert html_extract.extract_page('<div style="overflow:hidden">a</div><div hidden>b</div><div class="ad-slot">c</div>', html_extract.Template(None)) == "a"
