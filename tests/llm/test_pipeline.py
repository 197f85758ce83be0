import re

import corpus_pipeline
from shiftlens.llm import line_dedup, near_dup


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "near_duplicates":
            kept = {r.doc_id for r in near_dup.near_duplicates(before).filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "lines":
            left = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(before).collect()}
            assert all(left[r.doc_id] == r.text and r.n_chars == len(r.text) for r in docs.collect())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_planted_copies_and_benchmark_passages_go_and_clean_rows_stay(spark, tmp_path):
    words = lambda k: " ".join(f"word{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    leak = "this question about planets has words in order. The answer is the seventh planet from here."
    rows = [(1, words(0)), (2, words(0)), (3, words(0).replace("wordaaa", "changed")), (4, words(1)), (5, words(2) + " " + leak), (6, "12 34 !!"), (7, None)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 4]
    assert re.match("[0-9a-f]{64}", corpus_pipeline.run(spark, str(tmp_path)).first().ids_sha256)


def test_odd_rows_and_no_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "yes no")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, str(tmp_path)).count() >= 0, name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name


def test_exact_copies_of_few_lines_vanish(spark, tmp_path):
    line = lambda end, n, i: " ".join(f"{'v' if end else 'w'}{chr(97 + n)}{chr(97 + i)}{chr(97 + j)}" for j in range(8))
    texts = ["\n".join(line(end, n, i) for i in range(n)) + end for n in range(2, 21) for end in ("", "\n")]
    rows = [(k + 1000 * copy, t, "en", "s", len(t)) for copy in range(3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r)[:2] for r in line_dedup.drop_repeated_lines(docs).collect()) == list(enumerate(texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a question that no text here has, with some words more.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(len(texts)))


def test_a_passage_goes_also_before_an_own_closing_line(spark):
    lines = [f"line number {i} of many" for i in range(20)]
    ends = [line_dedup.chunks_of("\n".join([*lines[:n], "own"]).encode(), shorter=True)[:2] for n in range(4, 21)]
    n, last = next((n, int(e[-1])) for n, (_, e) in enumerate(ends, 4) if e[-1] == n)  # a mark before the closing line
    texts = ["\n".join(lines), "\n".join([*lines[:last], "own"]), "\n".join(lines[:last]) + "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert n == last and got == {0: (texts[0], 0), 1: ("own", last), 2: ("", last)}
