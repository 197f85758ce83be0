import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [
    (None, None), (1, ""), (2, "a" * 40_000 + " b" * 30_000), (3, "x  y\n\n z" * 9_000), (4, "é" * 20_000 + "'s don't 123 " * 3_000),
    (5, " " * 50_000), (5, " " * 50_000), (6, "日本語" * 7_000 + "!?" * 9_000), (7, "plain words, it's 12 <|endoftext|>"),
]


def _want(ranks, doc, text):
    text = text or ""
    ids = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_encoding_equals_the_library_and_decodes(spark):
    docs, ranks = spark.createDataFrame(TEXTS, "doc_id long, text string"), bpe.read_ranks()
    got = [tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(docs))).collect()]
    assert sorted(got, key=str) == sorted((_want(ranks, *t) for t in TEXTS), key=str)


def test_long_texts_are_stitched_from_several_pieces(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    whole = bpe.texts(docs).withColumn("version", F.xxhash64("text"))
    rows = bpe.pieces(whole).orderBy("piece").collect()
    assert sum(r.doc_id == 3 for r in rows) > 1
    assert "".join(r.text for r in rows if r.doc_id == 3) == TEXTS[3][1]


def test_odd_rows_and_no_rows(odd):
    assert bpe.encode(odd).count() == odd.count()
    assert bpe.decode(bpe.encode(odd.limit(0))).count() == 0


def test_white_space_around_a_chunk_edge_is_matched_as_in_the_whole_text(spark):
    breaks = ["\n\n", "\n\n\n", "\n \n", "\r\n\r\n", " \n", "\t\t", "  ", "\n\n ", "\u00a0\u00a0", "\u3000\n", "'ll", "\x1c\x1c"]
    ranks = bpe.read_ranks()
    texts = ["a b " * 5_000]
    for white in breaks:
        for shift in range(-2, 3 + len(white)):
            edge = bpe.CHUNK - shift
            texts.append(("word " * edge)[: edge - 1] + "d" + white + "The next paragraph. " * 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(docs))).collect()}
    assert got == {_want(ranks, *t) for t in enumerate(texts)}
    assert bpe.pieces(bpe.texts(docs).withColumn("version", F.xxhash64("text"))).count() == 2 * len(texts)
