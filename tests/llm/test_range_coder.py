import numpy as np
import pytest

from shiftlens.llm import range_coder, token_output


@pytest.mark.parametrize("n", [0, 1, 5, 2047, 2048, 2049, 10_000])
@pytest.mark.parametrize("top", [1, 3, 50_257])
def test_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n)
    assert (range_coder.decode(range_coder.encode(ids)) == ids).all()


def test_predictable_ids_are_small_and_damage_is_found():
    ids = np.tile(np.arange(50), 200)
    coded = range_coder.encode(ids)
    assert len(coded) < len(ids) // 5
    broken = bytearray(coded)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(broken))


def test_blocks_do_not_depend_on_each_other():
    ids = np.random.default_rng(3).integers(0, 900, 3 * range_coder.BLOCK)
    found = dict(range_coder.decode_blocks(range_coder.encode(ids)))
    assert [len(found[k]) for k in range(3)] == [range_coder.BLOCK] * 3


def test_files_are_in_order_and_equal_the_library(spark, odd):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    got = sorted((tuple(r) for r in token_output.checksums(token_output.read_files(spark, token_output.write_files(odd))).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(want, key=str)
    at = 0
    for doc, start, n, _ in got:
        assert start == at
        at += n
    known = [d for d, *_ in got if d is not None]
    assert known == sorted(known) and [d for d, *_ in got][:2] == [None, None]
    assert token_output.read_files(spark, token_output.write_files(odd.limit(0))).count() == 0


def test_words_equal_the_library_on_awkward_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        definition = f.read()
    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    # white space of all kinds, contractions, control characters, joiners, marks, a special token and long words
    parts = ["\x00", "\x1c", "\x85", "\x7f", "\t", "\n", "\r\n", " ", "  ", " ", " ", "　", "᠎", "​", "﻿", "a", "b", "9", "a1", "1a", " it"]
    parts += ["é", "é ", "é", "中", "か", "\U0001f600", "“", "”", ".", "...", "-", "--", "'", "'s", "don't", "<|endoftext|>", "x" * 1100]
    dice, words, end = random.Random(5), token_output.Words(definition), np.array([2], "<u4")
    for _ in range(400):
        some = ["".join(dice.choices(parts, k=dice.randint(0, 25))) for _ in range(dice.randint(0, 6))]
        ids, count = words.encode([x.encode() for x in some], end)
        want = [[*library.encode(x, add_special_tokens=False).ids, 2] for x in some]
        assert ids.tolist() == sum(want, []) and count.tolist() == [len(x) for x in want]


def test_added_tokens_are_their_ids_as_in_the_untouched_library(spark):
    import random
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        words = token_output.Words(f.read())
    library = Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<", "|>", " ", "  ", "\n\n", "end", " x", "é", "9", "'s", "...", "\u3000"]
    dice = random.Random(7)
    for tail in ([2], [], [2, 3]):
        for _ in range(200):
            some = ["".join(dice.choices(parts, k=dice.randint(0, 12))) for _ in range(dice.randint(0, 6))]
            ids, count = words.encode_whole([x.encode() for x in some], np.array(tail, "<u4"))
            want = [[*library.encode(x, add_special_tokens=False).ids, *tail] for x in some]
            assert ids.tolist() == sum(want, []) and count.tolist() == [len(x) for x in want]
    texts = ["end <|endoftext|> x", "<|endoftext|>", "", "plain"]
    want = [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    got = sorted(tuple(r) for r in token_output.checksums(token_output.read_files(spark, token_output.write_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))).collect())
    assert want[0][2] == 50256
    assert [(d, n, c) for d, _, n, c in got] == [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in enumerate(want)]
    assert [start for _, start, _, _ in got] == [sum(map(len, want[:d])) for d in range(len(texts))]


def counting_words():
    """Words that note what goes to the library."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        words = token_output.Words(f.read())
    asked, ask = [], words._ids
    words._ids = lambda some: asked.extend(some) or ask(some)
    return words, asked


def test_words_with_accents_go_to_the_library_together():
    words, asked = counting_words()
    texts = [" ".join(f"été{i} caf{i}é naïveté".encode().decode() for i in range(k, k + 300)).encode() for k in (0, 300)]
    words.encode(texts, np.array([2], "<u4"))
    assert len(asked) < 20


def test_words_met_again_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(token_output, "CACHED", 500)
    words, asked = counting_words()
    tail, often = np.array([2], "<u4"), b"often seen words stay"
    want = words.encode([often], tail)[0].tolist()
    for k in range(30):
        ids, _ = words.encode([often, " ".join(f"w{k}x{i}" for i in range(200)).encode()], tail)
        assert ids[: len(want)].tolist() == want
    assert not any(b"often" in x for x in asked[1:]) and words.words < 1500


def test_a_text_of_more_words_than_the_table_first_holds():
    words, _ = counting_words()
    text = " ".join(f"q{i:x}" for i in range(150_000))
    ids, _ = words.encode([text.encode()], np.array([], "<u4"))
    assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert (words._known(words.names[: words.words]) == np.arange(words.words)).all()


def test_ids_read_back_move_nowhere(spark, odd):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = token_output.read_files(spark, token_output.write_files(odd))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Exchange hashpartitioning" not in plan[: plan.index("MapInArrow")]
