"""Encoding against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from netwarden.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "aa", "the", " ", "  ", "\n", " \n", "\t", "é", "ß", "1", "23", "!", "...", "$$$", "\x1c", "\x85", "\xa0", "　", "日", "本", "😀", "'s", "'ll", "​", "Ab", "\x00", "²", "½", ",", "word,", " word."]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return memoryview(packed).cast("I").tolist()


def test_mixed_texts(codec, library):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 40)))
        assert ids(codec.encode(text)) == library.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "aeiouth", "éè", "0123", "-=#", "thein", "x́y"])
def test_long_matches_are_joined_right(codec, library, letters):
    rng = random.Random(letters)
    for size in (25, 60, 300, 900):
        for _ in range(25):
            text = "".join(rng.choices(letters, k=size))
            assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_very_long_match(codec):
    text = "".join(random.Random(2).choices("abcdefgh", k=200_000))
    assert codec.decode(codec.encode(text)) == text.encode()


def test_both_merges_agree(codec):
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choices(b"theaniors ,.", k=rng.randint(1, 80)))
        assert codec.merge(data) == codec.merge_long(data)


def test_tables(spark, library):
    texts = [None, "", "a text", "a text", "w " * 20_000, "日本語 😀\n\n  x"]
    rows = [(None if i == 3 else i, t, i, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, id string")
    done = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    got = {r["id"]: (ids(bytes(r["ids"])), bytes(r["bytes"])) for r in done}
    assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows}
    kept = bpe.with_ids(docs, PATH, PATTERN, ids_col="packed")
    assert kept.columns == [*docs.columns, "packed", "decodes"]
    assert all(r["decodes"] for r in kept.collect())
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
    assert hashlib.sha256(bytes(done[0]["ids"])).hexdigest()
