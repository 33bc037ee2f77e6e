"""Chat format: round trips, masks, and digests against brute force."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from netwarden.llm import chat, queries
from netwarden.llm.frames import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["<s>", "</s>", "[INST] ", " [/INST]", "[", "<", "\\", "\\l", "s>", "/s>", "é😀", " ", "  ", "\n", "ok", "[ROLE] ", " [TEXT] ", "<<SYS>>", "<</SYS>>", ">", " [/ROLE]", "日本", "\\\\b"]


@pytest.fixture(scope="module")
def tokenizer():
    return chat.tokenizer_from(open(PATH, encoding="utf-8").read())


def test_every_text_comes_back(tokenizer):
    rng = random.Random(2)
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool<s>", "[ROLE] x"]), "".join(rng.choices(PIECES, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))]
        formatted, spans = chat.render(turns)
        assert chat.read_back(formatted) == turns
        encoded = tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets).reshape(-1, 2)
        loss = chat.mask(offsets, spans)
        assert chat.unescape(chat.masked_text(formatted, offsets, loss)) == "".join(t for r, t in turns if r == "assistant")
        plain = [any(s <= a and b <= e and a < b for s, e in spans) for a, b in offsets.tolist()]
        assert loss.tolist() == plain


def test_blocks_encode_like_the_whole(tokenizer):
    turns = [("user", "one two"), ("assistant", " three  "), ("user", "four"), ("assistant", "five\n")]
    whole = tokenizer.encode(chat.render(turns)[0], add_special_tokens=False).ids
    parts = [tokenizer.encode(chat.render(turns[i : i + 1])[0], add_special_tokens=False).ids for i in range(4)]
    assert whole == sum(parts, [])


def brute(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, own in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = list(own)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_digests(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_CHARS", block)
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3, 9, 9, 9, 9, 9]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "", *PIECES, "long " * 300])) for _ in range(300)]
    rows += rows[:20]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.format_conversations(turns, PATH)).collect()}
    assert got == brute(rows)
    assert chat.digests(chat.format_conversations(turns.limit(0), PATH)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op7_chat(spark, sf).collect()}
    assert got == brute(rows)
