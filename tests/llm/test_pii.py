"""Personal data: patterns against brute force, the random field against enumeration, and its variants."""

import itertools
import math
import random
import re

import pytest

from netwarden.llm import pii
from netwarden.llm.frames import table


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_patterns():
    rng = random.Random(1)
    pieces = ["a", ".", "@", "b-c", "1", "23", "+1", "+", " ", "-", "(", ")", "4", "é", "256", "0", "12.", "a@b.c", "4111111111111111", "٣", "+15551234567", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 24)))
        assert pii.base_spans(text) == brute(text), repr(text)


def divisions(lattice, scored):
    """Every division of a stretch: its segments and its score."""
    n = len(lattice.tokens)

    def go(at):
        if at == n:
            yield [], 0.0
            return
        for rest, s in go(at + 1):
            yield rest, s
        for j, own in scored.items():
            for i, kind, score, _ in own:
                if i == at:
                    for rest, s in go(j):
                        yield [(kind, i, j), *rest], s + score

    return list(go(0))


def test_recursions_against_enumeration():
    text = "+1 22 (333"
    lattice = pii.Lattice(text, 0, len(text))
    rng = random.Random(3)
    weights = {(k, n): rng.gauss(0, 1) for i, j in lattice.segments() for n in lattice.features(i, j) for k in range(len(pii.KINDS))}
    scored = pii._scored(lattice, weights)
    every = divisions(lattice, scored)
    total = sum(math.exp(s) for _, s in every)
    gold = {(3, lattice.tokens[0][0], lattice.tokens[2][1])}
    want = {}
    for segments, s in every:
        for kind, i, j in segments:
            for name in lattice.features(i, j):
                want[kind, name] = want.get((kind, name), 0.0) - math.exp(s) / total
    for i, j in lattice.segments():
        for kind in range(len(pii.KINDS)):
            if (kind, lattice.tokens[i][0], lattice.tokens[j - 1][1]) in gold:
                for name in lattice.features(i, j):
                    want[kind, name] += 1
    got = pii._gradient(lattice, gold, weights)
    assert all(abs(got.get(k, 0.0) - want[k]) < 2e-2 for k in want)
    best = max(every, key=lambda x: x[1])[0]
    kept = [(k, lattice.tokens[i][0], lattice.tokens[j - 1][1]) for k, i, j in best if next(s for a, kk, s, _ in scored[j] if a == i and kk == k) > pii.MARGIN]
    assert pii.decode(lattice, weights) == kept


@pytest.fixture(scope="module")
def weights(spark):
    return pii.fit(table(spark, "/root/testdata/sf0.1", "documents"))


def test_unseen_forms(weights):
    found = [pii.spans_of(t, weights) for t in ["the shon (555) 123-4567 hested", "erna 4111/1111/1111/1111 inen", "thor 4111.1111.1111.1111 hen"]]
    assert [[k for k, _, _ in spans] for _, spans in found] == [[3], [2], [2]] and all(not base for base, _ in found)


def test_what_lies_beside_a_match_is_searched(weights):
    cases = [("the shon 10.0.0.1 (555) 123-4567 hested", "10.0.0.1", "555) 123-4567"), ("paid 4111/1111/1111/1111/10.0.0.1 then", "10.0.0.1", "4111/1111/1111/1111")]
    for text, matched, other in cases:
        base, spans = pii.spans_of(text, weights)
        assert [text[s:e] for _, s, e in base] == [matched]
        added = [x for x in spans if x not in base]
        assert any(other in text[s:e] for _, s, e in added), (text, added)
        assert all(e <= base[0][1] or s >= base[0][2] for _, s, e in added)


def test_plain_numbers_stay(weights):
    for text in ["in 1999-12-31 and 3.14.15", "total 123456789 units", "a 1 2 3 4 5 6 7 8 9 10 b", "met at noon.then at 5 pm", "1,234,567 people", "v1.2.3.4000"]:
        assert pii.spans_of(text, weights) == ([], [])


def test_tables(spark, weights):
    long = "x1 " * 40_000 + "a@b.cd"
    rows = [(1, None), (2, ""), (3, "mail a@b.cd, ip 1.2.3.4"), (3, "mail a@b.cd, ip 1.2.3.4"), (None, "+1 (555) 123-4567"), (4, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.search(docs, weights).collect()
    assert sorted((r["id"] or 0, tuple(map(tuple, r["base"]))) for r in got) == sorted((i or 0, tuple(brute(t or ""))) for i, t in rows)
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)
    assert pii.fit(docs.limit(0)) == {} and pii.search(docs.limit(0), {}).count() == 0
    assert [pii.spans_of(t, {})[1] for t in (None, "", "a@b.cd")] == [[], [], [(0, 0, 6)]]


def test_variants_mark_their_span():
    rng = random.Random(1)
    for text, spans in pii._variants("see john@mail.example.com now", [(0, 4, 25)], rng):
        for _, s, e in spans:
            assert text[s:e].startswith("john") and text[s:e].endswith("com")
    assert list(itertools.islice(pii.stretches("no number here"), 1)) == []


def test_zeros_without_end():
    assert pii.base_spans("x " + "0" * 5000 + ".1.1.1 y") == [(1, 2, 5008)]
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []
    assert pii.base_spans("000.0.0.00") == [(1, 0, 10)]


def test_long_addresses_are_stretches():
    for text in ["a" * 90 + " at " + "b" * 80 + ".example.org", "a.b at c dot d dot e dot f dot g dot h"]:
        assert pii.stretches(text) == [(0, len(text))]


def test_long_stretches_take_time_in_proportion():
    import time

    weights = {(3, "digits=10"): 3.0, (2, "luhn=True"): 1.0}
    spent = []
    for n in (500, 4000):
        text = " ".join(str(k) for k in range(n))
        start = time.process_time()
        pii.spans_of(text, weights)
        spent.append(time.process_time() - start)
    assert spent[1] < 14 * spent[0] + 0.1
    start = time.process_time()
    pii.spans_of("a.b-" * 250_000, weights)
    assert time.process_time() - start < 20
