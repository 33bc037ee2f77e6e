"""Repeat removal against brute force; interval trees against enumeration."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.llm import repeats


def brute(rows):
    rows = sorted(rows, key=lambda r: (repeats.NO_ID if r[0] is None else r[0], r[1] or ""))
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(data[i : i + 100])
        kept = bytes(x for x, y in zip(data, gone) if not y)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs):
    left = repeats.without_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return sorted((tuple(r) for r in left.select("id", "n_bytes", removed, F.size("spans").cast("long"), F.sha2("kept", 256)).collect()), key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abé \x00", k=rng.randint(60, 400))) for _ in range(6)] + ["x" * 300, "ab" * 200]

    def piece():
        if rng.random() < 0.5:
            return rng.choice(passages)[rng.randint(0, 40) :][: rng.randint(50, 400)]
        return "".join(rng.choices("abcd", k=rng.randint(0, 30)))

    rows = [(i if i % 17 else None, "".join(piece() for _ in range(rng.randint(0, 5)))) for i in range(120)]
    return rows + rows[:10] + [(500, None), (501, ""), (502, "z" * 99), (503, "z" * 100), (504, "z" * 100), (505, "z" * 101), (506, "long " * 8000)]


@pytest.mark.parametrize("seed,hot", [(1, 200_000), (2, 200_000), (2, 3), (3, 3)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, a int").repartition(5)
    assert run(docs) == brute(rows)


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH_ANCHORS", 50)
    monkeypatch.setattr(repeats, "FLUSH_AROUND", 20)
    rows = rows_of(4)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_equal_strings_hold_the_same_anchor():
    rng = np.random.default_rng(1)
    string = rng.integers(0, 256, repeats.LENGTH).astype(np.uint8)
    places = []
    for size in (0, 10, 333):
        data = np.concatenate([rng.integers(0, 256, size).astype(np.uint8), string, rng.integers(0, 256, 50).astype(np.uint8)])
        found, _ = repeats.anchors(data)
        places.append({int(p) - size for p in found if size <= p <= size + repeats.LEFT})
    assert set.intersection(*places)


def test_intervals():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted("".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(rng.randint(2, 9)))
        shared = [-1] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]
        got = set()
        for depth, parent, first, last in repeats.intervals(shared):
            got.add((depth, first, last))
            assert parent < depth
        want = set()
        for i in range(len(words)):
            for j in range(i + 1, len(words)):
                depth = min(shared[i + 1 : j + 1])
                left, right = i, j
                while left > 0 and shared[left] >= depth:
                    left -= 1
                while right + 1 < len(words) and shared[right + 1] >= depth:
                    right += 1
                want.add((depth, left, right))
        assert got == want


def test_earlier_reach():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        shared, when = [0] + [rng.randint(0, 5) for _ in range(n - 1)], rng.sample(range(50), n)
        ranks = sorted(rng.sample(range(n), rng.randint(1, n)))
        common = lambda a, b: min(shared[min(a, b) + 1 : max(a, b) + 1])
        want = [(r, max((common(r, q) for q in ranks if when[q] < when[r]), default=-1)) for r in ranks]
        assert repeats.earlier_reach(ranks, shared, when) == want


def contexts(rng, n):
    """Surroundings of one or two grams over a small alphabet."""
    out = []
    for _ in range(n):
        left = "".join(rng.choices("ab", k=rng.randint(0, 4)))
        right = "".join(rng.choices("ab", k=rng.randint(0, 4)))
        out.append((left, rng.choice("xy") * repeats.GRAM + right))
    return out


def test_maximal_repeats():
    rng = random.Random(5)
    for _ in range(150):
        made = contexts(rng, rng.randint(1, 9))
        around = np.zeros((len(made), repeats.AROUND), np.uint8)
        for i, (left, right) in enumerate(made):
            around[i, repeats.LEFT - len(left) : repeats.LEFT + len(right)] = np.frombuffer((left + right).encode(), np.uint8)
        key = np.array([ord(r[0]) for _, r in made], np.uint64)
        sizes = np.array([len(x) for x, _ in made]), np.array([len(x) for _, x in made])
        got = {(a, b, frozenset(rows)) for a, b, rows in repeats.maximal_repeats(key, *sizes, around, least=0)}
        want = set()
        for i, (left, right) in enumerate(made):
            for a in range(len(left) + 1):
                for b in range(repeats.GRAM, len(right) + 1):
                    rows = [j for j, (x, y) in enumerate(made) if x.endswith(left[len(left) - a :]) and len(x) >= a and y.startswith(right[:b])]
                    longer = lambda strings: len(set(strings)) == 1 and "" not in strings
                    before = [made[j][0][len(made[j][0]) - a - 1 : len(made[j][0]) - a] if len(made[j][0]) > a else "" for j in rows]
                    after = [made[j][1][b : b + 1] for j in rows]
                    if len(rows) > 1 and not longer(before) and not longer(after):
                        want.add((a, b, frozenset(rows)))
        assert got == want


def test_groups_cover_what_is_removed(spark):
    rows = [(i, t) for i, t in rows_of(6) if i is not None][:90]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in repeats.repeat_groups(docs).collect():
        groups.setdefault((r["repeat"], r["length"]), set()).add((r["id"], r["start"]))
    for (_, length), places in groups.items():
        assert len(places) > 1 and length >= repeats.LENGTH
        assert len({texts[i][s : s + length] for i, s in places}) == 1
    covered = {i: bytearray(len(t)) for i, t in texts.items()}
    for (_, length), places in groups.items():
        for i, s in sorted(places)[1:]:
            covered[i][s : s + length] = b"\1" * length
    for r in repeats.without_repeats(docs).collect():
        for s, e in r["spans"]:
            assert all(covered[r["id"]][s:e])
    assert repeats.repeat_groups(docs.limit(0)).count() == 0
