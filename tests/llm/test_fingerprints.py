"""SimHash against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netwarden.llm import simhash


def brute_print(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def close_values(seed, groups=30, most=25):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2**63, groups, dtype=np.uint64).tolist():
        for _ in range(rng.integers(1, most)):
            value = base
            for k in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                value ^= 1 << k
            out.add(value)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_bit_sliced_links_give_all_components(radius):
    values = close_values(radius)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= radius]
    found = simhash.links_of(np.zeros(len(values), int), values.view(np.int64), radius)
    assert all(int(values[a] ^ values[b]).bit_count() <= radius for a, b in found)
    assert len(found) < len(values)
    assert roots(len(values), found) == roots(len(values), pairs)


@pytest.mark.parametrize("limit", [8192, 40])
def test_no_link_is_lost_when_buckets_are_divided(spark, limit):
    values = close_values(4, groups=60)
    nodes = values.view(np.int64).tolist()
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in nodes], "fp long"), 3, limit)
    at = {v: i for i, v in enumerate(nodes)}
    found = [(at[a], at[b]) for a, b in links.collect()]
    want = [(i, j) for i in range(len(nodes)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3]
    assert roots(len(nodes), found) == roots(len(nodes), want)


TEXTS = [None, "", " \t\n", "one", "One", "a b", "a b c d", "A B C D", "a  b\x0bc\nd", "x" * 5000, "w " * 30000, "é ß ñ 日本", "a b c"] + [
    " ".join(f"w{(i * 7 + j) % 50}" for j in range(i)) for i in range(3, 40)
]


def test_query_columns_against_brute_force(spark):
    rows = [(i, t, 0, "clash") for i, t in enumerate(TEXTS + TEXTS[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string").repartition(4)
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t, 3) for _, t, _, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert got == {i: (prints[i], root) for i, root in enumerate(roots(len(rows), pairs))}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(5)
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_one_of_each(spark):
    words = [f"word{i}" for i in range(400)]
    changed = words.copy()
    changed[200] = "other"
    other = [f"different{i}" for i in range(60)]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (9, " ".join(changed)), (3, " ".join(words)), (7, " ".join(other)), (None, "alone in the table"), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept.collect()) == [(0, "alone in "), (3, "word0 wor"), (7, "different"), (8, "")]


def test_similar_buckets_may_be_divided(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4)
    rows = []
    for i in range(300):  # near copies: about 20 of 256 bits differ
        noise = np.packbits(rng.random(256) < 0.05, bitorder="little").view(np.int64)
        rows.append((i, (base ^ noise).tolist()))
    prints = spark.createDataFrame(rows, "node long, fp array<long>")
    for limit in (8192, 50):
        found = [(r["a"], r["b"]) for r in simhash.link_similar(prints, 0.8, limit).collect()]
        assert len(set(roots(300, found))) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0
    assert simhash.fingerprint_of(None, 3) == 0
    assert docs.select(simhash.fingerprint(F.col("text"))).count() == 0


def test_bucket_size_changes_no_result(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 4)
    apart = (simhash.differing_bits(0.8) + 12) / 256  # most pairs differ in more bits than are linked
    rows = []
    for i in range(200):
        noise = np.packbits(rng.random(256) < (1 - (1 - 2 * apart) ** 0.5) / 2, bitorder="little").view(np.int64)
        rows.append((i, (base ^ noise).tolist()))
    prints = spark.createDataFrame(rows, "node long, fp array<long>")
    one, many = ([(r["a"], r["b"]) for r in simhash.link_similar(prints, 0.8, limit).collect()] for limit in (8192, 2))
    assert roots(200, one) == roots(200, many) and 1 < len(set(roots(200, one))) < 200


def share(a, b):
    a, b = set(simhash.shingles_of(a, 5)), set(simhash.shingles_of(b, 5))
    return len(a & b) / len(a | b)


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())


def test_short_pairs_inside_a_templated_family(spark):
    """Texts of one template at a share of 0.786, among them pairs at 0.818."""
    template = [f"t{i}" for i in range(48)]
    texts = [" ".join([*template, f"pair{i // 2}", *(f"own{i}x{k}" for k in range(5))]) for i in range(400)]
    assert share(texts[0], texts[2]) < 0.8 <= share(texts[0], texts[1])
    assert kept_ids(spark, texts) == list(range(0, 400, 2))


@pytest.mark.parametrize("block", [256, 7])
def test_shares_inside_a_component(spark, block):
    rng = np.random.default_rng(2)
    sets = []
    for base in range(6):
        for _ in range(12):
            sets.append(sorted({base * 1000 + int(x) for x in rng.choice(60, 52, replace=False)}))
    rows = [(i, i // 36 * 36, x) for i, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "node long, root long, shingles array<long>")
    found = [(r["a"], r["b"]) for r in simhash.link_shared(members, 0.8, block).collect()]
    close = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))
    want = [(i, j) for i in range(72) for j in range(i) if i // 36 == j // 36 and close(i, j)]
    assert all(close(a, b) for a, b in found)
    assert roots(72, found) == roots(72, want) and 6 < len(set(roots(72, want))) < 72


def test_long_texts_below_the_share_stay(spark):
    words = [f"word{i}" for i in range(400)]
    texts, changes = [" ".join(words)], {}
    for n in (6, 12, 18, 24, 30):  # every change of a word costs five shingles
        changed = words.copy()
        for k in range(n):
            changed[5 + 13 * k] = f"n{n}k{k}"
        texts.append(" ".join(changed))
        changes[len(texts) - 1] = share(texts[0], texts[-1])
    line = " ".join(f"line{i}" for i in range(8))  # two pages that share one line, repeated more often than they have other words
    texts += [" ".join([line] * 200 + [f"page{p}w{i}" for i in range(600)]) for p in (1, 2)]
    assert any(0.6 < s < 0.8 for s in changes.values()) and any(s >= 0.8 for s in changes.values())
    want = [i for i, root in enumerate(roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if share(texts[i], texts[j]) >= 0.8])) if root == i]
    assert kept_ids(spark, texts) == want


def test_similar_texts_against_all_pairs(spark):
    """Every two documents with 0.8 of their shingles in common lie in one group: one document is left of each, as if all pairs were compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: set(simhash.shingles_of(r["text"], 5)) for r in docs.collect()}
    holders = {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    ids = sorted(sets)
    place = {i: k for k, i in enumerate(ids)}
    pairs = set()
    for i in ids:
        shared = {}
        for s in sets[i]:
            for j in holders[s]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        pairs |= {(i, j) for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9}
    bare = [i for i in ids if not sets[i]]
    groups = roots(len(ids), [(place[a], place[b]) for a, b in pairs] + [(place[bare[0]], place[i]) for i in bare[1:]])
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect()}
    lost = [p for p in pairs if set(p) <= kept]
    assert len(pairs) > 50 and len(lost) <= 0.1 * len(pairs)
    assert {groups[place[i]] for i in kept} == set(groups)  # no group goes as a whole
