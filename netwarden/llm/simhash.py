"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside shared-bit buckets, and components.

A fingerprint bit is set when over half of the XXH64 hashes of a text's word shingles have it. Fingerprints that differ in at
most ``radius`` bits agree wholly on one of ``radius + 1`` parts of the bits, so each is sent to one bucket per part. A bucket
over ``limit`` rows is divided again by the parts of the bits that are still free; as its rows are distinct fingerprints and the
free bits dwindle, every bucket ends below the limit and no pair within the radius is missed. Inside a bucket the rows lie as
64 bit planes; one pass over the planes adds the differences of all rows to their s-th neighbour into carry-save counters, and a block is
abandoned as soon as all its counters exceed the radius. A bucket emits only links that join two parts not yet joined, so a
thousand near copies give a thousand links.

``one_of_each`` keeps one document of each group of similar texts, given as a share of common shingles. Such pairs differ in too many of 64
bits for shared parts, so it takes 256 bits of the distinct shingles: pairs meet where ``SAMPLE_BITS`` of ``SAMPLES`` fixed selections of the bits
agree, and are linked, again bit-sliced, if they differ in no more bits than texts of that similarity do. These links only say which texts to
compare: inside the components they form, texts are compared by their distinct shingles, and only pairs that have the share join a group.
By the binomial law about 998 of 1,000 pairs at the similarity itself meet, and more above it; the radius loses about one in 100,000.

Nulls and texts without a word have fingerprint zero and are linked like any other; copies share a fingerprint and are one node; an
empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import small_batches
from netwarden.session import checkpointed

SEED = 42
BITS = 64
#: Rows of a bucket that one task compares; larger buckets are divided by further bits.
LIMIT = 8192
#: Bits of a wide fingerprint, how many selections of them make buckets, and of how many bits each.
WIDE_BITS, SAMPLES, SAMPLE_BITS = 256, 128, 16
#: Texts whose shingles one task compares with as many others; larger components are dealt out over blocks of this size.
BLOCK = 256
#: Lanes of a block of the bit-sliced comparison.
LANES = 1 << 14


def shingles_of(text: str | None, size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - size + 1)].tolist()
    return [joined[s:e] for s, e in zip(starts, ends[min(size, len(words)) - 1 :].tolist())]


def majority(hashes: bytes, bits: int) -> bytes:
    """Bits that over half of the packed hashes have."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, bits // 8)
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(rows), 255):  # sums of 255 bits fit one byte
        counts += np.unpackbits(rows[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(rows), bitorder="little").tobytes()


def fingerprint_of(text: str | None, size: int) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import xxhash

    digest = xxhash.xxh64_digest
    shingles = shingles_of(text, size)
    if not shingles:
        return 0
    return int.from_bytes(majority(b"".join([digest(x, SEED) for x in shingles]), BITS), "big", signed=True)


def wide_fingerprint_of(text: str | None, size: int) -> tuple[np.ndarray, int]:
    """256 bits of the distinct shingles of one text as four signed numbers, and a hash of the set of shingles."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    shingles = set(shingles_of(text, size))
    if not shingles:
        return np.zeros(WIDE_BITS // 64, np.int64), 0
    hashes = sorted(digest(x, SEED) + digest(x, SEED + 1) for x in shingles)
    packed = b"".join(hashes)
    return np.frombuffer(majority(packed, WIDE_BITS), np.int64), int.from_bytes(xxhash.xxh64_digest(packed, SEED), "big", signed=True)


def shingle_set_of(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text."""
    import xxhash

    return np.array([int.from_bytes(xxhash.xxh64_digest(x, SEED), "big", signed=True) for x in set(shingles_of(text, size))], np.int64)


def fingerprint(text: Column, size: int = 3) -> Column:
    """Column of fingerprints over shingles of ``size`` words."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")

    return of(text)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit plane b as packed 64-row words: row i of ``values`` is bit i % 64 of word i // 64. A row is one or several numbers."""
    values = values.reshape(len(values), -1)
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def shifted(words: np.ndarray, by: int) -> np.ndarray:
    """Rows moved ``by`` places to the front."""
    whole, part = divmod(by, 64)
    out = np.zeros_like(words)
    kept = words[whole:]
    out[: len(kept)] = kept >> np.uint64(part)
    if part:
        following = words[whole + 1 :]
        out[: len(following)] |= following << np.uint64(64 - part)
    return out


def within_radius(planes: np.ndarray, by: int, radius: int) -> np.ndarray:
    """Packed mask of rows whose distance to the row ``by`` places further is at most ``radius``."""
    width = planes.shape[1]
    counters = [np.zeros(width, np.uint64) for _ in range(radius.bit_length() + 1)]
    over = np.zeros(width, np.uint64)
    full = ~np.uint64(0)
    top = 1 << (len(counters) - 1)  # the highest counter bit means more than the radius
    for b in range(planes.shape[0]):
        carry = planes[b] ^ shifted(planes[b], by)
        for k, counter in enumerate(counters[:-1]):
            counter ^= carry
            carry = carry & ~counter
        over |= carry
        if b % 8 == 7 and top == radius + 1 and (over == full).all():
            return np.zeros(width, np.uint64)
    if top != radius + 1:  # radii that are not one below a power of two: read the counters
        value = np.zeros(width * 64, np.int64)
        for k, counter in enumerate(counters[:-1]):
            value += np.unpackbits(counter.view(np.uint8), bitorder="little").astype(np.int64) << k
        over |= np.packbits(value > radius, bitorder="little").view(np.uint64)
    return ~over


def links_of(bucket: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of linked rows, one spanning set of links for each bucket; equal ``bucket`` values lie together."""
    found: list[tuple[int, int]] = []
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    # Buckets of like size lie together, so that a shift runs only over rows that have such a neighbour.
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 1]
    block: list[int] = []
    rows = 0
    for k, j in enumerate(order):
        block.append(j)
        rows += sizes[j]
        if rows >= LANES or k == len(order) - 1 or sizes[order[k + 1]] > 2 * sizes[block[0]] + 64:
            at = np.concatenate([np.arange(starts[i], ends[i]) for i in block])
            found += block_links(at, np.repeat(np.arange(len(block)), sizes[block]), values[at].view(np.uint64), radius, int(sizes[block].max()))
            block, rows = [], 0
    return found


def block_links(at: np.ndarray, group: np.ndarray, values: np.ndarray, radius: int, longest: int) -> list[tuple[int, int]]:
    planes = planes_of(values)
    root = np.arange(len(at))
    found = []
    for by in range(1, longest):
        near = within_radius(planes, by, radius)
        if not near.any():
            continue
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(at) - by])
        rows = rows[(group[rows] == group[rows + by])]
        rows = rows[root[rows] != root[rows + by]]
        for i in rows.tolist():
            a, b = find(root, i), find(root, i + by)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(at[i]), int(at[i + by])))
        if len(rows):
            while not np.array_equal(root, up := root[root]):
                root = up
    return found


def find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def parts(mask: int, radius: int) -> list[int]:
    """Masks that add each of the ``radius + 1`` parts of the bits outside ``mask`` to it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [round(k * len(free) / (radius + 1)) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def link_fingerprints(prints: DataFrame, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of ``prints.fp`` within the radius.

    ``prints`` holds distinct fingerprints in a column ``fp`` and should be materialized.
    """
    limit = max(limit, 1 << (radius + 2))
    masks = {signed(m): m for m in parts(0, radius)}
    rows = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    out = None
    while True:
        rows = rows.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        large = rows.groupBy("mask", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        large = checkpointed(large.select("mask", "bucket"))
        divided = not large.isEmpty()
        small = rows.join(large, ["mask", "bucket"], "left_anti") if divided else rows
        found = compared(small, radius)
        out = found if out is None else out.unionByName(found)
        if not divided:
            return out
        children = {s: [signed(c) for c in parts(m, radius)] for s, m in masks.items()}
        masks = {signed(c): c for m in masks.values() for c in parts(m, radius)}
        deeper = F.create_map(*[x for s, c in children.items() for x in (F.lit(s), F.array(*map(F.lit, c)))])
        rows = checkpointed(rows.join(large, ["mask", "bucket"], "left_semi").select("fp", F.explode(deeper[F.col("mask")]).alias("mask")).distinct())


def starred(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of the same components, to the smallest node of each, so that other buckets are likely to give the same links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, r) for x in list(up) if (r := root(x)) != x]


def compared(rows: DataFrame, radius: int) -> DataFrame:
    """Spanning links of every bucket ``(mask, bucket)``, bucket after bucket over sorted partitions. A fingerprint is a number ``fp``, or
    an array of numbers, which a link names by the number ``node``."""
    wide = "node" in rows.columns

    def scan(batches):
        left: list[np.ndarray] = []

        def links(columns):
            mask, bucket, node, fp = columns
            change = (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])
            pairs = links_of(np.append(0, np.cumsum(change)), fp, radius)
            linked = starred([(int(node[i]), int(node[j])) for i, j in pairs])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in linked], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(3)]
            now.append(np.asarray(batch.column(3).flatten()).reshape(len(now[0]), -1) if wide else now[2])
            left = [np.concatenate([x, y]) for x, y in zip(left, now)] if left else now
            if len(left[0]) < 1 << 16:
                continue
            mask, bucket = left[:2]
            last = np.flatnonzero((mask != mask[-1]) | (bucket != bucket[-1]))
            if len(last):  # the last bucket may go on in the next batch
                cut = last[-1] + 1
                yield links([x[:cut] for x in left])
                left = [x[cut:] for x in left]
        if left and len(left[0]):
            yield links(left)

    names = ["mask", "bucket", "node", "fp"] if wide else ["mask", "bucket", "fp"]
    # Dealt by a hash of the two: the exchange of a join by the same columns would stand in for this one, and adaptive reads may split that.
    return rows.select(*names).repartition(F.xxhash64("mask", "bucket")).sortWithinPartitions(*names[:3]).mapInArrow(scan, "a long, b long")


def differing_bits(similarity: float) -> int:
    """Bits of a wide fingerprint in which texts of that share of common shingles differ, with a margin of three deviations and more: one below a
    power of two, where the counters need not be read."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return (1 << int(WIDE_BITS * angle + 3 * math.sqrt(WIDE_BITS * angle * (1 - angle))).bit_length()) - 1


def selection(rng: random.Random, bits: int) -> list[int]:
    """Places of some bits."""
    return rng.sample(range(WIDE_BITS), bits)


def sampled(rows: DataFrame, selections: list[list[int]]) -> DataFrame:
    """Each row in one bucket for every selection."""
    def numbered(places: list[int]):
        words = [sum(1 << (b % 64) for b in places if b // 64 == k) for k in range(WIDE_BITS // 64)]
        return F.struct(*[F.lit(signed(w)).alias(f"m{k}") for k, w in enumerate(words)])

    masks = F.array(*[F.struct(F.lit(i).alias("mask"), numbered(p).alias("bits")) for i, p in enumerate(selections)])
    out = rows.select("node", "fp", F.explode(masks).alias("s"))
    parts = [F.get("fp", F.lit(k)).bitwiseAND(F.col(f"s.bits.m{k}")) for k in range(WIDE_BITS // 64)]
    return out.select("node", "fp", F.col("s.mask").alias("mask"), F.xxhash64(*parts).alias("bucket"))


def block_of(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(SEED)), blocks).cast("long")


def link_similar(prints: DataFrame, similarity: float, limit: int = LIMIT) -> DataFrame:
    """Links ``(a, b)`` between the nodes of similar wide fingerprints in a materialized table ``(node, fp)``. The rows of a bucket over the limit
    are dealt out over blocks of half the limit, and every two blocks are compared, so the limit changes no component."""
    rng = random.Random(SEED)
    radius = differing_bits(similarity)
    rows = sampled(prints.select("node", "fp"), [selection(rng, SAMPLE_BITS) for _ in range(SAMPLES)])
    large = checkpointed(rows.groupBy("mask", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > limit))
    if large.isEmpty():
        return compared(rows, radius)
    found = compared(rows.join(large, ["mask", "bucket"], "left_anti"), radius)
    blocks = F.ceil(2 * F.col("n") / limit)
    hot = rows.join(large, ["mask", "bucket"]).withColumn("blocks", blocks).withColumn("own", block_of(F.col("node"), F.col("blocks")))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != F.col("own"))
    dealt = hot.withColumn("other", F.explode(other))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return found.unionByName(compared(dealt.select("node", "fp", "mask", pair.alias("bucket")), radius))


def sharing(sets: list[np.ndarray], group: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions whose sets have that share in common; a pair that lies in one ``group``, or that earlier pairs join, is left out."""
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    group = np.unique(group, return_inverse=True)[1]
    marked = np.zeros(len(ids), np.int32)
    found = []
    for i in range(len(sets) - 1):
        if (group[i + 1 :] == group[i]).all():
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        marked[own] = 1
        shared = np.add.reduceat(marked[ids[ends[i] :]], ends[i:-1] - ends[i])
        marked[own] = 0
        near = shared >= similarity * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9
        for j in (np.flatnonzero(near & (group[i + 1 :] != group[i])) + i + 1).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                found.append((i, j))
    return found


def verified(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of the nodes in each ``part`` of ``(part, node, label, shingles)`` that have the share; nodes of one label are joined already."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        nodes = part["node"].to_numpy()
        pairs = sharing([np.asarray(x) for x in part["shingles"]], part["label"].to_numpy(), similarity) if len(nodes) > 1 else []
        return pd.DataFrame({"a": nodes[[i for i, _ in pairs]], "b": nodes[[j for _, j in pairs]]}, dtype="int64")

    return rows.select("part", "node", "label", "shingles").groupBy("part").applyInPandas(links, "a long, b long")


def link_shared(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of one ``root`` in a materialized table ``(node, root, shingles)`` that have the share.

    A root of many nodes is compared in blocks, each of which has the root's own node as well. Where that leaves several groups, every block of
    nodes outside the largest group is compared with every other block.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block))
    sized = members.join(sizes, "root").withColumn("blocks", blocks)
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = sized.withColumn("k", F.explode(F.when(F.col("node") == F.col("root"), everywhere).otherwise(F.array(block_of(F.col("node"), F.col("blocks"))))))
    first = checkpointed(verified(dealt.withColumn("part", F.xxhash64("root", "k")).withColumn("label", F.col("node")), similarity))
    large = checkpointed(sized.filter("blocks > 1").select("node", "root"))
    if large.isEmpty():
        return first
    joined = components(first.join(large.select(F.col("node").alias("a")), "a", "left_semi")).withColumnRenamed("root", "label")
    labelled = checkpointed(large.join(joined, "node", "left").select("node", "root", F.coalesce("label", "node").alias("label")))
    groups = labelled.groupBy("root", "label").agg(F.count("*").alias("n"))
    main = groups.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("n_groups"))
    main = main.filter("n_groups > 1").withColumn("main_blocks", F.ceil(F.col("n_main") / block)).withColumn("blocks", F.col("main_blocks") + F.ceil((F.col("n") - F.col("n_main")) / block))
    open_ = labelled.join(main, "root").withColumn("rest", F.col("label") != F.col("main"))
    # Blocks of the largest group come first; two of them need not meet.
    own = F.when(F.col("rest"), F.col("main_blocks") + block_of(F.col("node"), F.col("blocks") - F.col("main_blocks"))).otherwise(block_of(F.col("node"), F.col("main_blocks")))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: (k != F.col("own")) & (F.col("rest") | (k >= F.col("main_blocks"))))
    pairs = open_.withColumn("own", own).withColumn("other", F.explode(other))
    part = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    again = pairs.select("node", "label", part.alias("part")).join(members.select("node", "shingles"), "node")
    return first.unionByName(verified(again, similarity))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; alternating large-star and small-star steps."""
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: its id, fingerprint ``fp`` and ``component_id``, the smallest id of its group."""
    small_batches(docs.sparkSession)
    prints = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size).alias("fp")))
    return prints.join(groups(prints, radius), "fp").select("id", "fp", "component_id")


def groups(prints: DataFrame, radius: int) -> DataFrame:
    """``(fp, component_id)`` for every distinct fingerprint of a materialized table ``(id, fp)``."""
    classes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(link_fingerprints(classes, radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the one with the smallest id, and one of rows that share it."""
    small_batches(docs.sparkSession)
    fp, node, component = "__simhash_fp", "__simhash_node", "__simhash_component"

    @F.pandas_udf("fp array<long>, node long")
    def wide(texts: pd.Series) -> pd.DataFrame:
        made = [wide_fingerprint_of(t, size) for t in texts]
        return pd.DataFrame({"fp": [x for x, _ in made], "node": pd.Series([x for _, x in made], dtype="int64")})

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set_of(t, size) for t in texts], dtype=object)

    # A node is a set of shingles: texts of one node have all of them in common.
    made = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), wide(F.col(text_col)).alias("w"))
    prints = checkpointed(made.select("id", "copy", "w.fp", "w.node"))
    classes = checkpointed(prints.groupBy("node").agg(F.min("id").alias("first"), F.first("fp").alias("fp")))
    near = checkpointed(components(link_similar(classes.filter("node <> 0").select("node", "fp"), similarity).distinct()))
    shown = prints.join(near, "node").groupBy("node", "root").agg(F.min(F.struct("id", "copy")).alias("row"))
    shown = shown.select(F.col("node").alias(node), F.col("root").alias(component), F.col("row.id").alias(fp), F.col("row.copy").alias("__simhash_copy"))
    texts = docs.join(shown, docs[id_col].eqNullSafe(F.col(fp)) & (F.xxhash64(docs[text_col]) == F.col("__simhash_copy")))
    sets = texts.select(F.col(node).alias("node"), F.col(component).alias("root"), shingles(docs[text_col]).alias("shingles"))
    links = link_shared(checkpointed(sets.dropDuplicates(["node"])), similarity)
    roots = components(links).withColumnRenamed("node", "linked")
    rooted = classes.join(roots, F.col("node") == F.col("linked"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min_by("node", F.struct(F.col("first").isNull(), "first", "node")).alias("node"), F.min("first").alias("id"))
    # The row to keep of a group is known by its id and its text's hash, which few bytes of every row tell.
    ids = prints.join(kept.withColumnRenamed("id", "kept_id"), "node").filter(F.col("id").eqNullSafe(F.col("kept_id")))
    chosen = ids.groupBy(F.col("node").alias(node)).agg(F.min("copy").alias(component), F.first("id").alias(fp))
    same = docs[id_col].eqNullSafe(F.col(fp)) & (F.xxhash64(docs[text_col]) == F.col(component))
    own = docs.join(chosen, same)
    return own.dropDuplicates([node]).select(*docs.columns)
