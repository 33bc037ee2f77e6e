"""Removal of repeated byte strings by common-prefix interval trees over a sampled, distributed suffix array.

The task is to find every string of ``LENGTH`` bytes that starts earlier as well. Anchors sample the suffixes: of the grams of ``GRAM`` bytes in a string, those
with the smallest hash are anchors, wherever the string lies, so all its occurrences hold the same anchor at the same place. Only anchors whose
gram occurs at least twice go on, each with the bytes around it that the strings reach in which it is the anchor.

The suffixes of one gram, sorted, with the lengths of the prefixes that neighbours share, are an enhanced suffix array. A scan with a stack gives its
tree of intervals: suffixes that share their next d bytes. In an interval the bytes to the left tell which occurrences belong to one maximal
repeat: the occurrences are put in order of their left bytes, and a second scan finds for each the longest left extension it
shares with an earlier one. All occurrences of a group are compared in this way, not only neighbours, and no pair is formed.

Hot grams: a partition first reports a gram once, so a gram reaches its bucket at most once from each partition; copies of a surrounding are
settled where they lie, all but the first; and a gram with over ``HOT`` occurrences is dealt out over ``SALT`` tasks, each of which settles
what repeats inside, and sends on only the strings that did not, to be compared by content.

Ids are integers; a null id counts as smaller than all others, and documents with one id are ordered by their text. A null text is an empty
text; repeated rows repeat all their strings; texts under ``LENGTH`` bytes lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netwarden.llm.frames import small_batches

LENGTH, GRAM = 100, 24
#: Places of a gram in a string, and the bytes of a surrounding: as many to the left and right as a string may reach.
SPAN = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
AROUND = LEFT + LENGTH
#: Occurrences from which a gram is dealt out, and over how many tasks.
HOT, SALT = 200_000, 64
#: Anchors, and surroundings, that a task gathers before it sends them on.
FLUSH_ANCHORS, FLUSH_AROUND = 1_000_000, 120_000
#: Stands for a null id, and is read as one.
NO_ID = -(1 << 63)


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every byte."""
    n = len(data) - GRAM + 1
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for width in (1, 2, 4):  # eight bytes in one number
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    h = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, factor in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(29)
        h += x[at : at + n]
        h *= np.uint64(factor)
    return h ^ h >> np.uint64(32)


def sliding(x: np.ndarray, width: int, least: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, from running ones inside blocks."""
    padded = np.full(-(-len(x) // width) * width, fill, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = least.accumulate(blocks, axis=1).ravel()
    backward = least.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(backward[: len(x) - width + 1], forward[width - 1 : len(x)])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of grams that have the smallest hash in some string; ties all count."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(data)
    order = (h >> np.uint64(32)).astype(np.uint32)
    least = np.pad(sliding(order, SPAN, np.minimum, 0xFFFFFFFF), SPAN - 1)
    places = np.flatnonzero(sliding(least, SPAN, np.maximum, 0) == order)
    return places, h[places]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and the offsets of its rows."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


# Reports of grams ------------------------------------------------------------------------------------------------------------------------------

REPORT = np.dtype([("key", "<u8"), ("did", "<i8"), ("rn", "<i4"), ("pos", "<i4"), ("n", "<i4")])


def _reports(buckets: int):
    """Per flush and bucket one packed report of grams. A gram found several times is known to repeat: its first place goes to the bucket
    of the gram with the number of places, the others need no answer and go to any bucket with the number 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = np.concatenate(held)
            order = np.argsort(found["key"], kind="stable")
            found = found[order]
            first = np.append(True, found["key"][1:] != found["key"][:-1])
            counts = np.diff(np.append(np.flatnonzero(first), len(found)))
            found["n"] = 0
            found["n"][first] = counts
            bucket = np.where(first, found["key"] % np.uint64(buckets), (found["did"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((found["pos"], found["did"], bucket))
            found, bucket = found[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cuts[1:], len(found))
            # By column, as like values lie together then.
            blobs = [b"".join(found[name][a:b].tobytes() for name in REPORT.names) for a, b in zip(cuts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(blobs, pa.binary())], ["slot", "blob"])

        for batch in batches:
            data, offsets = _texts(batch.column(2))
            did, rn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, keys = anchors(data)
            row = np.searchsorted(offsets, places, side="right") - 1
            inside = (places + GRAM <= offsets[row + 1]) & (offsets[row + 1] - offsets[row] >= LENGTH)
            places, keys, row = places[inside], keys[inside], row[inside]
            out = np.empty(len(places), REPORT)
            out["key"], out["did"], out["rn"], out["pos"] = keys, did[row], rn[row], places - offsets[row]
            held.append(out)
            size += len(out)
            if size >= FLUSH_ANCHORS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of grams that occur at least twice, packed as row and place; and the hot grams."""
    parts = []
    names = ["hot", "did", "place"]
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            n = len(blob) // REPORT.itemsize
            rows, at = np.empty(n, REPORT), 0
            for name in REPORT.names:
                kind = REPORT[name]
                rows[name] = np.frombuffer(blob, kind, n, at)
                at += n * kind.itemsize
            settled = rows[rows["n"] == 0]
            if len(settled):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(settled), bool)), pa.array(settled["did"]), pa.array(_place(settled))], names)
            parts.append(rows[rows["n"] > 0])
    if parts:
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        first = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1])) if len(rows) else np.zeros(0, int)
        if len(first):
            total = np.add.reduceat(rows["n"].astype(np.int64), first)
            each = np.repeat(total, np.diff(np.append(first, len(rows))))
            again = rows[each > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(again), bool)), pa.array(again["did"]), pa.array(_place(again))], names)
            hot = rows["key"][first][total > HOT].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(hot), bool)), pa.array(hot), pa.array(np.zeros(len(hot), np.int64))], names)


def _place(rows: np.ndarray) -> np.ndarray:
    return rows["rn"].astype(np.int64) << 32 | rows["pos"]


# Surroundings ----------------------------------------------------------------------------------------------------------------------------------

AROUND_SCHEMA = "kind int, key long, did long, rn int, a int, b int, around binary"


def _batch(kind: int, key, did, rn, a, b, around) -> pa.RecordBatch:
    n = len(did)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(did), pa.array(np.asarray(rn, np.int32)), pa.array(np.asarray(a, np.int32)), pa.array(np.asarray(b, np.int32)),
         around if around is not None else pa.nulls(n, pa.binary())], ["kind", "key", "did", "rn", "a", "b", "around"],
    )


def _ranges(did, rn, start, end) -> pa.RecordBatch:
    """Removed ranges, merged where they touch."""
    order = np.lexsort((start, rn, did))
    did, rn, start, end = (np.asarray(x)[order] for x in (did, rn, start, end))
    if not len(did):
        return _batch(0, np.zeros(0, np.int64), did, rn, start, end, None)
    new = np.append(True, (did[1:] != did[:-1]) | (rn[1:] != rn[:-1]))
    group = np.cumsum(new)
    # Running largest end inside a document: later documents get a higher floor.
    floor = group.astype(np.int64) << 32
    reach = np.maximum.accumulate(floor + end) - floor
    apart = np.append(True, new[1:] | (start[1:] > reach[:-1]))
    cuts = np.flatnonzero(apart)
    last = np.append(cuts[1:], len(did)) - 1
    return _batch(0, did[cuts], did[cuts], rn[cuts], start[cuts], reach[last], None)


def _surroundings(batches: Iterator[pa.RecordBatch], settle_copies: bool = True) -> Iterator[pa.RecordBatch]:
    """For the anchors of documents in order: the bytes around each. Copies of one that the task has met in this flush are removed at once."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, did, rn, pos, left, right = (np.concatenate([h[k] for h in held]) for k in range(6))
        around = np.concatenate([h[6] for h in held])
        words = np.concatenate([around, np.stack([left, right], axis=1).astype(np.uint8), np.zeros((len(around), 6), np.uint8)], axis=1).view(np.uint64)
        mixed = np.zeros(len(words), np.uint64)
        for k in range(words.shape[1]):
            mixed = (mixed ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        order = np.lexsort((pos, rn, did, mixed))
        sorted_mixed = mixed[order]
        first = np.append(True, sorted_mixed[1:] != sorted_mixed[:-1])
        source = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        copy = ~first & (words[order] == words[source]).all(axis=1) & settle_copies
        gone, kept = order[copy], np.sort(order[~copy])
        gone = gone[left[gone] + right[gone] >= LENGTH]
        yield _ranges(did[gone], rn[gone], pos[gone] - left[gone], pos[gone] + right[gone])
        yield _batch(1, key[kept].view(np.int64), did[kept], rn[kept], pos[kept], left[kept] * 256 + right[kept], _binary(around[kept]))

    for batch in batches:
        data, offsets = _texts(batch.column(2))
        did, rn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(3)
        own = np.repeat(np.arange(len(did)), np.diff(np.asarray(lists.offsets)))
        places = np.asarray(lists.flatten())
        mine = places >> 32 == rn[own]
        own, pos = own[mine], places[mine] & 0xFFFFFFFF
        at = offsets[own] + pos
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        hashes = grams(data) if len(at) else np.zeros(0, np.uint64)
        order = np.pad((hashes >> np.uint64(32)).astype(np.uint32), LEFT, constant_values=0xFFFFFFFF)
        for lo in range(0, len(at), FLUSH_AROUND):
            part = slice(lo, lo + FLUSH_AROUND)
            a, o = at[part], own[part]
            around = padded[a[:, None] + np.arange(AROUND)]
            # Only strings in which this gram has the smallest hash; the others have an anchor of their own.
            own_hash = order[a + LEFT][:, None]
            before = order[a[:, None] + np.arange(LEFT - 1, -1, -1)] < own_hash
            after = order[a[:, None] + np.arange(LEFT + 1, 2 * LEFT + 1)] < own_hash
            reach_left = np.where(before.any(axis=1), before.argmax(axis=1), LEFT)
            reach_right = np.where(after.any(axis=1), after.argmax(axis=1) + GRAM, LENGTH)
            left = np.minimum(reach_left, a - offsets[o])
            right = np.minimum(reach_right, offsets[o + 1] - a)
            useful = left + right >= LENGTH
            a, o, own_pos, left, right, around = a[useful], o[useful], pos[part][useful], left[useful], right[useful], around[useful]
            column = np.arange(AROUND)
            around[(column < LEFT - left[:, None]) | (column >= LEFT + right[:, None])] = 0
            held.append((hashes[a], did[o], rn[o], own_pos, left, right, around))
            size += len(a)
            if size >= FLUSH_AROUND:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


# Interval trees --------------------------------------------------------------------------------------------------------------------------------


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Intervals of an enhanced suffix array: (depth, depth of the parent, first, last). ``shared[i]`` is what suffixes i - 1 and i have in common."""
    stack: list[tuple[int, int]] = []  # depth, first
    for i in range(1, len(shared) + 1):
        depth = shared[i] if i < len(shared) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            parent = max(depth, stack[-1][0] if stack else -1)
            yield top, parent, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def earlier_reach(ranks: list[int], shared: list[int], when: list[int]) -> list[tuple[int, int]]:
    """(rank, longest extension shared with an earlier occurrence) for occurrences given by their sorted ranks in the order of left
    bytes; ``shared`` and ``when`` are by rank. -1: none is earlier."""
    n = len(ranks)
    common = [0] + [min(shared[ranks[k - 1] + 1 : ranks[k] + 1]) for k in range(1, n)]
    best = [-1] * n
    for forward in (True, False):
        stack: list[tuple[int, int]] = []  # time, what it shares with the one below it
        reach = 0
        for k in range(n) if forward else range(n - 1, -1, -1):
            reach = common[k] if forward else common[k + 1] if k + 1 < n else 0
            time = when[ranks[k]]
            while stack and stack[-1][0] > time:
                reach = min(reach, stack.pop()[1])
            if stack:
                best[k] = max(best[k], reach)
            stack.append((time, reach))
    return list(zip(ranks, best))


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of big-endian numbers, the first to sort by first."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before it; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.append(0, np.minimum(length, np.minimum(sizes[1:], sizes[:-1])))


def settle(key: np.ndarray, time: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed ranges (row, start, end) among the occurrences of whole grams; ``time`` orders them."""
    rights, lefts = around[:, LEFT:], around[:, :LEFT][:, ::-1]
    order = np.lexsort([time, left, *_words(lefts)[::-1], right, *_words(rights)[::-1], key])
    shared = _common(rights[order], right[order])
    same_gram = np.append(False, key[order][1:] == key[order][:-1]) & (shared >= GRAM)
    shared_left = _common(lefts[order], left[order])
    copy = same_gram & (shared == right[order]) & (shared_left == left[order])
    copy[1:] &= (right[order][1:] == right[order][:-1]) & (left[order][1:] == left[order][:-1])
    gone = order[copy]
    gone = gone[left[gone] + right[gone] >= LENGTH]
    out_row, out_start, out_end = [gone], [pos[gone] - left[gone]], [pos[gone] + right[gone]]
    # One row of each surrounding is left, the earliest; a row's prefix shared with the one before it stays what it was.
    order, shared, same_gram = order[~copy], shared[~copy], same_gram[~copy]
    group = np.cumsum(~same_gram) - 1
    sizes = np.bincount(group) if len(group) else np.zeros(0, int)
    starts = np.cumsum(sizes) - sizes
    # Groups of two need no tree.
    a = order[starts[sizes == 2]]
    b = order[starts[sizes == 2] + 1] if len(a) else a
    if len(a):
        both = shared[starts[sizes == 2] + 1]
        differ = lefts[a] != lefts[b]
        common = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT), np.minimum(left[a], left[b]))
        later = np.where(time[a] < time[b], b, a)
        long = common + both >= LENGTH
        out_row.append(later[long])
        out_start.append((pos[later] - common)[long])
        out_end.append((pos[later] + both)[long])
    rows: list[int] = []
    begins: list[int] = []
    ends: list[int] = []
    larger = np.flatnonzero(sizes >= 3)
    if len(larger):
        member = np.isin(group, larger)
        of, own = order[member], group[member]
        by_left = np.lexsort([time[of], left[of], *_words(lefts[of])[::-1], own])
        common = _common(lefts[of][by_left], left[of][by_left])
        rank = np.empty(len(of), np.int64)
        rank[by_left] = np.arange(len(of))
        whens = time[of][by_left]
        extra = shared[member] - GRAM
        at = 0
        for size in sizes[larger].tolist():
            part = slice(at, at + size)
            ranks = (rank[part] - at).tolist()
            prefix, when, ext = common[part].tolist(), whens[part].tolist(), extra[part].tolist()
            of_rank = of[by_left[part]]
            widest = max(prefix[1:])
            for depth, parent, first, last in intervals(ext):
                need, most = LEFT - depth, LEFT - parent - 1
                if need > widest:
                    continue
                for r, reach in earlier_reach(sorted(ranks[first : last + 1]), prefix, when):
                    if reach >= need:
                        row = int(of_rank[r])
                        rows.append(row)
                        begins.append(int(pos[row]) - min(most, reach))
                        ends.append(int(pos[row]) + GRAM + depth)
            at += size
    out_row.append(np.array(rows, np.int64))
    out_start.append(np.array(begins, np.int64))
    out_end.append(np.array(ends, np.int64))
    return np.concatenate(out_row), np.concatenate(out_start), np.concatenate(out_end)


def maximal_repeats(key: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least ``least`` bytes around each gram: (bytes left of the gram, bytes from it on, all rows that hold it).

    An interval of the right order whose rows go on differently cannot be extended to the right; its rows in the order of
    their left bytes form intervals again, none of which can be extended to the left.
    """
    rights, lefts = around[:, LEFT:], around[:, :LEFT][:, ::-1]
    order = np.lexsort([right, *_words(rights)[::-1], key])
    shared = _common(rights[order], right[order])
    same_gram = np.append(False, key[order][1:] == key[order][:-1]) & (shared >= GRAM)
    cuts = np.append(np.flatnonzero(~same_gram), len(order))
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if end - start < 2:
            continue
        rows, extra = order[start:end], (shared[start:end] - GRAM).tolist()
        by_left = np.lexsort([left[rows], *_words(lefts[rows])[::-1]])
        prefix = _common(lefts[rows][by_left], left[rows][by_left]).tolist()
        rank = np.empty(len(rows), np.int64)
        rank[by_left] = np.arange(len(rows))
        for depth, _, first, last in intervals(extra):
            child = {int(rank[first]): 0}
            for i in range(first + 1, last + 1):
                child[int(rank[i])] = child[int(rank[i - 1])] + (extra[i] == depth)
            ranks = sorted(child)
            common = [-1] + [min(prefix[a + 1 : b + 1]) for a, b in zip(ranks, ranks[1:])]
            for extent, _, lo, hi in intervals(common):
                held = ranks[lo : hi + 1]
                if extent + GRAM + depth >= least and len({child[r] for r in held}) > 1:
                    yield extent, GRAM + depth, [int(rows[by_left[r]]) for r in held]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence of every maximal repeat around the grams of a task; a repeat is named by its bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def work(key, did, rn, pos, size_of, around) -> pa.RecordBatch:
        left, right = size_of // 256, size_of % 256
        names, lengths, own, starts = [], [], [], []
        for before, after, rows in maximal_repeats(key, left, right, around):
            name = hashlib.blake2b(around[rows[0], LEFT - before : LEFT + after].tobytes(), digest_size=16).hexdigest()
            for r in rows:
                names.append(name)
                lengths.append(before + after)
                own.append(r)
                starts.append(int(pos[r]) - before)
        own = np.array(own, np.int64)
        columns = [pa.array(names, pa.string()), pa.array(lengths, pa.int32()), pa.array(did[own]), pa.array(rn[own]), pa.array(starts, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["repeat", "length", "did", "rn", "start"])

    for batch in batches:
        if not batch.num_rows:
            continue
        data, _ = _flat(batch.column(6))
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4, 5)]
        held.append((columns[0], columns[1], columns[2], columns[3].astype(np.int64), columns[4].astype(np.int64), data.reshape(-1, AROUND)))
        size += batch.num_rows
        if size >= FLUSH_AROUND:
            whole = [np.concatenate([h[k] for h in held]) for k in range(6)]
            cut = np.flatnonzero(whole[0] != whole[0][-1])
            if len(cut):
                yield work(*[x[: cut[-1] + 1] for x in whole])
                whole = [x[cut[-1] + 1 :] for x in whole]
            held, size = [tuple(whole)], len(whole[0])
    if size:
        yield work(*[np.concatenate([h[k] for h in held]) for k in range(6)])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges from sorted surroundings, gram after gram; strings of hot grams that did not repeat here go on by content."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def work(key, did, rn, pos, size_of, hot, around) -> Iterator[pa.RecordBatch]:
        left, right = size_of // 256, size_of % 256
        order = np.lexsort((pos, rn, did))
        time = np.empty(len(order), np.int64)
        time[order] = np.arange(len(order))
        row, start, end = settle(key, time, pos, left, right, around)
        yield _ranges(did[row], rn[row], start, end)
        warm = np.flatnonzero(hot)
        if len(warm):
            done = np.zeros((len(key), LEFT + 1), bool)  # by row and bytes left of the anchor
            for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
                done[r, max(0, pos[r] - (e - LENGTH)) : pos[r] - s + 1] = True
            own, reach, strings = [], [], []
            for r in warm.tolist():
                for shift in range(max(0, LENGTH - int(right[r])), int(left[r]) + 1):
                    if not done[r, shift]:
                        own.append(r)
                        reach.append(shift)
                        strings.append(hashlib.blake2b(around[r, LEFT - shift : AROUND - shift].tobytes(), digest_size=16).digest())
            own = np.array(own, np.int64)
            short = np.array([int.from_bytes(s[:8], "little", signed=True) for s in strings], np.int64)
            begin = pos[own] - np.array(reach, np.int64)
            yield _batch(1, short, did[own], rn[own], begin, begin + LENGTH, pa.array(strings, pa.binary()))

    for batch in batches:
        kind = batch.column(0).to_numpy()
        ready = batch.filter(pa.array(kind == 0))
        if ready.num_rows:
            yield pa.RecordBatch.from_arrays([ready.column(k) for k in (0, 1, 2, 3, 4, 5, 7)], ["kind", "key", "did", "rn", "a", "b", "around"])
        batch = batch.filter(pa.array(kind == 1))
        if not batch.num_rows:
            continue
        data, _ = _flat(batch.column(7))
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4, 5, 6)]
        held.append((columns[0], columns[1], columns[2], columns[3].astype(np.int64), columns[4].astype(np.int64), columns[5].astype(bool), data.reshape(-1, AROUND)))
        size += batch.num_rows
        if size >= FLUSH_AROUND:
            whole = [np.concatenate([h[k] for h in held]) for k in range(7)]
            cut = np.flatnonzero(whole[0] != whole[0][-1])
            if len(cut):  # the last gram may go on in the next batch
                yield from work(*[x[: cut[-1] + 1] for x in whole])
                whole = [x[cut[-1] + 1 :] for x in whole]
            held, size = [tuple(whole)], len(whole[0])
    if size:
        yield from work(*[np.concatenate([h[k] for h in held]) for k in range(7)])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets


def _by_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges as they come; strings of hot grams sorted by content and place: all places of each but the first are removed. Several grams
    may report the same place."""
    content, first = None, None
    for batch in batches:
        kind = batch.column(0).to_numpy()
        ready = batch.filter(pa.array(kind == 0))
        if ready.num_rows:
            yield pa.RecordBatch.from_arrays([ready.column(k) for k in (2, 3, 4, 5)], ["did", "rn", "a", "b"])
        strings = batch.filter(pa.array(kind == 1))
        if strings.num_rows:
            again = []
            for string, *place in zip(*[strings.column(k).to_pylist() for k in (6, 2, 3, 4)]):
                if string != content:
                    content, first = string, place
                again.append(place != first)
            removed = strings.filter(pa.array(again))
            yield pa.RecordBatch.from_arrays([removed.column(k) for k in (2, 3, 4, 5)], ["did", "rn", "a", "b"])


# The operator ----------------------------------------------------------------------------------------------------------------------------------


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its removed runs."""
    runs: list[list[int]] = []
    for start, end in sorted(ranges):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept), [(s, e) for s, e in runs]


def _around(docs: DataFrame, id_col: str, text_col: str, settle_copies: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents under their own keys, the surroundings of repeated grams, and the hot grams."""
    spark = docs.sparkSession
    small_batches(spark)
    # All readers of the texts ask for the same columns, so the texts are shuffled once.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("did").orderBy("text")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.withColumn("rn", F.row_number().over(own))
    reports = base.select("did", "rn", "text").mapInArrow(_reports(2 * parts), "slot long, blob binary")
    answers = reports.repartition("slot").select("blob").mapInArrow(_answers, "hot boolean, did long, place long")
    # At most one hot gram for HOT anchors, so this side is under a millionth of the text.
    hot = answers.filter("hot").select(F.col("did").alias("key"), F.lit(True).alias("hot")).distinct()
    places = answers.filter("not hot").groupBy("did").agg(F.collect_list("place").alias("places"))
    found = base.join(places, "did").select("did", "rn", "text", "places")
    return base, found.mapInArrow(lambda b: _surroundings(b, settle_copies), AROUND_SCHEMA), hot


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(repeat, length, id, start)``: every occurrence of every maximal repeat of at least ``LENGTH`` bytes.

    A repeat is seen through the anchors in it, so one that reaches beyond their surroundings appears as several that overlap; it is named by
    its bytes. Grams with over ``HOT`` occurrences are compared in ``SALT`` parts.
    """
    _, around, hot = _around(docs, id_col, text_col, settle_copies=False)
    marked = around.filter("kind = 1").join(F.broadcast(hot), "key", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("did"), F.lit(SALT))).otherwise(F.lit(0))
    dealt = marked.withColumn("slot", F.xxhash64("key", salt)).repartition("slot").sortWithinPartitions("key", "slot")
    found = dealt.select("kind", "key", "did", "rn", "a", "b", "around").mapInArrow(_groups, "repeat string, length int, did long, rn int, start int")
    return found.distinct().select("repeat", "length", F.nullif(F.col("did"), F.lit(NO_ID)).alias("id"), "start")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kept, n_bytes, spans)`` for every document: the remaining bytes and the removed runs (start, end)."""
    base, around, hot = _around(docs, id_col, text_col, settle_copies=True)
    marked = around.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)) & (F.col("kind") == 1))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("did"), F.lit(SALT))).otherwise(F.lit(0))
    dealt = marked.withColumn("slot", F.xxhash64("key", salt)).repartition("slot").sortWithinPartitions("kind", "key", "slot")
    trees = dealt.select("kind", "key", "did", "rn", "a", "b", "hot", "around").mapInArrow(_trees, AROUND_SCHEMA)
    ordered = trees.repartition("key").sortWithinPartitions("kind", "around", "did", "rn", "a")
    ranges = ordered.mapInArrow(_by_content, "did long, rn int, a int, b int").groupBy("did").agg(F.collect_list(F.struct("rn", "a", "b")).alias("ranges"))
    found = base.join(ranges, "did", "left").select("did", "rn", "text", "ranges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = batch.to_pylist()
            cut = []
            for r in rows:
                text = r["text"].encode("utf-8", "surrogatepass")
                cut.append((len(text), *_cut(text, [(x["a"], x["b"]) for x in r["ranges"] or () if x["rn"] == r["rn"]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if r["did"] == NO_ID else r["did"] for r in rows], pa.int64()), pa.array([k for _, k, _ in cut], pa.binary()), pa.array([n for n, _, _ in cut], pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in runs] for _, _, runs in cut], span)], ["id", "kept", "n_bytes", "spans"],
            )

    return found.mapInArrow(finish, "id long, kept binary, n_bytes long, spans array<struct<start:int,end:int>>")
