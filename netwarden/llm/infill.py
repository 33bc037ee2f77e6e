"""Fill-in-middle: documents cut at unit boundaries into prefix, middle and suffix, and written in the order a model learns to fill.

A unit is a run of white space and the word after it, or white space at the end of the text; white space is blank, tab, line feed, vertical tab,
form feed and carriage return. A text is UTF-8 in blocks of ``BLOCK`` bytes. A Fenwick tree over the blocks holds how many units end and how many
code points begin in each; binary lifting walks it down to the block in which the unit before a cut ends, together with the sums of all blocks
before it, and only that block is searched for the place. Cuts, form and middle depend on the id and the number of units alone: the first four
8-digit groups of sha256 of the seed, ``:`` and the id, so a repeated run writes the same.

A text stays plain, that is itself, if it is empty, holds one of the markers, or is not among the share that is transformed. Null texts are empty; an
id that is null is hashed as no digits; repeated rows are transformed alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import map_batches

# Markers before each piece.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100 documents, how many are transformed, and of 100 of these, how many with the suffix first.
SHARE, SUFFIX_FIRST = 50, 80
BLOCK = 1024
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def hashes(doc_id: Column, seed: int = SEED) -> Column:
    """Array of four unsigned 32-bit numbers for an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


class Blocks:
    """A text as bytes, with a Fenwick tree over its blocks that holds unit ends and code points."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.block = block
        self.raw = np.frombuffer(text, np.uint8)
        space = SPACE[self.raw]
        # A unit ends at the last byte of a word, and at the last byte of the text.
        self.ends = ~space
        self.ends[:-1] &= space[1:]
        self.ends[-1:] = True
        self.begins = (self.raw & 0xC0) != 0x80  # first bytes of code points
        starts = np.arange(0, len(self.raw), block)
        counts = np.stack([np.add.reduceat(x, starts, dtype=np.int64) for x in (self.ends, self.begins)], axis=1)
        self.n, self.chars = counts.sum(axis=0).tolist()
        # Node k (from 1) sums the blocks k - (k & -k) + 1 to k.
        below = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])
        k = np.arange(1, len(counts) + 1)
        self.tree = (below[k] - below[k - (k & -k)]).tolist()

    def boundary(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the boundary that ``units`` units precede."""
        if units <= 0:
            return 0, 0
        at, left, chars = 0, units, 0
        step = 1 << (len(self.tree).bit_length() - 1)
        while step:
            if at + step <= len(self.tree) and self.tree[at + step - 1][0] < left:
                at += step
                left -= self.tree[at - 1][0]
                chars += self.tree[at - 1][1]
            step >>= 1
        start = at * self.block
        local = int(np.flatnonzero(self.ends[start : start + self.block])[left - 1]) + 1
        # Later bytes of the last code point hold no first byte, and a unit ends with its last byte.
        return start + local, chars + int(np.count_nonzero(self.begins[start : start + local]))


def transform(text: bytes, h: list[int]) -> tuple[int, str, int | None, int | None, bytes]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    if not text:
        return 0, "plain", None, None, text
    blocks = Blocks(text)
    if h[2] % 100 >= SHARE or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return blocks.n, "plain", None, None, text
    low, high = sorted((h[0] % (blocks.n + 1), h[1] % (blocks.n + 1)))
    (a, a_chars), (b, b_chars) = blocks.boundary(low), blocks.boundary(high)
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    suffix_first = h[3] % 100 < SUFFIX_FIRST
    output = suffix + prefix + middle if suffix_first else prefix + suffix + middle
    return blocks.n, "spm" if suffix_first else "psm", a_chars, b_chars - a_chars, output


def rebuild(output: bytes, form: str) -> bytes:
    """The text that an output was made from; transformed texts hold no marker of their own."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    second = output.index(order[1], len(order[0]))
    third = output.index(order[2], second + len(order[1]))
    one, two, middle = output[len(order[0]) : second], output[second + len(order[1]) : third], output[third + len(order[2]) :]
    return one + middle + two if form == "psm" else two + middle + one


def texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row; ``output`` is the text to learn from."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), hashes(F.col(id_col), seed).alias("h"))

    def run(batch: pa.RecordBatch) -> dict:
        made = [transform(t, h) for t, h in zip(texts(batch.column("text")), batch.column("h").to_pylist())]
        n, form, prefix, middle, output = zip(*made)
        return {
            "id": batch.column("id"), "n": pa.array(n, pa.int64()), "form": list(form), "prefix_chars": pa.array(prefix, pa.int64()),
            "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string()),
        }

    return map_batches(own, run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(filled: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``filled`` with the text that each output was made from, as ``restored``; a column of that name is replaced."""

    @F.pandas_udf("string")
    def back(output, form):
        return output.str.encode("utf-8").combine(form, rebuild).str.decode("utf-8")

    return filled.withColumn("restored", back(F.col(output_col), F.col(form_col)))
