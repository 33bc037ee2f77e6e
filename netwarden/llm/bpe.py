"""Byte-level BPE as a monoid: halves are encoded on their own and joined at the seam, up a balanced tree.

A sequence of tokens is the encoding of its bytes exactly when each two neighbours, encoded together, come back unchanged. So
only the seam of two encoded halves can be wrong: a window of the last and first tokens is encoded anew and grows until both pairs on
its border come back unchanged; the tokens outside are then final. Decoding concatenates up the same tree.
The pattern's matches are encoded separately. A text may be cut before a space that follows a character other than white space without changing
any match, which makes words the unit that is looked up in a bounded memo.

A null text is an empty text and has no tokens; copies and ties are encoded row by row; an empty table gives an empty result; columns
other than the id and the text are ignored. A text of any length is encoded whole: the tree keeps the work per byte
independent of a match's length.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.llm.frames import map_batches, small_batches

#: Bytes of a leaf of the encoding tree; tokens of a leaf of the decoding tree.
LEAF_BYTES, LEAF_TOKENS = 24, 4096
#: Below it, letters are the same in every version of Unicode.
LATIN_END = "\u0250"
#: Stands for a pair that is no token.
NO_RANK = 1 << 62
#: Entries of each memo of a worker; a full memo is emptied.
MEMO = 400_000
#: A vocabulary is sent to every worker, so its size is checked.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The lines of a rank file: base64 of the token, a space, its rank."""
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    return raw


class Codec:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        pairs = (line.split() for line in raw.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        # \s of the pattern means the White_Space property.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.by_piece: dict[str, bytes] = {}
        self.by_chunk: dict[str, bytes] = {}
        self.steady: dict[tuple[int, int], bool] = {}
        self.loose = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S)(?= )").split

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a short byte string: merge the pair of lowest rank, the first one of ties, until none is left."""
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        known = [get(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while known:
            least = min(known)
            if least == NO_RANK:
                break
            at = known.index(least)
            merged = parts[at] = parts[at] + parts.pop(at + 1)
            del known[at]
            if at:
                known[at - 1] = get(parts[at - 1] + merged, NO_RANK)
            if at < len(known):
                known[at] = get(merged + parts[at + 1], NO_RANK)
        return [self.ranks[p] for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether two neighbours come back unchanged when they are encoded together."""
        known = self.steady.get((a, b))
        if known is None:
            if len(self.steady) >= MEMO:
                self.steady.clear()
            known = self.steady[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenation of two encoded byte strings."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            width *= 2
            head, tail = left[:-width], right[width:]
            data = b"".join(map(self.bytes_of.__getitem__, left[-width:] + right[:width]))
            window = self.merge(data) if len(data) <= 4 * LEAF_BYTES else self.merge_long(data)
            if (not head or self.stays(head[-1], window[0])) and (not tail or self.stays(window[-1], tail[0])):
                return head + window + tail

    def merge_long(self, data: bytes) -> list[int]:
        """Like ``merge``, with the candidate pairs in a heap, for windows that have grown wide."""
        ranks, n = self.ranks, len(data)
        ends = list(range(1, n + 1))  # of the part that begins here; 0 once it has joined its predecessor
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two parts has changed since
            ends[at], ends[middle] = end, 0
            if end < n:
                before[end] = at
                if (rank := ranks.get(data[at : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, at, ends[end]))
            if (left := before[at]) >= 0 and (rank := ranks.get(data[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        return [ranks[data[i:e]] for i, e in enumerate(ends) if e]

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def piece(self, piece: str) -> bytes:
        """Packed ids of one match of the pattern."""
        packed = self.by_piece.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.encode_bytes(data)
            packed = pack(ids)
            if len(data) <= 64:
                if len(self.by_piece) >= MEMO:
                    self.by_piece.clear()
                self.by_piece[piece] = packed
        return packed

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a text between two cuts."""
        if chunk[1:].isalpha() and max(chunk) < LATIN_END and (chunk[0] == " " or chunk[0].isalpha()):
            return self.piece(chunk)  # one match: letters, or a space and letters
        if chunk[1:-1].isalpha() and chunk[0] == " " and chunk[-1] in ".,;:!?" and max(chunk) < LATIN_END:
            return self.piece(chunk[:-1]) + self.piece(chunk[-1])
        packed = b"".join(map(self.piece, self.pieces(chunk)))
        if len(chunk) <= 64:
            if len(self.by_chunk) >= MEMO // 4:
                self.by_chunk.clear()
            self.by_chunk[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.loose(text):
            chunks: Iterable[str] = self.cut(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + w for w in rest]]
        word, other, chunk = self.by_piece.get, self.by_chunk.get, self.chunk
        return b"".join([p if (p := word(c)) is not None or (p := other(c)) is not None else chunk(c) for c in chunks])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        n = len(packed) // 4
        if n <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I").tolist()))
        half = 4 * (n // 2)
        return self.decode(packed[:half]) + self.decode(packed[half:])


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the packed ids of every text."""
    raw = shared(docs.sparkSession, path)
    codecs: list[Codec] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not codecs:
            codecs.append(Codec(raw.value, pattern))
        return {"id": batch.column(0), "ids": pa.array([codecs[0].encode(t) for t in batch.column(1).to_pylist()], pa.binary())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(id, ids, bytes)``: the decoded bytes beside packed ids."""
    raw = shared(encoded.sparkSession, path)
    codecs: list[Codec] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not codecs:
            codecs.append(Codec(raw.value, pattern))
        ids = batch.column(1)
        return {"id": batch.column(0), "ids": ids, "bytes": pa.array([codecs[0].decode(x or b"") for x in ids.to_pylist()], pa.binary())}

    kind = encoded.schema["id"].dataType.simpleString()
    return map_batches(encoded.select("id", "ids"), run, f"id {kind}, ids binary, bytes binary")


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", ok_col: str = "decodes") -> DataFrame:
    """``docs`` with the packed ids of each text, and whether decoding them gives the text's bytes again; columns of these names are replaced."""
    raw = shared(docs.sparkSession, path)
    small_batches(docs.sparkSession)
    codecs: list[Codec] = []

    @F.pandas_udf("ids binary, decodes boolean")
    def coded(texts: pd.Series) -> pd.DataFrame:
        if not codecs:
            codecs.append(Codec(raw.value, pattern))
        ids = [codecs[0].encode(t) for t in texts]
        same = [codecs[0].decode(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)]
        return pd.DataFrame({"ids": ids, "decodes": same})

    own = "__bpe_coded"
    out = docs.withColumn(own, coded(F.col(text_col)))
    return out.select(*[c for c in docs.columns if c not in (ids_col, ok_col)], F.col(own)["ids"].alias(ids_col), F.col(own)["decodes"].alias(ok_col))


def shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))
