"""Chat formatting with loss masks that align with token offsets.

Each turn stands between two markers of its role. The markers are single tokens, so the text around them is never merged with them and a conversation
may be encoded in blocks of whole turns with the same ids as in one go; a block ends after ``BLOCK_CHARS`` characters. A block is rendered, encoded once
with offsets, and the sorted spans of its assistant texts are laid over the sorted token spans by binary search. Marker strings inside a text are
escaped by a backslash and undone when the format is read back.

Turns are dealt out by ranges of conversation and turn, so a conversation of any length is spread over many tasks. Turns of equal number are ordered by
role and text; a null text is an empty text, a null role an empty name; rows without a conversation form one under null; roles other than the
three known ones are named in the format; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import small_batches

# Markers around the text of a turn.
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER, OTHER_TEXT, OTHER_END = "[ROLE] ", " [TEXT] ", " [/ROLE]"
CONTROLS = [m for pair in MARKERS.values() for m in pair] + [OTHER, OTHER_TEXT, OTHER_END]
BLOCK_CHARS = 20_000
MAX_VOCABULARY_BYTES = 64 << 20

_FIRST = {"<": "l", "[": "b", " ": "s", "\\": "\\"}
_BACK = {v: k for k, v in _FIRST.items()}
_CONTROL = re.compile("\\\\|" + "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\([lbs\\])")
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKERS.items())
    + f"|{re.escape(OTHER)}(?P<name>.*?){re.escape(OTHER_TEXT)}(?P<other>.*?){re.escape(OTHER_END)}", re.S,
)


def escape(text: str) -> str:
    """``text`` without any marker in it."""
    return _CONTROL.sub(lambda m: "\\" + _FIRST[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the spans of the assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role in MARKERS:
            before, after = MARKERS[role]
        else:
            before, after = OTHER + escape(role) + OTHER_TEXT, OTHER_END
        out += [before, body, after]
        start = at + len(before)
        at = start + len(body) + len(after)
        if role == "assistant":
            spans.append((start, start + len(body)))
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted block."""
    turns = []
    for m in _TURN.finditer(formatted):
        if m["other"] is not None:
            turns.append((unescape(m["name"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens (start, end) that lie in one of the spans; both are sorted."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= ends[at]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> str:
    """The characters under the mask, each once."""
    own = offsets[loss]
    if not len(own):
        return ""
    reach = np.maximum.accumulate(own[:, 1])
    first = np.append(True, own[1:, 0] > reach[:-1])
    last = np.append(first[1:], True)
    return "".join([formatted[a:b] for a, b in zip(own[first, 0].tolist(), reach[last].tolist())])


def tokenizer_from(raw: str):
    from tokenizers import AddedToken, Tokenizer, processors

    made = Tokenizer.from_str(raw)
    made.post_processor = processors.ByteLevel(trim_offsets=False)
    made.add_special_tokens([AddedToken(m, normalized=False, single_word=False, lstrip=False, rstrip=False) for m in CONTROLS])
    return made


def format_conversations(turns: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per block of a conversation: ``conv_id, part, block, formatted, ids, offsets, loss``; blocks in the order of (part, block)."""
    with open(path, encoding="utf-8") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} characters")
    raw = turns.sparkSession.sparkContext.broadcast(content)
    small_batches(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, part int, block int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_from(raw.value)
        part = TaskContext.get().partitionId()
        pending: list[tuple[str, str]] = []
        current, size, block = None, 0, 0
        types = None

        def flush() -> pa.RecordBatch:
            formatted, spans = render(pending)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, np.int32).reshape(-1, 2)
            loss = mask(offsets, spans)
            lists = [pa.array([x], pa.list_(t)) for x, t in ((np.array(encoded.ids, np.int32), pa.int32()), (offsets[:, 0], pa.int32()), (offsets[:, 1], pa.int32()), (loss, pa.bool_()))]
            columns = [pa.array([current], types), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([formatted], pa.string()), *lists]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "block", "formatted", "ids", "starts", "ends", "loss"])

        for batch in batches:
            types = batch.schema.field(0).type
            for conv_id, who, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if pending and (conv_id != current or size >= BLOCK_CHARS):
                    yield flush()
                    pending, size, block = [], 0, block + 1
                current = conv_id
                pending.append((who, said))
                size += len(said)
        if pending:
            yield flush()

    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the format of every conversation says when it is read back, block after block."""
    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, types = None, None
        n_turns = loss_chars = chars = n_tokens = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        seen = False

        def row() -> pa.RecordBatch:
            values = [n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, int(n_tokens)]
            return pa.RecordBatch.from_arrays(
                [pa.array([current], types), *[pa.array([v]) for v in values]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
            )

        for batch in batches:
            types = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = [batch.column(k) for k in (2, 3, 4)]
            cuts = np.asarray(lists[0].offsets)
            starts, ends, losses = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            for k, (conv_id, formatted) in enumerate(zip(ids, texts)):
                if seen and conv_id != current:
                    yield row()
                    n_turns = loss_chars = chars = n_tokens = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                current, seen = conv_id, True
                for role, text in read_back(formatted):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n_turns += 1
                part = slice(cuts[k], cuts[k + 1])
                text = unescape(masked_text(formatted, np.stack([starts[part], ends[part]], axis=1), losses[part]))
                loss.update(text.encode("utf-8", "surrogatepass"))
                loss_chars += len(text)
                chars += len(formatted)
                n_tokens += cuts[k + 1] - cuts[k]
        if seen:
            yield row()

    columns = ["conv_id", "formatted", "starts", "ends", "loss"]
    ordered = formatted.select(*columns, "part", "block").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.select(*columns).mapInArrow(run, schema)
