"""Personal data: four patterns, and a semi-Markov conditional random field for what they miss.

The field looks at stretches of a text that hold a digit, an at sign or an address spelled out. A stretch is cut into tokens (runs of letters, runs of
digits, single other characters). Every segment of at most ``LONGEST`` tokens is scored as a whole for each type: by its shape, its number of digits,
the check digit, the size of its numbers, its ends and the words before it. Dynamic programming over the last segment's length and type finds
the best division into segments and single outside tokens, so boundaries and types are chosen together. Weights are learned by maximum likelihood:
the forward-backward sums of the same recursion give the expected features.

Training takes at most ``max_rows`` texts in which a pattern matches; the matches are the marks, and written variants of them (an address spelled
out, a number without its plus sign) teach the field forms that no pattern has. A stretch is cut at the matches of patterns, and what lies
between them is divided by itself. A segment is added if its score against lying outside exceeds ``MARGIN``.

Offsets are code points, the end exclusive. A null text is an empty text and has no span; repeated rows are searched alike; an empty table gives an
empty result; without matches to learn from nothing is added; other columns are ignored. Whole texts are searched; of a long stretch, such as a table of
numbers, one segment to each of its tokens is held. A stretch of five characters or fewer holds none of the kinds but what the patterns find.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import map_batches

KINDS = ["email", "ip", "card", "phone"]
LONGEST = 24
MARGIN = 2.0
EPOCHS, RATE, DECAY = 20, 0.5, 1e-5
#: Tokens of a stretch that is learned from, at most.
TRAIN_TOKENS = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A stretch: an address, written or spelled out, or digits with what may stand between them; up to four words before it give context.
_STRETCH = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]+"
    r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]+)+"
    r"|[+(]?[0-9](?:[\x20().+/-]{0,2}[0-9])*"
)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_MARKED = re.compile(r"\S*[0-9@+()]\S*")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the four patterns as (kind, start, end), by kind and start."""
    out = []
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            out.append((0, start, low))
        at = text.find("@", max(at + 1, low))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    if "@" in text or " at " in text or _DIGIT.search(text) or "at)" in text.lower() or "at]" in text.lower():
        return [m.span() for m in _STRETCH.finditer(text) if m.end() - m.start() > 5]
    return []


def _shape(segment: str) -> str:
    out: list[str] = []
    for c in segment:
        k = "d" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Lattice:
    """Tokens of a stretch, and the features of its segments."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [(m.start() + start, m.end() + start) for m in _TOKEN.finditer(text[start:end])]
        before = _WORD.findall(text[max(0, start - 40) : start].lower())[-3:]
        self.context = ["before=" + w[:6] for w in before if len(w) > 2]
        self.text, self.start, self.end = text, start, end

    def features(self, i: int, j: int) -> list[str]:
        """Features of the segment of tokens i to j - 1, for whatever type."""
        s, e = self.tokens[i][0], self.tokens[j - 1][1]
        segment = self.text[s:e]
        digits = _digits(segment)
        parts = re.findall(r"[0-9]+", segment)
        shape = _shape(segment)
        groups = "-".join(str(min(len(p), 5)) for p in parts[:6])
        lower = segment.lower()
        out = [
            "any", f"shape={shape[:16]}", f"digits={min(len(digits), 20)}", f"groups={groups}", f"first={shape[0]}", f"last={shape[-1]}",
            f"left={_shape(self.text[max(0, s - 1) : s])}", f"right={_shape(self.text[e : e + 1])}",
            f"left+={_shape(self.text[max(0, s - 8) : s].rstrip()[-1:])}", f"right+={_shape(self.text[e : e + 8].lstrip()[:1])}",
        ]
        if len(digits) >= 13:
            out.append(f"luhn={luhn(digits)}")
        if len(parts) == 4 and segment.count(".") == 3:
            out.append(f"octets={all(int(p) <= 255 for p in parts if len(p) < 10) and max(map(len, parts)) <= 3}")
        if "@" in segment or " at " in lower or "(at)" in lower or "[at]" in lower:
            out.append("at")
            if "." in segment.rpartition("@")[2] or " dot " in lower or "(dot)" in lower or "[dot]" in lower:
                out.append("domain")
        if segment[0] == "+":
            out.append("plus")
        return out + self.context

    def starts(self, j: int):
        """First tokens of the segments that token j - 1 may end."""
        last = self.text[self.tokens[j - 1][1] - 1]
        for i in range(max(0, j - LONGEST), j):
            first = self.text[self.tokens[i][0]]
            if (first.isalnum() or first in "+(") and last.isalnum() and j - i > 1 or j - i == 1 and self.tokens[i][1] - self.tokens[i][0] > 5:
                yield i

    def segments(self):
        for j in range(1, len(self.tokens) + 1):
            for i in self.starts(j):
                yield i, j


Weights = dict[tuple[int, str], float]


def _scored(lattice: Lattice, weights: Weights) -> dict[int, list[tuple[int, int, float, list[str]]]]:
    """Segments by end: (start, kind, score, features)."""
    by_end: dict[int, list] = defaultdict(list)
    for i, j in lattice.segments():
        names = lattice.features(i, j)
        for kind in range(len(KINDS)):
            by_end[j].append((i, kind, sum(weights.get((kind, n), 0.0) for n in names), names))
    return by_end


def decode(lattice: Lattice, weights: Weights) -> list[tuple[int, int, int]]:
    """The best segments of a stretch whose score exceeds the margin, as (kind, start, end); of the segments only the best one to each end is held."""
    n = len(lattice.tokens)
    best = [0.0] * (n + 1)
    back: list[tuple[int, int, float] | None] = [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i in lattice.starts(j):
            names = lattice.features(i, j)
            for kind in range(len(KINDS)):
                score = sum(weights.get((kind, name), 0.0) for name in names)
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind, score)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind, score = back[j]
            if score > MARGIN:
                out.append((kind, lattice.tokens[i][0], lattice.tokens[j - 1][1]))
            j = i
    return out[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.sum(np.exp(np.array(values) - top))))


def _gradient(lattice: Lattice, gold: set[tuple[int, int, int]], weights: Weights) -> dict[tuple[int, str], float]:
    """Observed less expected features of the marked division of a stretch."""
    n = len(lattice.tokens)
    by_end = _scored(lattice, weights)
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_add([alpha[j - 1], *(alpha[i] + s for i, _, s, _ in by_end.get(j, ()))])
    beta = [0.0] * (n + 1)
    by_start: dict[int, list] = defaultdict(list)
    for j, own in by_end.items():
        for i, _, s, _ in own:
            by_start[i].append((j, s))
    for i in range(n - 1, -1, -1):
        beta[i] = _log_add([beta[i + 1], *(s + beta[j] for j, s in by_start.get(i, ()))])
    out: dict[tuple[int, str], float] = defaultdict(float)
    for j, own in by_end.items():
        for i, kind, s, names in own:
            p = float(np.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n])))
            marked = (kind, lattice.tokens[i][0], lattice.tokens[j - 1][1]) in gold
            if p > 1e-4 or marked:
                for name in names:
                    out[kind, name] += marked - p
    return out


def _variants(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The neighbourhood of each match as it is, in a form no pattern has, and with the digits of an ordinary number instead."""
    out = []
    for kind, start, end in spans:
        own = text[start:end]
        # What else stands there may be marked or cut off, so it goes.
        before, after = (_MARKED.sub("", x) for x in (text[max(0, start - 30) : start], text[end : end + 20]))
        forms = [own]
        if kind == 0:
            name, _, host = own.partition("@")
            forms.append(name + rng.choice([" at ", " (at) ", "[at]"]) + host.replace(".", rng.choice([".", " dot ", " (dot) "])))
        elif kind == 2:
            digits = _digits(own)
            forms.append(rng.choice([".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4)))
        elif kind == 3:
            forms += [own.lstrip("+"), own.lstrip("+0123456789").strip() or own]
        for form in forms:
            if kind == 0 and re.search(r"[0-9]", before[-1:] + after[:1]):
                continue
            out.append((before + form + after, [(kind, len(before), len(before) + len(form))]))
        plain = rng.choice([str(rng.randrange(10**6, 10**12)), f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 99)}.{rng.randrange(99)}.{rng.randrange(99)}",
                            f"{rng.randrange(10**6)} {rng.randrange(10**6)}", f"{rng.randrange(999)},{rng.randrange(100, 999)}", f"{rng.randrange(300, 999)}.{rng.randrange(300, 999)}.{rng.randrange(999)}.{rng.randrange(999)}", " ".join(str(rng.randrange(1000)) for _ in range(rng.randrange(2, 7)))])
        out.append((before + plain + after, []))
    return out


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 11) -> Weights:
    """Weights from marked neighbourhoods; stretches of over ``TRAIN_TOKENS`` tokens, mostly tables, teach nothing."""
    rng = random.Random(seed)
    weights: Weights = {}
    squares: dict[tuple[int, str], float] = defaultdict(float)
    lattices = []
    for text, spans in samples:
        for start, end in stretches(text):
            lattice = Lattice(text, start, end)
            if len(lattice.tokens) <= TRAIN_TOKENS:
                lattices.append((lattice, {s for s in spans if start <= s[1] and s[2] <= end}))
    for _ in range(EPOCHS):
        rng.shuffle(lattices)
        for lattice, gold in lattices:
            for key, g in _gradient(lattice, gold, weights).items():
                squares[key] += g * g
                weights[key] = weights.get(key, 0.0) * (1 - DECAY) + RATE * g / (1e-3 + squares[key]) ** 0.5
    return {k: w for k, w in weights.items() if abs(w) > 1e-3}


def fit(docs: DataFrame, max_rows: int = 300, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights learned from at most ``max_rows`` neighbourhoods of matches, those with the smallest hash of their characters."""

    def cut(batch: pa.RecordBatch) -> dict:
        texts, kinds, starts, ends = [], [], [], []
        for text in batch.column(0).to_pylist():
            for kind, s, e in base_spans(text or ""):
                low = max(0, s - 30)
                texts.append(text[low : e + 20])
                kinds.append(kind)
                starts.append(s - low)
                ends.append(e - low)
        return {"text": pa.array(texts, pa.string()), "kind": pa.array(kinds, pa.int32()), "s": pa.array(starts, pa.int32()), "e": pa.array(ends, pa.int32())}

    found = map_batches(docs.select(text_col), cut, "text string, kind int, s int, e int")
    rows = found.distinct().select("*", F.xxhash64("text", "kind").alias("h")).orderBy("h", "text", "s").limit(max_rows).collect()
    rng = random.Random(5)
    return train([x for r in rows for x in _variants(r.text, [(r.kind, r.s, r.e)], rng)])


def between(text: str, start: int, end: int, weights: Weights) -> list[tuple[int, int, int]]:
    """What the field finds in the part of a stretch that lies before, between or behind matches of the patterns."""
    out = []
    for s, e in stretches(text[start:end]) if start < end else []:
        out += decode(Lattice(text, start + s, start + e), weights)
    return out


def spans_of(text: str | None, weights: Weights) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Matches of the patterns, and all spans with those that the field adds; by kind, then start."""
    text = text or ""
    base = base_spans(text)
    added = []
    if weights:
        import bisect

        taken: list[list[int]] = []  # matches that overlap, put together
        for start, end in sorted((s, e) for _, s, e in base):
            if taken and start < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], end)
            else:
                taken.append([start, end])
        ends = [e for _, e in taken]
        blank = text  # as in training, no match stands beside what is searched
        if taken:
            blank = "".join(text[low:s] + " " * (e - s) for low, (s, e) in zip([0, *ends], taken)) + text[ends[-1] :]
        for start, end in stretches(text):
            low = start
            for s, e in taken[bisect.bisect_right(ends, start) :]:
                if s >= end:
                    break
                added += between(blank, low, s, weights)
                low = e
            added += decode(Lattice(text, start, end), weights) if low == start else between(blank, low, end, weights)
    return base, sorted(base + added)


def search(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)``: arrays of (kind, start, end), the kind as a position in ``KINDS``."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> dict:
        found = [spans_of(t, weights) for t in batch.column(1).to_pylist()]
        pack = lambda k: pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in f[k]] for f in found], span)
        return {"id": batch.column(0), "base": pack(0), "spans": pack(1)}

    kind = docs.schema[id_col].dataType.simpleString()
    made = "array<struct<kind:int,start:int,end:int>>"
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, base {made}, spans {made}")
