"""Text normalization, obfuscation checks and redaction as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netwarden.constants import BASE64_RUN, CARD_DIGITS, HEX_RUN, HIDDEN_WORDS, LEET_FROM, LEET_TO, PERCENT_CODE, SAFE_ARGUMENT, SENSITIVE, SENSITIVE_HINTS

_WORD = r"\p{L}\p{N}_"
_EDGE = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
REDACTED = "[REDACTED]"
NON_ASCII = r"[^\x00-\x7F]"
# Both run patterns consist of these characters; nothing else needs stripping and decoding.
_RUN = r"^[\s\p{Z}]*[A-Za-z0-9+/]{16,}={0,2}[\s\p{Z}]*$"


def unicode_regex(pattern: str) -> str:
    """Give ``\\b \\w \\d \\s`` their Unicode meaning, whatever the JVM's defaults are."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out.append(_EDGE)
        elif two == r"\w":
            out.append(_WORD if inside else f"[{_WORD}]")
        elif two == r"\d":
            out.append(r"\p{Nd}")
        elif two == r"\s":
            out.append(r"\s\p{Z}" if inside else r"[\s\p{Z}]")
        elif two == r"\S":
            out.append(r"[^\s\p{Z}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = True if two[0] == "[" else False if two[0] == "]" else inside
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    # No built-in does NFKC; ASCII text is already in that form.
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def _nfkc_json(rows: pd.Series) -> pd.Series:
    # Nested rows go as JSON texts: the Arrow writer measures a batch anew for every row, which takes a list column the square of the batch.
    form = lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s)
    return rows.map(lambda row: None if row is None else json.dumps([None if cell is None else [form(s) for s in cell] for cell in json.loads(row)]))


def canonicalize_nested(texts: Column) -> Column:
    """``canonicalize`` for every text of an array<array<string>>."""
    foreign = F.array_join(F.flatten(texts), "").rlike(NON_ASCII)
    formed = F.from_json(_nfkc_json(F.when(foreign, F.to_json(texts))), "array<array<string>>")
    clean = F.transform(formed, lambda cell: F.transform(cell, strip_format_characters))
    return F.when(foreign, clean).otherwise(texts)


def strip_format_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cf}", "")


def canonicalize(text: Column) -> Column:
    """NFKC, then drop zero-width and other format characters.

    Pure ASCII text has neither, so it never leaves the JVM with content.
    """
    foreign = text.rlike(NON_ASCII)
    return F.when(foreign, strip_format_characters(_nfkc(F.when(foreign, text)))).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _undone_hint() -> str:
    """A pattern that is found in every text that undoing could make hold a risky word, and in all texts that are not ASCII."""
    stands_for = lambda c: "[" + re.escape(c + "".join(a for a, b in zip(LEET_FROM, LEET_TO) if b == c)) + "]"
    return "|".join([NON_ASCII, *["(?i:" + "".join(map(stands_for, word)) + ")" for word in HIDDEN_WORDS]])


def hidden_word(text: Column) -> Column:
    """First risky word that appears only after undoing digit/symbol substitutions, else null."""
    plain = F.lower(text)
    decoded = F.translate(plain, LEET_FROM, LEET_TO)

    pattern = F.lit(rf"(?<![{_WORD}])({'|'.join(HIDDEN_WORDS)})(?![{_WORD}])")
    in_order = F.array(*[F.lit(w) for w in HIDDEN_WORDS])

    def first_hit(pair: Column) -> Column:
        shown, undone = pair["plain"], pair["decoded"]
        hits = F.array_except(F.regexp_extract_all(undone, pattern, F.lit(1)), F.regexp_extract_all(shown, pattern, F.lit(1)))
        # One cheap alternation rules out almost every text before the bounded search runs.
        return F.when((undone != shown) & undone.rlike("|".join(HIDDEN_WORDS)), F.get(F.array_intersect(in_order, hits), 0))

    # Lowering and undoing cost far more than one look at the text as it is.
    return F.when(text.rlike(_undone_hint()), let(F.struct(plain.alias("plain"), decoded.alias("decoded")), first_hit))


def obfuscation(text: Column) -> Column:
    """Why a text looks obfuscated, checked in fixed order; null when it does not."""
    return F.coalesce(
        F.when(text.rlike(_RUN), let(strip(text), _encoded_run)),
        F.when(text.rlike(PERCENT_CODE), F.lit("contains URL-percent-encoding")),
        F.concat(F.lit("looks leetspeak-obfuscated (decodes to contain '"), hidden_word(text), F.lit("')")),
    )


def _encoded_run(body: Column) -> Column:
    decodes = body.rlike(BASE64_RUN) & (F.length(body) % 4 == 0)
    preview = F.substring(F.make_valid_utf8(F.unbase64(F.when(decodes, body)).cast("string")), 1, 60)
    shown = F.concat(F.lit("looks base64-encoded (decodes to: '"), F.coalesce(preview, F.lit("?")), F.lit("')"))
    return F.when(decodes, shown).when(body.rlike(HEX_RUN), "looks hex-encoded")


def _may_match(text: Column, label: str) -> Column:
    """Cheap necessary condition, so most texts never reach the costly pattern."""
    if label in SENSITIVE_HINTS:
        return F.contains(F.lower(text), F.lit(SENSITIVE_HINTS[label]))
    return text.rlike(CARD_DIGITS)


def sensitive_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sensitive-looking span: (key, label, match)."""

    def spans(label: str, pattern: str) -> Column:
        matches = F.when(
            _may_match(F.col(text), label), F.regexp_extract_all(F.col(text), F.lit(unicode_regex(pattern)), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        return F.transform(matches, lambda m: F.struct(F.lit(label).alias("label"), m.alias("match")))

    found = [spans(label, pattern) for label, pattern in SENSITIVE.items()]
    return df.select(key, F.inline(F.concat(*found)))


def redact(text: Column) -> Column:
    def step(value: Column, label: str) -> Column:
        cleaned = lambda v: F.when(
            _may_match(v, label), F.regexp_replace(v, unicode_regex(SENSITIVE[label]), REDACTED)
        ).otherwise(v)
        return let(value, cleaned)

    def gated(value: Column) -> Column:
        clean = value
        for label in SENSITIVE:
            clean = step(clean, label)
        # A text that could match nothing, which most are, goes through no step.
        return F.when(reduce(Column.__or__, [_may_match(value, label) for label in SENSITIVE]), clean).otherwise(value)

    return let(text, gated)


def sanitize_decision(df: DataFrame) -> DataFrame:
    """Redact the rationale and every reason of every stage result."""
    stages = F.transform(
        "stage_results",
        lambda s: F.struct(
            s["stage"].alias("stage"), s["accepted"].alias("accepted"), F.transform(s["reasons"], redact).alias("reasons")
        ),
    )
    return df.withColumn("rationale", redact(F.col("rationale"))).withColumn("stage_results", stages)


def sanitize_payload(payload: Column) -> Column:
    """Redact the text member of a map<string, struct<s string, d double, b boolean>>."""
    return F.transform_values(
        payload, lambda _, v: F.struct(redact(v["s"]).alias("s"), v["d"].alias("d"), v["b"].alias("b"))
    )


def is_safe_argument(text: Column) -> Column:
    return F.trim(text).rlike(SAFE_ARGUMENT)


def let(value: Column, body) -> Column:
    """Bind a column once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{_WORD}]{{2,}})"), F.lit(1))
