"""Secret scan: three patterns, and a battery of randomness tests for tokens that no pattern names.

A token of 20 or more base64 characters is read in the narrowest encoding that has all its characters. Three tests judge it: chi-squared
uniformity over that alphabet, the number of runs above and below the middle of the alphabet, and the correlation of neighbours. Ordinary words
and names are far from uniform, more so the longer they are; the chance that an ordinary token of this length looks as uniform is its p-value,
and tokens whose runs or correlation rule out chance are left out. Within each class of length and encoding the share of false findings is held
below ``FALSE_SHARE`` by the Benjamini-Hochberg rule over a grid of p-values, counted over all documents.

Offsets are code points, the end exclusive. A null text is an empty text and has no finding; repeated rows are scanned alike; an empty table
gives an empty result; other columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netwarden.llm.frames import let

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: ``[A-Z0-9]+`` of at least 12 more characters, and ``[0-9a-f]+`` of at least 32: the same matches as finding all and dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])"
FALSE_SHARE, REJECT_Z = 0.01, 3.3
#: Steps of the grid of p-values for one power of ten, and its last step.
STEPS, LAST = 4, 80

# Alphabets by encoding, narrowest first, and the share of a repeated character in ordinary tokens over them.
ALPHABETS = {
    "hex": ("0123456789abcdef", 0.15),
    "HEX": ("0123456789ABCDEF", 0.15),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 0.065),
    "base62": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.06),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.06),
}
SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order, with offsets: lengths of matches and of the gaps between them, summed up."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def spans(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: F.struct(F.length(F.get(x["g"], i)).alias("gap"), F.length(m).alias("n"), F.get(x["v"], i).alias("value")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, s: Column) -> Column:
            here = F.struct((a["pos"] + s["gap"]).alias("start"), (a["pos"] + s["gap"] + s["n"]).alias("end"), s["value"].alias("value"))
            return F.struct((a["pos"] + s["gap"] + s["n"]).alias("pos"), F.concat(a["out"], F.array(here)).alias("out"))

        return F.aggregate(steps, start, step, lambda a: a["out"])

    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(SPAN))


def _normal(z: Column) -> Column:
    """Distribution function of the normal law, in logistic form."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def battery(token: Column) -> Column:
    """Struct of the class and p-value of a token, null where it is a number, or its order is not that of chance."""

    def tests(name: str, alphabet: str, repeat: float) -> Column:
        k = len(alphabet)
        excess = k * repeat - 1

        def over(x: Column) -> Column:
            n, v = F.size(x).cast("double"), x
            value = F.array_distinct(v)
            chi = F.aggregate(value, F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(v, lambda y: y == c)).cast("double"), F.lit(2.0))) * k / n - n
            sd = F.sqrt(2.0 * (k - 1) + 4 * n * excess)
            z_text = (chi - (k - 1) - (n - 1) * excess) / sd
            high = F.size(F.filter(v, lambda y: y >= k // 2)).cast("double")
            runs = 1 + F.size(F.filter(F.transform(v, lambda y, i: (i > 0) & ((y >= k // 2) != (F.get(v, i - 1) >= k // 2))), lambda y: y)).cast("double")
            mu = 2 * high * (n - high) / n + 1
            z_runs = (runs - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
            mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n

            def correlation(m: Column) -> Column:
                """Sum of products of neighbours over the sum of squares, around the mean ``m``, in one pass each."""
                square = F.aggregate(v, F.lit(0.0), lambda a, y: a + F.pow(y - m, F.lit(2.0)))
                products = F.transform(v, lambda y, i: F.when(i > 0, (y - m) * (F.get(v, i - 1) - m)).otherwise(0.0))
                return F.aggregate(products, F.lit(0.0), lambda a, y: a + y) / F.greatest(square, F.lit(1e-9))

            z_serial = let(mean, correlation) * F.sqrt(n)
            by_chance = (F.abs(z_runs) < REJECT_Z) & (F.abs(z_serial) < REJECT_Z)
            size = F.when(n < 28, "20").when(n < 40, "28").when(n < 56, "40").when(n < 80, "56").otherwise("80")
            return F.when(by_chance, F.struct(F.concat(F.lit(name + "-"), size).alias("stratum"), _normal(z_text).alias("p")))

        values = F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
        return let(values, over)

    plain = F.regexp_replace(token, "=+$", "")
    case = F.when(plain.rlike(r"^[0-9]+$|^[A-Za-z]+$"), F.lit(None))
    for name, (alphabet, repeat) in ALPHABETS.items():
        kind = "".join(("\\" + c if c in "+/-_" else c) for c in alphabet)
        case = case.when(plain.rlike(f"^[{kind}]+$"), tests(name, alphabet, repeat))
    return case


def candidates(text: Column) -> Column:
    """Tokens with their offsets and tests."""
    tested = F.transform(located(F.coalesce(text, F.lit("")), TOKEN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["value"]).alias("t")))
    return F.filter(tested, lambda x: x["t"].isNotNull())


def _step(p: Column) -> Column:
    return F.least(F.lit(LAST), F.greatest(F.lit(0), F.floor(-STEPS * F.log10(F.greatest(p, F.lit(1e-300)))))).cast("int")


def thresholds(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """For each class the first step of the grid at which the expected share of ordinary tokens is small enough; at most one row a class."""
    tokens = docs.select(F.explode(candidates(F.col(text_col))).alias("c")).select("c.t.*")
    counts = tokens.groupBy("stratum", _step(F.col("p")).alias("step")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("stratum").orderBy(F.desc("step"))
    every = Window.partitionBy("stratum")
    found = counts.select("stratum", "step", F.sum("n").over(best).alias("found"), F.sum("n").over(every).alias("m"))
    steady = found.filter(F.col("m") * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE_SHARE * F.col("found"))
    return {r[0]: r[1] for r in steady.groupBy("stratum").agg(F.min("step")).collect()}


def spans(text: Column, limits: dict[str, int]) -> Column:
    """All findings of a text by start, then kind: array of (start, kind, end), the kind as a position in ``KINDS``."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 8)

    def of(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = F.concat(of(assign, 0), of(located(text, ACCESS), 1), of(located(text, HEX), 2))
    if not limits:
        return F.array_sort(base)
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])

    def with_random(known: Column) -> Column:
        fits = F.filter(candidates(text), lambda c: _step(c["t"]["p"]) >= F.coalesce(limit[c["t"]["stratum"]], F.lit(LAST + 1)))
        free = F.filter(of(fits, 3), lambda c: ~F.exists(known, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])))
        return F.array_sort(F.concat(known, free))

    return let(base, with_random)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` for every document."""
    limits = thresholds(docs, text_col)
    return docs.select(F.col(id_col).alias("id"), spans(F.col(text_col), limits).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with each stretch of findings replaced by ``[SECRET]``."""

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["pos"]
        out = F.when(apart, F.concat(a["out"], text.substr(a["pos"] + 1, s["start"] - a["pos"]), F.lit("[SECRET]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    rest = F.aggregate(found, start, step, lambda a: F.concat(a["out"], text.substr(a["pos"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, rest).otherwise(text)


def without_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked in the text, and the length column, where there is one, made to fit."""
    own = "__secret_spans"
    found = docs.withColumn(own, spans(F.col(text_col), thresholds(docs, text_col)))
    changed = F.size(own) > 0
    out = found.withColumn(text_col, masked(F.col(text_col), F.col(own)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


