"""Benchmark decontamination by templates: re-parameterised questions match what they were made from.

Numbers, names and units of a text become typed placeholders that keep their value; a template is the token sequence with the values
left out. Windows of ``WINDOW`` template tokens of benchmark and documents meet in a hash join. Windows of a document and an item on
one diagonal (same distance between their positions) must fill the item's slots consistently: one value of the item always becomes the same value of
the document, and no two become one. A document holds an item when windows on consistent diagonals make up at least ``COVERAGE`` of the
item's windows.

Items under ``WINDOW`` tokens are one window of their own length; those under ``WHOLE`` tokens match documents that have no further token, or, from
``SHORTEST`` tokens on and with a slot, documents that hold them with the same values. A window of which less than half are words is matched with its values; an item counts as held by half
of its windows, or by half of those that are matched without values. On a diagonal that is not consistent only windows without a changed value count. Numbers of any
length and texts that are all numbers are tokens like others. Null or empty texts have no tokens and match nothing; repeated rows
of one id give one row; an item that occurs twice in the benchmark counts under both ids; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import let

WINDOW, WHOLE, SHORTEST, COVERAGE = 8, 5, 3, 0.5
#: Benchmark windows that are broadcast at most (about 30 bytes each); more of them meet the documents in a shuffle.
MAX_BROADCAST_ROWS = 1_000_000

# Units of measure and money that take a slot after a number.
UNITS = (
    "km m cm mm mi mile miles ft feet inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent "
    "dollar dollars euro euros cent cents usd eur gbp"
).split()
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
SLOTS = f"[{NAME}-{UNIT}]"


def tokens(text: Column) -> Column:
    """Lower-case words, and slots as a placeholder followed by its value."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), SLOTS, " ")
    numbers = F.regexp_replace(clean, r"\p{Nd}++(?:[.,]\p{Nd}++)*+", f" {NUMBER}$0 ")
    units = F.regexp_replace(numbers, rf"(?<={NUMBER}[\p{{Nd}}.,]{{1,24}} \s{{0,4}})(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", f" {UNIT}$0 ")
    with_units = F.when(numbers.contains(NUMBER), units).otherwise(numbers)
    names = F.regexp_replace(with_units, r"\p{Lu}(?<=[\p{Ll},;]\s{1,4}\p{Lu})[\p{L}\p{M}]*", f" {NAME}$0 ")
    return F.regexp_extract_all(F.lower(names), F.lit(rf"{SLOTS}[^\s{NAME}-{UNIT}]*|[\p{{L}}\p{{M}}]+"), F.lit(0))


def _is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(NAME, NUMBER, UNIT)


def _template(token: Column) -> Column:
    return F.when(_is_slot(token), F.substring(token, 1, 1)).otherwise(token)


def windows(text: Column, lengths: list[int]) -> Column:
    """Array of (position, hash of the template, whether that has the values too, slot values) for every window of the given lengths."""

    def of_length(w: Column, template: Column, slotted: Column, length: int) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(none)

        def plain(i: Column) -> Column:
            return F.xxhash64(F.lit(length), *[F.get(template, i + k) for k in range(length)])

        def slots(i: Column) -> Column:
            return F.filter(F.slice(w, i + 1, length), _is_slot)

        def placed(at: Column) -> Column:
            return F.transform(at, lambda i: F.struct(i.alias("pos"), slots(i).alias("slots")))

        def window(x: Column, heavy: Column) -> Column:
            # What is mostly slots says too little without its values; a name there is a word like any other.
            verbatim = F.xxhash64(F.lit(-length), *[F.ltrim(F.get(w, x["pos"] + k), F.lit(NAME)) for k in range(length)])
            return F.struct(x["pos"].alias("pos"), F.when(heavy, verbatim).otherwise(plain(x["pos"])).alias("h"), heavy.alias("heavy"), F.when(~heavy, x["slots"]).alias("slots"))

        def free(i: Column) -> Column:
            return F.struct(i.alias("pos"), plain(i).alias("h"), F.lit(False).alias("heavy"), F.lit(None).cast("array<string>").alias("slots"))

        if length >= WHOLE:
            with_slots = F.transform(placed(starts), lambda x: window(x, 2 * F.size(x["slots"]) > length))
            return F.when(slotted, with_slots).otherwise(F.transform(starts, free))
        # Few plain words stand in any text: they count only where they are all of it, and with a value wherever it stands beside the same words.
        whole = F.transform(placed(F.when(F.size(w) == length, F.array(F.lit(0))).otherwise(none)), lambda x: window(x, F.lit(False)))
        if length < SHORTEST:
            return whole
        valued = F.transform(F.filter(placed(F.when(slotted, starts).otherwise(none)), lambda x: F.size(x["slots"]) > 0), lambda x: window(x, F.lit(True)))
        return F.concat(whole, valued)

    def over(pair: Column) -> Column:
        return F.flatten(F.array(*[of_length(pair["w"], pair["t"], pair["s"], n) for n in lengths]))

    def with_template(w: Column) -> Column:
        slotted = F.exists(w, _is_slot)
        return let(slotted, lambda s: let(F.struct(w.alias("w"), F.when(s, F.transform(w, _template)).otherwise(w).alias("t"), s.alias("s")), over))

    return let(tokens(text), with_template)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """``(item_id, at, h, own, n_windows)`` for every window of the items, and the window lengths among them."""
    sized = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"), F.size(tokens(F.col(text_col))).alias("n")).filter("n > 0")
    sized = sized.withColumn("length", F.least("n", F.lit(WINDOW)))
    lengths = sorted(r[0] for r in sized.select("length").distinct().collect())  # at most WINDOW values
    parts = [sized.filter(F.col("length") == n).select("item_id", F.explode(windows(F.col("text"), [n])).alias("w")) for n in lengths]
    if not parts:
        return sized.selectExpr("item_id", "0 at", "0L h", "false heavy", "cast(null as array<string>) own", "1L n_windows", "1L n_light"), [WINDOW]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.select("item_id", F.col("w.pos").alias("at"), F.col("w.h").alias("h"), F.col("w.heavy").alias("heavy"), F.col("w.slots").alias("own")).distinct()
    counts = out.groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"), F.countDistinct(F.when(~F.col("heavy"), F.col("at"))).alias("n_light"))
    return out.join(counts, out["item_id"].eqNullSafe(counts["item_id"])).select(out["*"], "n_windows", "n_light"), lengths


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item_id, n_matched, n_windows, n_slots, n_changed)`` for every item that a document holds."""
    wanted, lengths = benchmark_windows(items)
    if wanted.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.select(F.col(id_col).alias("id"), F.explode(windows(F.col(text_col), lengths)).alias("w")).select("id", "w.pos", "w.h", "w.slots")
    hits = own.join(wanted, "h").filter(F.size(F.coalesce("slots", F.array())) == F.size(F.coalesce("own", F.array())))
    none = F.array().cast("array<struct<own:string,slots:string>>")
    pairs = F.coalesce(F.arrays_zip("own", "slots"), none)
    same = F.coalesce(F.col("own") == F.col("slots"), F.lit(True))
    diagonals = hits.groupBy("id", "item_id", "n_windows", "n_light", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set(F.struct("at", "heavy", same.alias("same"))).alias("at"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs")
    )
    n = F.size("pairs")
    steady = (n == F.size(F.array_distinct(F.transform("pairs", lambda p: p["own"])))) & (n == F.size(F.array_distinct(F.transform("pairs", lambda p: p["slots"]))))
    # Where one slot is filled inconsistently, what stands there unchanged still counts.
    diagonals = diagonals.withColumn("steady", steady)
    held = diagonals.withColumn("at", F.when(F.col("steady"), F.col("at")).otherwise(F.filter("at", lambda x: x["same"])))
    held = held.withColumn("pairs", F.when(F.col("steady"), F.col("pairs")).otherwise(F.filter("pairs", lambda p: p["own"] == p["slots"]))).filter(F.size("at") > 0)
    places = F.flatten(F.collect_list("at"))
    held = held.groupBy("id", "item_id", "n_windows", "n_light").agg(
        F.size(F.array_distinct(F.transform(places, lambda x: x["at"]))).cast("long").alias("n_matched"),
        F.size(F.array_distinct(F.transform(F.filter(places, lambda x: ~x["heavy"]), lambda x: x["at"]))).alias("n_light_matched"),
        F.sum(n).cast("long").alias("n_slots"),
        F.sum(F.size(F.filter("pairs", lambda p: p["own"] != p["slots"]))).cast("long").alias("n_changed"),
    )
    # A changed copy has only the windows that are matched by their template; a literal one has all.
    light = (F.col("n_light") > 0) & (F.col("n_light_matched") >= COVERAGE * F.col("n_light"))
    enough = light | (F.col("n_matched") >= COVERAGE * F.col("n_windows"))
    return held.filter(enough).select("id", "item_id", "n_matched", "n_windows", "n_slots", "n_changed")


def without_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, columns unchanged."""
    found = contaminated(docs, items, id_col, text_col).select(F.col("id").alias("__held_id")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__held_id"]), "left_anti")
