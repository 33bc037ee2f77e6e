"""Template decontamination against brute force and by cases."""

import re

from pyspark.sql import functions as F

from netwarden.llm import decontam
from netwarden.llm.frames import table

ITEM = "Tom Smith has 5 apples and Tom gives 3 km of rope, then Tom walks 5 hours to the market to sell Tom apples."
ITEMS = [(1, ITEM), (2, "one two three four five six"), (3, None), (4, "hi there"), (5, ""), (6, ITEM)]
CASES = [
    (1, "x. " + ITEM, {1, 6}),
    (2, "xx. Tom Smith has 7 apples and Tom gives 2 km of rope, then Tom walks 7 hours to the market to sell Tom apples. yy", {1, 6}),
    (3, "And now Ann Brown has 70 apples and Ann gives 2,5 miles of rope, then Ann walks 70 days to the market to sell Ann apples. end", {1, 6}),
    (4, "xx. Tom Smith has 7 apples and Tom gives 2 km of rope, then Ann walks 9 hours to the market to sell Bob apples.", set()),  # one slot, several values
    (5, "so one two three four five six seven", {2}),
    (6, "Hi there", {4}),
    (7, "well hi there", set()),
    (8, None, set()),
    (9, "", set()),
    (10, "nothing to see here " * 2000, set()),
    (11, "***" + ITEM.replace(" ", "  ") + "***", {1, 6}),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in CASES] + [(1, CASES[0][1], "y", 2)], "doc_id long, text string, item_id string, w int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_cases(spark):
    docs, items = frames(spark)
    for most in (decontam.MAX_BROADCAST_ROWS, 0):
        kept, decontam.MAX_BROADCAST_ROWS = decontam.MAX_BROADCAST_ROWS, most
        try:
            rows = decontam.contaminated(docs, items).collect()
        finally:
            decontam.MAX_BROADCAST_ROWS = kept
        assert {i: {r["item_id"] for r in rows if r["id"] == i} for i, _, _ in CASES} == {i: found for i, _, found in CASES}
        assert next(r for r in rows if r["id"] == 3 and r["item_id"] == 1)["n_changed"] > 0


def test_filter(spark):
    docs, items = frames(spark)
    docs = docs.union(spark.createDataFrame([(None, ITEM, "", 0), (None, "clean words only in this one", "", 0)], docs.schema))
    left = decontam.without_benchmark(docs.filter("doc_id is not null"), items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [4, 7, 8, 9, 10]
    assert decontam.without_benchmark(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.without_benchmark(docs, items.limit(0)).count() == docs.count()


def test_literal_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = {(r["id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    texts, passages = docs.select("doc_id", "text").collect(), items.collect()
    plain = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
    want = {(d["doc_id"], i["item_id"]) for d in texts for i in passages if plain(i["text"]) in plain(d["text"])}
    assert want and found == want


def test_no_python_in_the_plan(spark):
    docs, items = frames(spark)
    plan = decontam.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert docs.select(decontam.tokens(F.col("text"))).count() == docs.count()


def held(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame([(k + 100, t) for k, t in enumerate(items)], "item_id long, text string")
    return {(r["id"], r["item_id"]) for r in decontam.contaminated(d, i).collect()}


def test_items_made_of_numbers_and_short_items(spark):
    items = ["Compute 12 + 7 * 3 - 4 / 2", "Compute 3 plus 4", "what is it"]
    around = "some words before it and then {} and many other words behind it that say nothing"
    docs = [around.format(items[0]), around.format("Compute 12 + 7 * 3 - 4 / 9"), around.format(items[1]), around.format("Compute 3 plus 5"), around.format(items[2]), "what is it", "Compute 8 plus 9"]
    assert held(spark, docs, items) == {(0, 100), (2, 101), (5, 102), (6, 101)}


def test_one_inconsistent_slot_costs_only_its_windows(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    item = f"take 5 apples {words} then take 5 more"
    assert held(spark, [f"take 6 apples {words} then take 7 more", f"take 6 apples {words} then take 6 more"], [item]) == {(0, 100), (1, 100)}


def test_long_runs_of_numbers(spark):
    """Neither recursion nor time grows with a run of numbers."""
    docs = [",".join("1" * 5000), "0.25," * 200_000, "1 " * 100_000, "0" * 300_000, "a" * 300_000, "é" * 100_000 + "😀" * 100_000, "1,a" * 100_000]
    assert held(spark, docs, ["this item is about 7 things that no document has"]) == set()
