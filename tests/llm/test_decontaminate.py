"""Leaks by templates: re-parameterised items, slots that do not match, edge cases, planted items."""

import re

from pyspark.sql import functions as F

from bazaarlens.llm import decontaminate as d
from bazaarlens.llm.queries import op9_benchmark_decontamination
from conftest import DATA

ITEM = "In a small town Anna Smith buys 12 apples for 3 dollars each and gives 12 of them to her friend Bob today."
SAME = ITEM.replace("Anna Smith", "Maria Jones").replace("12", "45.5").replace("Bob", "Carl").replace("3", "7")
MIXED = ITEM.replace("gives 12 of", "gives 13 of")


def leaks(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("hash", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    return {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(docs, bench).collect()}


def test_template(spark):
    row = spark.createDataFrame([(ITEM,)], "text string").select(
        d.template_words(F.col("text")).alias("w"), d.slots(d.template_words(F.col("text")), F.col("text")).alias("s")
    ).first()
    assert [w.lstrip(d.SIGN) for w in row["w"]] == (
        "in a small town name buys number apples for number unit each and gives number of them to her friend name today".split()
    )
    assert [(s["kind"], s["value"]) for s in sorted(row["s"], key=lambda s: s["at"])] == [
        ("name", "Anna Smith"), ("number", "12"), ("number", "3"), ("unit", "dollars"), ("number", "12"), ("name", "Bob"),
    ]


def test_long_lists_of_names_and_numbers(spark):
    """Each is one match, however long: a match that takes stack for each part ends the executor."""
    texts = ["seen by " + " ".join(["Anna"] * 50_000) + " today", "seen 1" + ",12" * 50_000 + " times"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(d.template_words(F.col("text")).alias("w")).collect()
    assert [[w.lstrip(d.SIGN) for w in r["w"]] for r in rows] == [["seen", "by", "name", "today"], ["seen", "number", "times"]]


def test_slots_decide(spark):
    filler = "words without any sense that go on and on for a while. "
    rows = [(1, filler + ITEM), (2, filler * 3 + SAME + " " + filler), (3, MIXED), (4, filler * 9), (5, None), (6, ""), (None, ITEM), (1, filler + ITEM)]
    got = leaks(spark, rows, [(7, ITEM), (7, ITEM), (8, None), (9, ""), (10, "too short")])
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7]["same_slots"] and not got[2, 7]["same_slots"]
    assert leaks(spark, [], [(7, ITEM)]) == {} and leaks(spark, rows, []) == {}


def test_null_ids_and_removal(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "clean text", "b"), (None, "clean too", "c")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = d.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["source"] for r in kept.collect()} == {"b", "c"}


def test_whole_items_in_documents(spark):
    """Every document that holds most of an item's words in a row is found, by brute force over the plain words."""
    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(i, plain(t)) for i, t in zip(bench.item_id, bench.text) if len(plain(t).split()) >= d.MIN_WORDS]
    expected = {(x, i) for x, t in zip(docs.doc_id, map(plain, docs.text)) for i, item in items if item in t}
    got = {(r["doc_id"], r["item_id"]) for r in op9_benchmark_decontamination(spark, folder).collect()}
    assert expected and got == expected
