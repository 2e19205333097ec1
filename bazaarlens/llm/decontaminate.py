"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of the
template are hash-joined, and the values behind the placeholders must match one to one.

Only DataFrame expressions. A benchmark item leaks into a text where windows on
diagonals with consistent slots cover at least ``min_share`` of the item's windows.
A diagonal is a fixed distance between places in text and item; its slots are
consistent if equal item values stand for equal text values and the other way round,
so a question with other numbers or names is caught, and a chance likeness is not.

Defined results: null or empty texts and items leak nothing; items with fewer than
``MIN_WORDS`` template words, or no window with ``MIN_LITERALS`` plain words, are too
short to be told and take no part; repeated items and rows count once; a null doc_id
is a document like any other. Columns other than the ones used are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import small_enough
from bazaarlens.session import cut_lineage

WINDOW = 8
MIN_WORDS = 8
MIN_LITERALS = 4
MIN_SHARE = 0.5
# Up to so many rows the window table goes to every task; beyond, the join shuffles.
BROADCAST_ROWS = 500_000

KINDS = ("name", "number", "unit")
# Sign before a kind, so that no word of a text looks like a placeholder (control characters are separators there).
SIGN = "\u0001"
# A name: capitalised words after a lower-case letter, digit or comma and one space, so not at a sentence start.
# Repeated groups are possessive: nothing follows that could need a shorter match, and Java matches them in a loop,
# where other ones take a stack frame for each word of a long list of names or numbers.
NAME = r"([\p{Ll}0-9,] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+)"
NUMBER = r"([0-9]+(?:[.,:/][0-9]+)*+)"
# Units of measure and money.
UNITS = (
    "mm", "cm", "km", "kg", "mg", "ml", "kw", "mph", "kmh", "gb", "mb", "ms", "meters", "metres", "miles", "feet",
    "inches", "yards", "grams", "pounds", "ounces", "liters", "litres", "gallons", "seconds", "minutes", "hours",
    "days", "weeks", "months", "years", "dollars", "cents", "euros", "percent", "degrees",
)
UNIT = rf"({SIGN}number +)({'|'.join(UNITS)})\b"
WORD_BREAK = rf"[^\p{{L}}\p{{N}}{SIGN}]+"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is evaluated once; inside a lambda it would be evaluated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(SIGN), F.lit(" "))


def _named(text: Column) -> Column:
    return F.regexp_replace(_plain(text), NAME, rf"$1{SIGN}name ")


def _numbered(text: Column) -> Column:
    return F.lower(F.regexp_replace(_named(text), NUMBER, f" {SIGN}number "))


def template_words(text: Column) -> Column:
    """Lower-case words of ``text`` with placeholders ``\\u0001name``, ``\\u0001number`` and ``\\u0001unit``."""
    marked = F.regexp_replace(_numbered(text), UNIT, f"$1{SIGN}unit ")
    return F.array_remove(F.split(marked, WORD_BREAK), "")


def slot_values(text: Column) -> Column:
    """Map from kind to the values behind its placeholders, in order."""
    return F.create_map(
        F.lit("name"), F.regexp_extract_all(_plain(text), F.lit(NAME), 2),
        F.lit("number"), F.regexp_extract_all(_named(text), F.lit(NUMBER), 1),
        F.lit("unit"), F.regexp_extract_all(_numbered(text), F.lit(UNIT), 2),
    )


def slots(words: Column, text: Column) -> Column:
    """Array of (at, kind, value): each placeholder of ``words`` with the value that it stands for."""

    def of(kind: str, values: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i) == f"{SIGN}{kind}")
        return _once(
            F.element_at(values, kind),
            lambda own: F.transform(
                places,
                lambda at, i: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.get(own, i).alias("value")),
            ),
        )

    return _once(slot_values(text), lambda values: F.concat(*[of(kind, values) for kind in KINDS]))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all runs of ``WINDOW`` words, in order."""

    def hashes(own: Column) -> Column:
        last = F.size(own) - WINDOW
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(own, i + 1, WINDOW)))).otherwise(
            F.array().cast("array<bigint>")
        )

    return _once(words, hashes)


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~F.startswith(w, F.lit(SIGN))))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, item_at, hash, item_windows, item_slots) of each window that has enough plain words."""
    words = items.select("item_id", "text").distinct().select("item_id", "text", template_words(F.col("text")).alias("words"))
    words = words.where(F.size("words") >= MIN_WORDS).select(
        "item_id", "words", slots(F.col("words"), F.col("text")).alias("item_slots")
    )
    kept = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - WINDOW),
            lambda i: F.struct(i.alias("item_at"), F.slice("words", i + 1, WINDOW).alias("run")),
        ),
        lambda w: _literals(w["run"]) >= MIN_LITERALS,
    )
    windows = words.select("item_id", "item_slots", kept.alias("windows"))
    return windows.select(
        "item_id", F.size("windows").alias("item_windows"), "item_slots", F.explode("windows").alias("w")
    ).select(
        "item_id",
        "item_windows",
        F.col("w")["item_at"].alias("item_at"),
        F.xxhash64(F.col("w")["run"]).alias("hash"),
        # The slots inside the window only.
        F.filter("item_slots", lambda s: (s["at"] >= F.col("w")["item_at"]) & (s["at"] < F.col("w")["item_at"] + WINDOW)).alias("item_slots"),
    )


def find_leaks(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, covered_windows, item_windows, n_slots, same_slots) of every leak.

    n_slots counts the slots of covered windows; same_slots tells whether all of them hold the item's own values.
    """
    windows = cut_lineage(benchmark_windows(items))
    index = windows.select("item_id", "item_at", "hash", "item_windows", (F.size("item_slots") > 0).alias("slotted"))
    if small_enough(index, BROADCAST_ROWS):
        index = F.broadcast(index)
    key = F.xxhash64("text")
    found = docs.select("doc_id", key.alias("text_key"), F.posexplode(window_hashes(template_words(F.col("text")))).alias("at", "hash"))
    hits = cut_lineage(
        found.join(index, "hash")
        .select("doc_id", "text_key", "item_id", "item_windows", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "slotted")
        .distinct()
    )
    slotted = _consistent(docs, hits.where("slotted"), windows)
    pair = ["doc_id", "text_key", "item_id"]
    judged = _joined(hits, slotted, [*pair, "diagonal"], "left").select(
        *pair,
        "item_windows",
        "item_at",
        F.coalesce("consistent", F.lit(True)).alias("consistent"),
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce("same", F.lit(True)).alias("same"),
    )
    covered = (
        judged.where("consistent")
        .groupBy(*pair, "item_windows", "item_at")
        .agg(F.max("n_slots").alias("n_slots"), F.min("same").alias("same"))
        .groupBy(*pair, "item_windows")
        .agg(F.count(F.lit(1)).alias("covered_windows"), F.max("n_slots").alias("n_slots"), F.min("same").alias("same_slots"))
        .where(F.col("covered_windows") >= min_share * F.col("item_windows"))
    )
    return (
        covered.groupBy("doc_id", "item_id", "item_windows")
        .agg(F.max("covered_windows").alias("covered_windows"), F.max("n_slots").alias("n_slots"), F.min("same_slots").alias("same_slots"))
        .select("doc_id", "item_id", "covered_windows", F.col("item_windows").cast("long"), F.col("n_slots").cast("long"), "same_slots")
    )


def _joined(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join on ``columns`` where nulls are equal; the right side's copies of them go."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, on, how).drop(*[f"_{c}" for c in columns])


def _consistent(docs: DataFrame, hits: DataFrame, windows: DataFrame) -> DataFrame:
    """For each (doc_id, text_key, item_id, diagonal) with slots: whether they match one to one."""
    wanted = hits.select("doc_id", "text_key").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    if small_enough(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    texts = _joined(texts, wanted, ["doc_id", "text_key"], "left_semi").distinct()
    text_slots = (
        texts.select("doc_id", "text_key", "text", template_words(F.col("text")).alias("words"))
        .select("doc_id", "text_key", F.explode(slots(F.col("words"), F.col("text"))).alias("s"))
        .select("doc_id", "text_key", F.col("s")["at"].alias("at"), F.col("s")["kind"].alias("kind"), F.col("s")["value"].alias("text_value"))
    )
    item_slots = windows.select("item_id", "item_at", F.explode("item_slots").alias("s"))
    expected = (
        hits.join(item_slots, ["item_id", "item_at"])
        .select("doc_id", "text_key", "item_id", "diagonal", (F.col("s")["at"] + F.col("diagonal")).alias("at"), F.col("s")["kind"].alias("kind"), F.col("s")["value"].alias("item_value"))
        .distinct()
    )
    pairs = _joined(expected, text_slots, ["doc_id", "text_key", "at", "kind"], "inner")
    group = ["doc_id", "text_key", "item_id", "diagonal"]
    # A value pair once, then how many partners each value has: distinct pairs must be as many as distinct values.
    distinct = pairs.groupBy(*group, "kind", "item_value", "text_value").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(*group).agg(
        (
            (F.count(F.lit(1)) == F.count_distinct("kind", "item_value")) & (F.count(F.lit(1)) == F.count_distinct("kind", "text_value"))
        ).alias("consistent"),
        F.sum("n").alias("n_slots"),
        F.min(F.col("item_value") == F.col("text_value")).alias("same"),
    )


def remove_leaks(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    leaked = find_leaks(docs, items, min_share).select(F.col("doc_id").alias("leaked_id")).distinct()
    if small_enough(leaked, BROADCAST_ROWS):
        leaked = F.broadcast(leaked)
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]), "left_anti")
