"""The n-gram join against brute force, and its edge cases."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bazaarlens.llm import near
from bazaarlens.llm.components import components
from conftest import DATA


def grams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(rows):
    """Class and links by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(range(len(rows)), 0)
    for (a, (i, s)), (b, (j, t)) in itertools.combinations(enumerate(rows), 2):
        same = s == t or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        if same:
            links[a] += 1
            links[b] += 1
            p, q = sorted((root(i), root(j)))
            parent[q] = p
    return sorted((i, root(i), links[k]) for k, (i, _) in enumerate(rows))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows, passage = [], " ".join(word() for _ in range(60))
    for k in range(40):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        rows.append(" ".join(base) + (" " + passage if k % 3 == 0 else ""))
        for _ in range(rng.choice([0, 0, 1, 6, 20])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 25])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", "", "!!", "One two", "one TWO!", "x " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)  # so that components are split in blocks
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(5)
    got = sorted(tuple(r) for r in near.near_duplicates(df).collect())
    assert got == expected(rows)


def test_whole_table_by_brute_force(spark):
    """All pairs of sf0.01 that share a five-word run, or the text, compared on their full sets."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r) for r in near.near_duplicates(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect()}
    sets, holders = {i: grams(t or "") for i, t in rows}, {}
    for i, t in rows:
        for gram in sets[i] or {t}:
            holders.setdefault(gram, []).append(i)
    shared = Counter(pair for held in holders.values() for pair in itertools.combinations(sorted(held), 2))
    text, links, least = dict(rows), Counter(), {i: i for i, _ in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for (a, b), both in shared.items():
        if text[a] == text[b] or both >= 0.8 * len(sets[a] | sets[b]):
            links.update((a, b))
            p, q = sorted((root(a), root(b)))
            least[q] = p
    assert got == {i: (i, root(i), links[i]) for i, _ in rows} and sum(links.values()) > 100


def test_edges(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (None, None), (7, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = sorted(map(tuple, near.near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(5, 3, 2), (3, 3, 2), (3, 3, 2), (None, None, 0), (9, 9, 0), (None, None, 0), (7, 7, 1), (8, 7, 1)], key=str
    )
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(
        [(3, text), (None, text), (9, None), (None, None), (7, "")], key=str
    )
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_bands():
    bands, rows = near.choose_bands(0.8, 0.9999)
    assert bands * rows <= near.SIGNATURE and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_ngrams_and_intersections():
    texts = ["a b c d e f", "", "a b", "A  b, c d e F"]
    codes, offsets = near.ngrams(pa.array(texts, pa.large_utf8()))
    assert offsets.tolist() == [0, 2, 2, 3, 5] and codes[:2].tolist() == codes[3:].tolist()
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    both = near.shared_grams(sets[:4], sets[4:], width=7)
    assert both.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (30, 3), (8, 9), *((i, i + 1) for i in range(100, 140))]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (30, 1), (8, 8), (9, 8), *((i, 100) for i in range(100, 141))}
