"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import collocations
from bazaarlens.llm.collocations import mine


def plainly(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {p for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = set()
    for lang, p in found:
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * f[lang, p] >= 100 * f[lang, p[i : i + size]]:
                    covered.add((lang, p[i : i + size]))
    out = {}
    for lang, p in found - covered:
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * f[lang, p] * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -f[lang, p], " ".join(p).encode(), f[lang, p], l, r, n[lang], score))
    return {
        (lang, k, x[2].decode(), *x[3:]) for lang, rows in out.items() for k, x in enumerate(sorted(rows)[:top], 1)
    }


def _mined(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string")
    return {tuple(r) for r in mine(df, least, **more).collect()}


def _corpus():
    rng = random.Random(7)
    words = ["a", "b", "C", "d", "É", "x y", "\x00", "漢字", "e", "F"]
    rows = []
    for _ in range(300):
        parts = [rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\r\n", "\x0b", ":;"]) for _ in range(rng.randint(0, 40))]
        rows.append(("".join(parts), rng.choice(["en", "de", None, "und", ""])))
    rows += [("one two three four five six", "en")] * 9 + [("one two three", "en"), (None, "en"), ("", None), (" . ", "de"), ("a " * 400, "fr")]
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.mark.parametrize("least", [2, 5, 30])
def test_as_plain_counting(spark, corpus, least):
    assert _mined(spark, corpus, least) == plainly(corpus, least)


def test_top(spark, corpus):
    assert _mined(spark, corpus, 3, top=7) == plainly(corpus, 3, 7)


def test_table_of_slots_changes_nothing(spark, corpus, monkeypatch):
    """One slot keeps every window, many slots cut nearly all of the rare ones."""
    for bits in ((3, 3), (18, 18)):
        monkeypatch.setattr(collocations, "SLOT_BITS", bits)
        assert _mined(spark, corpus, 5) == plainly(corpus, 5)


def test_words_that_share_a_code(spark, corpus, monkeypatch):
    """With a seed under which words share codes, the next seed is taken."""
    real = collocations.word_table
    tried = []

    def clashing(docs, seed):
        tried.append(seed)
        found = real(docs, seed)
        return found.selectExpr("code % 2 as code", "lang", "word", "n") if seed == 1 else found

    monkeypatch.setattr(collocations, "word_table", clashing)
    assert _mined(spark, corpus, 5) == plainly(corpus, 5)
    assert tried == [1, 3]


def test_counts_of_a_task_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_ROWS", 50)
    assert _mined(spark, corpus, 5) == plainly(corpus, 5)


def test_empty_table_and_other_columns(spark):
    assert spark.createDataFrame([], "text string, lang string").transform(mine).count() == 0
    rows = [(k, "p q", "en", 1.0, "z") for k in range(120)]
    df = spark.createDataFrame(rows, "code long, text string, lang string, n double, word string")
    assert [tuple(r) for r in mine(df).collect()] == [("en", 1, "p q", 120, 120, 120, 240, 2000)]


def test_counts_past_64_bits(spark):
    """1000 * a * n and l * r beyond a long."""
    one = spark.createDataFrame([(11, "en", "p", 4 * 10**12), (12, "en", "q", 5 * 10**12)], "code long, lang string, word string, n long")
    counts = spark.createDataFrame(
        [(2, 11, 12, 0, 0, 0, 3 * 10**12), (1, 11, 0, 0, 0, 0, 4 * 10**12), (1, 12, 0, 0, 0, 0, 5 * 10**12)],
        "size int, w1 long, w2 long, w3 long, w4 long, w5 long, f long",
    )
    totals = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    row = collocations._scored(counts, one, totals).first()
    assert row["score"] == 1000 * 3 * 10**12 * 9 * 10**13 // (4 * 10**12 * 5 * 10**12)


def test_packed_counts():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.01, 0.9):
        counts = rng.integers(1, 400, 65_536) * (rng.random(65_536) < share)
        total = np.zeros(65_536, np.int64)
        collocations._unpack_into(total, collocations._packed(counts))
        assert (total == np.minimum(counts, 255)).all()
