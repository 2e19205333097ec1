"""LM scoring: base scores by brute force, a plain scorer bit by bit, probabilities that add up, edge cases."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bazaarlens.llm import mixing as m
from bazaarlens.llm.queries import op6_lm_scoring
from bazaarlens.llm.words import lowered, split_words, texts_of
from conftest import DATA


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")) + [None]


def texts(*values):
    return pa.array(values, pa.large_utf8())


def trained(folder_texts, most=60):
    """Lexicon and both models, learned without Spark from some texts."""
    words = split_words(lowered(folder_texts))
    counts = np.bincount(words.codes, minlength=len(words.distinct))
    order = np.argsort(-counts, kind="stable")
    listed, others = order[:most], order[most:]
    heads = np.unique(m.heads_of(words.distinct.take(pa.array(others))))
    heads = heads[heads >= 0][:50]
    codes = m.Codes([len(folder_texts), int(counts[others].sum()), *counts[listed].tolist(), *[1] * len(heads)])
    lexicon = m.Lexicon(words.distinct.take(pa.array(listed)), heads, codes)
    model, spelling = m.Mixing(m.TOKEN_SLOTS, m.TOKEN_CELLS), m.Mixing(m.SPELL_SLOTS, m.SPELL_CELLS)
    m.learn_tokens(model, codes, m.tokens_of(words, lexicon))
    m.learn_spelling(spelling, words.distinct.take(pa.array(others)), counts[others])
    return lexicon, model.ready(), spelling.ready()


def corpus():
    rng = np.random.default_rng(3)
    kinds = [["the", "of", "and", "houses", "riverbank"], ["la", "de", "el", "casas", "ribera"]]
    return texts(*[" ".join(rng.choice([*kinds[i % 2], f"word{i % 7}x", f"{i % 11}"], 60)) for i in range(60)])


def one_bit(model, slots, cell, bit):
    """Probability of ``bit``, with plain numbers."""
    seen = [(float(model.counts[s][0]), float(model.counts[s][1])) for s in slots]
    x = [math.log((b + 0.4) / (a + 0.4)) for a, b in seen]
    levels = [sum(sum(pair) > v for v in m.LEVELS) for pair in seen]
    weights = model.weights[levels[-1] * 5 + levels[-2]]
    mixed = min(16, max(-16, sum(float(w) * v for w, v in zip(weights, x))))
    plain = 1 / (1 + math.exp(-mixed))
    zeros, ones = model.map[cell * m.MAP_STEPS + min(m.MAP_STEPS - 1, max(0, int((mixed + 8) * 2)))]
    one = (plain + (float(ones) + 30 * plain) / (float(zeros) + float(ones) + 30)) / 2
    return one if bit else 1 - one


def test_scores(spark):
    folder = f"{DATA}/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(t for i, text in docs.items() if not held[i] for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    rows = op6_lm_scoring(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r["doc_id"]])
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        assert r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[t] > 0 for t in own))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_words_are_priced_without_a_sort(spark, monkeypatch, capsys):
    """By a hash table while the words of a part are few, by a sort beyond; the same scores."""
    found = []
    for most, join in ((m.HASHED_WORDS, "ShuffledHashJoin"), (0, "")):
        monkeypatch.setattr(m, "HASHED_WORDS", most)
        scored = op6_lm_scoring(spark, f"{DATA}/sf0.001")
        scored.explain()
        plan = capsys.readouterr().out
        assert join in plan and (join or "ShuffledHashJoin" not in plan)
        found.append({r["doc_id"]: (r["n_known"], r["score"]) for r in scored.collect()})
    assert found[0].keys() == found[1].keys()
    assert all(a[0] == found[1][i][0] and math.isclose(a[1], found[1][i][1], rel_tol=1e-4) for i, a in found[0].items())


def test_lower_case_of_slices():
    batch = pa.record_batch({"text": pa.array(["First É One", None, "seCond × B", ""])})
    assert [lowered(texts_of(batch.slice(i, 1), "text")).to_pylist()[0] for i in range(4)] == ["first É one", "", "second × b", ""]


def test_slices_in_pieces():
    """Tokens of a slice are the same as split at once, equal ones are found by plain counting, and little memory is held."""
    lexicon, _, _ = trained(corpus())
    some = texts(*corpus().to_pylist(), "", *["the riverbank Unseen word3x " * 20_000, "la casas 5 " * 40_000] * 2, "end")
    whole = m.tokens_of(split_words(lowered(some)), lexicon)
    tracemalloc.start()
    words, tokens = m.split_pieces(some, lexicon)
    found = m.distinct_tokens(tokens)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) > 1 and sum(len(w.offsets) - 1 for w in words) == len(some)
    assert all(np.array_equal(a, b) for a, b in zip(tokens, whole))
    rows = list(zip(*tokens.keys.tolist(), tokens.ids.tolist()))
    first = {row: i for i, row in reversed(list(enumerate(rows)))}
    counted = Counter(rows)
    assert sorted(found[0].tolist()) == sorted(first.values())
    assert [rows[i] for i in found[0][found[1]]] == rows
    assert found[2].tolist() == [counted[rows[i]] for i in found[0]]
    assert most < 50 * len(rows)


def test_costs_equal_a_plain_scorer():
    lexicon, model, spelling = trained(corpus(), most=8)
    listed = {w: i + m.FIRST for i, w in enumerate(lexicon.words.to_pylist())}
    heads = lexicon.heads.tolist()

    def symbol(word):
        if word is None:
            return m.END
        if word in listed:
            return listed[word]
        data = word.encode()
        head = int.from_bytes(data[:3], "big") if len(data) >= 3 else -1
        return m.FIRST + len(listed) + heads.index(head) if head in heads else m.RARE

    some = texts("the of riverbank Unseen", "", "la casas word3x 5 5 the", "zz " * 30 + "été", *corpus().to_pylist()[:16])
    found = split_words(lowered(some))
    got = m.token_costs(model, lexicon.codes, m.tokens_of(found, lexicon))
    expected = []
    for text in some.to_pylist():
        ids = [symbol(t) for t in tokens(text)]
        for i, own in enumerate(ids):
            before = ids[max(0, i - m.REACH) : i]
            anchor = min([x for x in before if m.FIRST <= x < m.FIRST + len(listed)], default=m.ANCHORS - 1)
            keys = np.array([[ids[i - 1] if i else m.END], [anchor]])
            bits, _ = lexicon.codes.bits(model, m.token_contexts(keys), np.array([own]))
            expected.append(sum(math.log10(one_bit(model, bits.slots[:, k], bits.cell[k], bits.bit[k])) for k in range(len(bits.bit))))
    assert np.allclose(got, expected, atol=1e-4)

    words = found.distinct
    got = m.spelling_costs(spelling, words, lexicon.heads)
    for word, cost in zip(words.to_pylist(), got):
        data, _, contexts = m.spelled(texts(word))
        assert bytes(data) == word.encode() + b" "
        bits = m.spelled_bits(spelling, data, contexts)
        first = 3 * 8 if symbol(word) >= m.FIRST + len(listed) or (len(word.encode()) >= 3 and int.from_bytes(word.encode()[:3], "big") in heads) else 0
        plain = sum(math.log10(one_bit(spelling, bits.slots[:, k], bits.cell[k], bits.bit[k])) for k in range(first, len(bits.bit)))
        assert math.isclose(cost, plain, abs_tol=1e-4)


def test_next_symbols_and_bytes_add_up():
    lexicon, model, spelling = trained(corpus(), most=8)
    n = len(lexicon.codes.lengths)
    for key in ([m.END, m.ANCHORS - 1], [3, 2], [m.RARE, 4]):
        bits, token = lexicon.codes.bits(model, m.token_contexts(np.repeat(np.array(key)[:, None], n, axis=1)), np.arange(n))
        assert math.isclose((10 ** np.bincount(token, weights=model.costs(bits))).sum(), 1, rel_tol=1e-4)
    _, _, contexts = m.spelled(texts("river"))
    bits = m.spelled_bits(spelling, np.arange(256, dtype=np.uint8), np.repeat(contexts[:, 4:5], 256, axis=1))
    assert math.isclose((10 ** spelling.costs(bits).reshape(-1, 8).sum(axis=1)).sum(), 1, rel_tol=1e-4)


def test_context_across_tokens_helps():
    lexicon, model, _ = trained(corpus(), most=12)
    found = split_words(texts("the houses of the houses", "la de la la houses"))
    costs = m.token_costs(model, lexicon.codes, m.tokens_of(found, lexicon))
    assert costs[4] > costs[10] + 0.5


def test_states_add_up():
    whole, halves = m.Mixing(m.SPELL_SLOTS, m.SPELL_CELLS), [m.Mixing(m.SPELL_SLOTS, m.SPELL_CELLS) for _ in range(2)]
    words = texts("alpha", "beta", "gamma")
    m.learn_spelling(whole, words, np.array([2, 1, 3]))
    for model, part, times in zip(halves, (words[:1], words[1:]), ([2], [1, 3])):
        m.learn_spelling(model, part.take(pa.array(range(len(part)))), np.array(times))
    summed = m.Mixing(m.SPELL_SLOTS, m.SPELL_CELLS).restored(halves[0].state() + halves[1].state())
    assert (summed.counts == whole.counts).all() and summed.map.sum() == whole.map.sum()
    assert summed.bits == whole.bits and np.isfinite(summed.weights).all()


def test_long_words_in_steps():
    _, _, spelling = trained(corpus())
    long = "bee" * 9000
    assert math.isclose(m.spelling_costs(spelling, texts("a", long, "see"), np.zeros(0))[1], m.spelling_costs(spelling, texts(long), np.zeros(0))[0], rel_tol=1e-6)


def test_edges(spark):
    rows = [(1, "A b\ta"), (2, None), (3, ""), (3, ""), (None, "b c"), (5, "x " * 5000 + "été")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("word", F.lit("w"))
    got = [tuple(r)[:6] for r in m.score_documents(df, F.lit(False)).collect()]
    assert sorted((r[0] or 0, r[2]) for r in got) == [(0, 3), (1, 4), (2, 1), (3, 1), (3, 1), (5, 5002)]
    assert all(r[3] == r[2] and math.isfinite(r[5]) for r in got)
    assert m.score_documents(df.limit(0), F.lit(False)).count() == 0
    none = m.score_documents(df, F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)} and len(none) == 6


def test_costs_are_finite_at_large_counts():
    model = m.Mixing(m.SPELL_SLOTS, m.SPELL_CELLS)
    model.counts[:, 1] = 3e12
    assert np.isfinite(m.spelling_costs(model.ready(), texts("see", "été"), np.zeros(0))).all()


def test_lowest_before():
    rng = np.random.default_rng(4)
    values, place = rng.integers(2, 4000, 300), np.concatenate([np.arange(n) for n in (1, 120, 2, 177)])
    for reach in (1, 5, 16, 24):
        plain = [min([values[i - k] for k in range(1, reach + 1) if place[i] >= k], default=m.ANCHORS - 1) for i in range(300)]
        assert m.lowest_before(values, place, reach).tolist() == plain


def counted_bits(monkeypatch, name):
    """The number of bits that each call of a method of the model gets."""
    bits, plain = [], getattr(m.Mixing, name)
    monkeypatch.setattr(m.Mixing, name, lambda self, some, *more: bits.append(len(some.bit)) or plain(self, some, *more))
    return bits


def test_equal_work_is_done_once(monkeypatch):
    """Bytes after equal bytes, and first bits of codes in equal contexts, are looked up once; repeats add nothing."""
    lexicon, model, spelling = trained(corpus(), most=8)
    looked = counted_bits(monkeypatch, "costs")
    words = texts(*[f"{a}longend" for a in "abcdefgh"])
    costs = m.spelling_costs(spelling, words, np.zeros(0))
    # Eight first letters, five more places that still see them, and the rest of the word with its blank once.
    assert sum(looked) == 8 * (8 + 5 * 8 + 3)
    alone = [m.spelling_costs(spelling, texts(w), np.zeros(0))[0] for w in words.to_pylist()]
    assert np.allclose(costs, alone, rtol=1e-6)
    looked.clear()
    some = m.tokens_of(split_words(lowered(corpus())), lexicon)
    got = m.token_costs(model, lexicon.codes, some)
    paths = set()
    for one, anchor, own in zip(*some.keys.tolist(), some.ids.tolist()):
        start = lexicon.codes.starts[own]
        code = lexicon.codes.edges[start : start + lexicon.codes.lengths[own]].tolist()
        paths.update((one, anchor, edge) for edge in code)
    assert sum(looked) == len(paths)
    bits, token = lexicon.codes.bits(model, m.token_contexts(some.keys), some.ids)
    assert np.allclose(got, np.bincount(token, weights=model.costs(bits)), atol=1e-4)


def test_spelling_learns_equal_bytes_together(monkeypatch):
    fitted = counted_bits(monkeypatch, "fit")
    model = m.Mixing(m.SPELL_SLOTS, m.SPELL_CELLS)
    words = texts(*["straight"] * 400)
    m.learn_spelling(model, words, np.arange(400))
    assert sum(fitted) == 8 * 9 and model.bits == 400 * 8 * 9
    assert model.counts.sum() == 4 * 8 * 9 * sum(range(400)) and model.map.sum() == 400 * 8 * 9


def test_counts_of_slices_are_added_up(spark, monkeypatch):
    """In a task before the shuffle, in parts of any size; the words are those of plain counting."""
    rows = spark.createDataFrame([("A b b", False), ("b c", True), (None, False), ("a", False)] * 50, "text string, held_out boolean").coalesce(1)
    for most in (0, 10**6):
        monkeypatch.setattr(m, "COUNTED_WORDS", most)
        assert dict(m.count_words(rows).collect()) == {"a": 100, "b": 100, "c": 0}
    parts = [pa.table({"word": ["x", "y"], "trained": [1, 2]}), pa.table({"word": ["y"], "trained": [5]})]
    assert sorted(zip(*m.merged(parts).to_pydict().values())) == [("x", 1), ("y", 7)]


def test_common_words_are_priced_in_the_tasks(spark, monkeypatch):
    """Whether a word outside the lexicon is sent to the tasks or joined to the texts, the scores are the same."""
    monkeypatch.setattr(m, "LEXICON", 50)
    found = []
    for most in (0, 40, 10**6):
        monkeypatch.setattr(m, "COMMON_WORDS", most)
        rows = op6_lm_scoring(spark, f"{DATA}/sf0.001").collect()
        found.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in rows})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(a[0] == other[i][0] and np.allclose(a[1:], other[i][1:], rtol=1e-4) for i, a in found[0].items())


def test_least_count(spark):
    words = spark.createDataFrame([(n,) for n in (2, 2, 3, 5, 5, 9, 100)], "trained long")
    assert [m.least_count(words, most) for most in (0, 1, 2, 4, 5, 100)] == [None, 100, 9, 5, 3, 2]
    assert m.least_count(words.limit(0), 5) is None
