"""Byte-pair encoding against the public library, exact merging and round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bazaarlens.llm import bpe
from bazaarlens.llm.queries import TOKENIZERS, op13_bpe
from conftest import DATA

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n", "x" * 5_000, "ab" * 3_000 + "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|endoftext",
    "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "é Å ﬁ", "I'LL we've 'S", "1234½٣", "\x00\x00 a\x00b", "漢字 한국어 \U0001F600‍", "a b　c",
]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = f"{TOKENIZERS}/{request.param}"
    return bpe.load_vocabulary(path), Tokenizer.from_file(path)


def _random_texts(alphabet, n, longest):
    rng = random.Random(3)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_as_the_public_library(both):
    vocabulary, library = both
    texts = ODD + _random_texts("aaaabeéèŸΣßﬁ' \t\n\x85　 12.!?<|>endoftextthings\U0001F600漢한", 1500, 60)
    texts += _random_texts("abcdeinthr", 1500, 90)
    ids = bpe.encode_batch(vocabulary, pa.array(texts, pa.large_utf8()))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.to_pylist() == wanted
    assert bpe.decode_batch(vocabulary, ids).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in wanted]


def test_compatible_pairs_by_merging(both):
    """A pair is compatible exactly if merging its bytes gives it again."""
    vocabulary, _ = both
    rng = np.random.default_rng(5)
    strings = {i: vocabulary.raw[i] for i in range(len(vocabulary.tokens)) if vocabulary.tokens[i] not in vocabulary.specials}
    inside = [i for i in vocabulary.inner.tolist() if i >= 0]
    ends = [i for i in vocabulary.last.tolist() if i >= 0]
    frequent = int(len(strings) * 0.03)
    a = np.concatenate([rng.choice(inside[:frequent], 3000), rng.choice(inside, 3000)])
    b = np.concatenate([rng.choice(ends[:frequent], 3000), rng.choice(ends, 3000)])
    merged = [bpe.merge_exactly(vocabulary, strings[x] + strings[y]) for x, y in zip(a.tolist(), b.tolist())]
    found = bpe.compatible(vocabulary, a, b)
    assert found.tolist() == [m == [x, y] for m, x, y in zip(merged, a.tolist(), b.tolist())]
    assert 0 < found.mean() < 1


def test_equal_merges_leftmost_first():
    """One repeated letter: borders where merges of the same rank meet."""
    alphabet = bpe.byte_alphabet()
    vocab = {c: i for i, c in enumerate(alphabet)}
    merges = [("a", "a"), ("aa", "aa"), ("aa", "a"), ("b", "aa")]
    for x, y in merges:
        vocab[x + y] = len(vocab)
    vocabulary = bpe.make_vocabulary(vocab, merges, "")
    assert vocabulary.ordered
    words = [("b" * k + "a" * n) for k in range(3) for n in range(1, 30)]
    got = bpe.encode_words(vocabulary, pa.array(words, pa.large_utf8())).to_pylist()
    for word, ids in zip(words, got):
        symbols = [vocab[c] for c in word]
        while True:  # plain merging
            found = [(vocabulary.merges[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in vocabulary.merges]
            if not found:
                break
            k = min(found)[1]
            symbols[k : k + 2] = [vocabulary.merges[symbols[k], symbols[k + 1]][1]]
        assert ids == symbols, word


def test_merges_out_of_order_are_merged_step_by_step():
    alphabet = bpe.byte_alphabet()
    vocab = {c: i for i, c in enumerate(alphabet)} | {"ab": 256, "abc": 257}
    vocabulary = bpe.make_vocabulary(vocab, [("ab", "c"), ("a", "b")], "")
    assert not vocabulary.ordered
    assert bpe.encode_words(vocabulary, pa.array(["abcab"], pa.large_utf8())).to_pylist() == [[257, 256]]


def test_round_trip_of_bytes():
    vocabulary = bpe.load_vocabulary(f"{TOKENIZERS}/byte_bpe_50k.json")
    texts = pa.array([*ODD, *_random_texts("ab \nÿé漢\U0001F600'", 300, 50)], pa.large_utf8())
    assert bpe.decode_batch(vocabulary, bpe.encode_batch(vocabulary, texts)).equals(texts)


def test_rows(spark):
    """Nulls, empty texts, repeated rows, extra columns and clashing names, an empty table."""
    vocabulary = bpe.load_vocabulary(f"{TOKENIZERS}/{FILES[0]}")
    rows = [(1, None, "x", 1.0), (2, "", "y", None), (3, "the cat", "z", 2.0), (3, "the cat", "z", 2.0), (None, "the cat", None, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded double")
    done = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    found = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in done.collect()), key=str)
    cat = ([vocabulary.tokens.index("the</w>"), vocabulary.tokens.index("cat</w>")], "the</w> cat</w>")
    assert found == sorted([(1, None, None), (2, [], ""), (3, *cat), (3, *cat), (None, *cat)], key=str)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    unknown = spark.createDataFrame([([cat[0][0], None, -5, 10**6],)], "ids array<int>")
    assert bpe.decode(unknown, vocabulary).first()["decoded"] == "the</w>"


def test_query_as_the_public_library(spark):
    folder = f"{DATA}/sf0.001"
    library = Tokenizer.from_file(f"{TOKENIZERS}/{FILES[0]}")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        wanted.add((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in op13_bpe(spark, folder).collect()} == wanted
