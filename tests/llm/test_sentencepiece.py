"""SentencePiece against the public library, and round trips."""

import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarlens.llm import sentencepiece as own

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _field(number, kind, data):
    key = _varint(number << 3 | kind)
    return key + (_varint(len(data)) + data if kind == 2 else data)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def library_model(pieces, scores):
    """A Unigram model file for the library. pieces: (text, kind) with kinds 1 normal, 2 unknown, 3 control, 6 byte."""
    out = b""
    for (text, kind), score in zip(pieces, scores):
        body = _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind))
        out += _field(1, 2, body)
    trainer = _field(3, 0, _varint(1)) + _field(35, 0, _varint(1))  # unigram, byte fallback
    normalizer = _field(1, 2, b"identity") + _field(3, 0, _varint(1)) + _field(4, 0, _varint(0)) + _field(5, 0, _varint(1))
    return out + _field(2, 2, trainer) + _field(3, 2, normalizer)


@pytest.fixture(scope="module")
def pieces():
    return own.load_pieces(PATH)


@pytest.fixture(scope="module")
def library(pieces):
    base = sentencepiece.SentencePieceProcessor(model_file=PATH)
    kinds = [2 if base.is_unknown(i) else 3 if base.is_control(i) else 6 if base.is_byte(i) else 1 for i in range(base.get_piece_size())]
    listed = [(base.id_to_piece(i), k) for i, k in enumerate(kinds)]
    return sentencepiece.SentencePieceProcessor(model_proto=library_model(listed, pieces.scores))


TEXTS = [
    "", " ", "  ", "a", "hello world", "  two  spaces ", "Ünïcödé straße 東京 \U0001f600!", "tab\there\nline\r\n",
    "x" * 300, "word" * 100 + " tail", " nbsp", "a\x00b c", "1234567890 3.14 €5", "ñoño ção",
]


def encoded(pieces, texts):
    return own.encode_batch(pieces, pa.array(texts, pa.large_utf8())).to_pylist()


def score(pieces, ids):
    return sum(float(pieces.scores[i]) for i in ids)


def test_same_as_the_library(pieces, library):
    for text, ids in zip(TEXTS, encoded(pieces, TEXTS)):
        theirs = library.encode(text)
        # The library adds scores in single precision: equal paths, or paths of the same score.
        assert ids == theirs or abs(score(pieces, ids) - score(pieces, theirs)) < 1e-3, text
        assert own.decode_batch(pieces, pa.array([ids], pa.large_list(pa.int32()))).to_pylist() == [text]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=60), max_size=6))
def test_round_trip(texts):
    pieces = own.load_pieces(PATH) if not hasattr(test_round_trip, "pieces") else test_round_trip.pieces
    test_round_trip.pieces = pieces
    ids = own.encode_batch(pieces, pa.array(texts, pa.large_utf8()))
    assert own.decode_batch(pieces, ids).to_pylist() == texts


def brute_force(pieces, normal, word):
    """Best path by trying every piece at every place; ties to the longer last piece."""
    best = {0: (0.0, [])}
    for at in range(len(word)):
        here, path = best[at]
        for stop in range(at + 1, len(word) + 1):
            piece = normal.get(word[at:stop])
            if piece is None and stop == at + 1:
                found = [int(pieces.byte_ids[b]) for b in word[at:stop].encode()]
                cost = pieces.unknown_score
            elif piece is None:
                continue
            else:
                found, cost = [piece], float(pieces.scores[piece])
            if stop not in best or here + cost > best[stop][0]:
                best[stop] = (here + cost, path + found)
    return best[len(word)][1]


@pytest.mark.parametrize("cross", [False, True])
def test_brute_force(cross):
    """Small random vocabularies, with and without pieces that cross words."""
    rng = np.random.default_rng(5)
    letters = "abé"
    names = {own.MARK, "a", "b"} | {"".join(rng.choice(list(letters), rng.integers(1, 5))) for _ in range(25)}
    names |= {own.MARK + n for n in list(names)[:10] if n != own.MARK} | ({f"a{own.MARK}b"} if cross else set())
    normal = {256 + i: n for i, n in enumerate(sorted(names))}
    texts = (*(bytes([b]) for b in range(256)), *(n.replace(own.MARK, " ").encode() for n in normal.values()))
    scores = np.concatenate([np.zeros(256), -rng.integers(1, 9, len(normal)).astype(float)])
    pieces = own.make_pieces(normal, scores, texts, np.arange(256, dtype=np.int32))
    assert pieces.by_words != cross
    by_text = {n: i for i, n in normal.items()}
    samples = ["".join(rng.choice(list(letters + " c"), rng.integers(0, 120))) for _ in range(60)]
    for text, ids in zip(samples, encoded(pieces, samples)):
        whole = own.MARK + text.replace(" ", own.MARK) if text else ""
        words = [whole] if cross else re.findall(f"{own.MARK}*[^{own.MARK}]+|{own.MARK}+", whole)
        assert ids == [i for w in words if w for i in brute_force(pieces, by_text, w)], text


def test_frames(spark, pieces):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "long " * 5000, "z"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_ string")
    done = own.decode(own.encode(df, pieces), pieces).collect()
    by_text = {r["text"]: r for r in done}
    assert len(done) == 5 and all(r["decoded"] == r["text"] for r in done)
    assert by_text[None]["ids"] is None and by_text[""]["ids"] == []
    assert own.decode(own.encode(df.limit(0), pieces), pieces).count() == 0
    odd = spark.createDataFrame([([0, 1, 99999, -4],), ([3 + 0xFF],)], "ids array<int>")
    assert [r[0] for r in own.decode(odd, pieces).select("decoded").collect()] == ["", "�"]
    clash = df.withColumn("ids", F.lit(0)).withColumn("decoded", F.lit(0))
    assert own.decode(own.encode(clash, pieces), pieces).where("text = 'hello world'").first()["decoded"] == "hello world"


def test_verified_in_one_pass(spark, pieces):
    """The same ids as encoding alone; nulls, repeats and clashing names."""
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "the cat ▁ \x00", "c", 3), (3, "the cat ▁ \x00", "c", 3), (None, "漢\n", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, round_trip int")
    got = own.encode_verified(df, pieces).collect()
    want = own.decode(own.encode(df, pieces), pieces).collect()
    pairs = [sorted(((r["doc_id"], r["text"], r["ids"], same(r)) for r in rows_), key=str) for rows_, same in (
        (got, lambda r: r["round_trip"]), (want, lambda r: r["decoded"] == r["text"])
    )]
    assert pairs[0] == pairs[1] and own.encode_verified(df.limit(0), pieces).count() == 0
