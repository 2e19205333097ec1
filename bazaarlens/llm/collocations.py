"""Phrase collocations from top-order windows.

Every word is followed by the next four of its piece, padded at the piece's end: these lead columns are counted once
as whole windows, and Spark's ROLLUP over them sums the counts of ever shorter prefixes, which are the counts of all
phrases of two to five words. No phrase length is exploded on its own.

Words travel as 64-bit codes of (language, word), so a code stands for a word in its language; the word table proves
that no two of them share a code (else the counting starts again with other codes).

A window is cut where no phrase with the wanted count can go on. For that, pairs and triples of words are first counted
by slots of a table of fixed size: a slot below the wanted count holds only rarer ones. The cut loses nothing at any
table size; it only saves windows. Counts of single words come from the word table.

Defined results: null text counts as empty, null language as ``und``. Repeated rows count each. Phrases are cut at
``[.,;:!?]`` and line breaks and split at blanks and tabs; only A-Z are lower-cased. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.llm.words import flat_bytes, slices, texts_of
from bazaarlens.session import cut_lineage

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
# A candidate goes if a longer one around it has at least so many percent of its count.
COVERED_PERCENT = 100
UNKNOWN = "und"
# Bytes that end a piece, and that end a word within it.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
# Slots of the table of pairs (and of that of triples): a power of two near words / 32 within these bounds.
SLOT_BITS = (16, 24)
WORDS_PER_SLOT = 32
CHUNK_BITS = 16
# Rows that a task holds before it hands on what it has counted.
HELD_ROWS = 600_000
SALTS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * _MIX[0]
    return code ^ (code >> np.uint64(29))


@dataclass(frozen=True)
class Coded:
    """Words of a slice in order: their code, and how many more words follow each in its piece.

    ``distinct`` and ``langs`` are the words and languages of the slice, ``word`` and ``lang`` index into them.
    """

    codes: np.ndarray
    follow: np.ndarray
    distinct: pa.Array
    langs: list[str]
    word: np.ndarray
    lang: np.ndarray


def code_words(batch: pa.RecordBatch, seed: int) -> Coded:
    texts = texts_of(batch, "text")
    data, bounds = flat_bytes(texts)
    data = _LOWER[data]
    kind = _KIND[data]
    inside = kind == 0
    # A text's first byte starts a word even if the text before it ended inside one.
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds[:-1]] = True
    fresh = fresh[:-1]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])[: len(data)] | inside & fresh)
    word_bytes = data[inside]
    ends = np.append(np.cumsum(inside)[starts] - 1, len(word_bytes))
    spelled = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(word_bytes)]
    )
    coded = spelled.dictionary_encode()
    text = np.searchsorted(bounds, starts, side="right") - 1
    piece = np.cumsum((kind == 2) | fresh)[starts] if len(starts) else starts
    # Pieces are numbered in order; the words left in a piece follow from where the next piece starts.
    after = np.searchsorted(piece, piece, side="right")
    langs = batch.column("lang").cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    names = langs.dictionary.to_pylist()
    lang = langs.indices.to_numpy(zero_copy_only=False)[text]
    word = coded.indices.to_numpy(zero_copy_only=False)
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()], np.uint64)
    salts = np.array([xxhash.xxh64_intdigest(n.encode(), seed + 1) for n in names], np.uint64)
    codes = _mixed(hashes[word] ^ salts[lang]) if len(word) else np.zeros(0, np.uint64)
    # Zero is the padding.
    codes = np.where(codes == 0, np.uint64(1), codes).view(np.int64)
    return Coded(codes, after - np.arange(len(starts)) - 1, coded.dictionary, names, word, lang)


def _summed(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    """One table with ``n`` summed by ``keys``."""
    out = pa.concat_tables(tables).combine_chunks().group_by(keys).aggregate([("n", "sum")])
    return out.select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def _counted(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums by ``keys`` over all tables of a task; what is held is handed on when it gets large."""
    held, rows = [], 0
    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows > HELD_ROWS:
            held = [_summed(held, keys)]
            rows = held[0].num_rows
            if rows > HELD_ROWS // 2:
                yield from held[0].to_batches(max_chunksize=100_000)
                held, rows = [], 0
    if rows:
        yield from _summed(held, keys).to_batches(max_chunksize=100_000)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))


def word_table(docs: DataFrame, seed: int) -> DataFrame:
    """code, lang, word, n of every word of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    c = code_words(batch, seed)
                    both, first, n = np.unique(c.lang.astype(np.int64) * len(c.distinct) + c.word, return_index=True, return_counts=True)
                    yield pa.table({
                        "code": c.codes[first],
                        "lang": pa.array(c.langs, pa.string()).take(pa.array(c.lang[first])),
                        "word": c.distinct.take(pa.array(c.word[first])).cast(pa.binary()).cast(pa.string()),
                        "n": n.astype(np.int64),
                    })

        yield from _counted(tables(), ["code", "lang", "word"])

    return _texts(docs).mapInArrow(run, "code long, lang string, word string, n long").groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


def collision_free_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The word table, written, with the first seed that gives every word of every language a code of its own."""
    for seed in count(1, 2):
        words = cut_lineage(word_table(docs, seed))
        if not words.groupBy("code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").take(1):
            return words, seed
    raise AssertionError("unreachable")


def _slots(codes: np.ndarray, follow: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Slot of the phrase of ``length`` words at every place, -1 where the piece ends before."""
    n = max(0, len(codes) - length + 1)
    key = np.full(n, length, np.uint64)
    for k in range(length):
        key = (key + codes[k : k + n].view(np.uint64)) * _MIX[k % 2]
        key ^= key >> np.uint64(32)
    out = np.full(len(codes), -1, np.int64)
    out[:n] = np.where(follow[:n] >= length - 1, (key * _MIX[0] >> np.uint64(64 - bits)).astype(np.int64), -1)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts up to 255 of a chunk, as (place, count) where that is shorter."""
    counts = np.minimum(counts, 255).astype(np.uint8)
    at = np.flatnonzero(counts)
    if 3 * len(at) >= len(counts):
        return counts.tobytes()
    return at.astype(np.uint16).tobytes() + counts[at].tobytes()


def _unpack_into(total: np.ndarray, packed: bytes) -> None:
    if len(packed) == len(total):
        total += np.frombuffer(packed, np.uint8)
    else:
        k = len(packed) // 3
        total[np.frombuffer(packed, np.uint16, k).astype(np.int64)] += np.frombuffer(packed, np.uint8, k, 2 * k)


def frequent_slots(docs: DataFrame, seed: int, bits: int, min_count: int) -> dict[int, np.ndarray]:
    """For pairs (2) and triples (3) whether each slot reaches ``min_count``. Two bits for each slot reach the driver.

    Each task counts into one table of fixed size and hands on its chunks, at most a byte a slot.
    """
    if min_count > 255:
        raise ValueError("slots are counted up to 255 in each task")
    chunk = 1 << min(CHUNK_BITS, bits)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(1 << bits, np.uint32) for k in (2, 3)}
        for whole in batches:
            for batch in slices(whole, "text"):
                c = code_words(batch, seed)
                for k, table in tables.items():
                    slot = _slots(c.codes, c.follow, k, bits)
                    np.add.at(table, slot[slot >= 0], 1)
        for k, table in tables.items():
            parts = table.reshape(-1, chunk)
            full = np.flatnonzero(parts.any(axis=1))
            for some in np.array_split(full, max(1, len(full) // 16)):
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(2 * some + (k - 2), pa.int64()),
                    "counts": pa.array([_packed(parts[i]) for i in some.tolist()], pa.binary()),
                })

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                _unpack_into(held.setdefault(key, np.zeros(chunk, np.int64)), packed)
        bitmaps = [np.packbits(total >= min_count).tobytes() for total in held.values()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([*held], pa.int64()), "bitmap": pa.array(bitmaps, pa.binary())})

    chunks = 2 * ((1 << bits) // chunk)
    rows = (
        _texts(docs).mapInArrow(counts, "chunk long, counts binary")
        .repartition(min(chunks, 64), "chunk")
        .mapInArrow(totals, "chunk long, bitmap binary")
        .collect()
    )
    out = {k: np.zeros((1 << bits) // chunk * chunk, bool) for k in (2, 3)}
    for r in rows:
        at = (r["chunk"] // 2) * chunk
        out[2 + r["chunk"] % 2][at : at + chunk] = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=chunk).astype(bool)
    return out


def windows(docs: DataFrame, seed: int, bits: int, frequent: dict[int, np.ndarray]) -> DataFrame:
    """w1..w5, n: the padded longest windows and their counts, by task. Windows of one word are left out."""
    shared = docs.sparkSession.sparkContext.broadcast({k: np.packbits(v) for k, v in frequent.items()})
    columns = [f"w{k}" for k in range(1, LONGEST + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: np.unpackbits(v).astype(bool) for k, v in shared.value.items()}

        def tables() -> Iterator[pa.Table]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    c = code_words(batch, seed)
                    goes = {}
                    for k in (2, 3):
                        slot = _slots(c.codes, c.follow, k, bits)
                        goes[k] = (slot >= 0) & known[k][slot]
                    at = np.flatnonzero(goes[2])
                    lead, still = [c.codes[at], c.codes[np.minimum(at + 1, len(c.codes) - 1)]], np.ones(len(at), bool)
                    for k in range(2, LONGEST):
                        # Word k + 1 follows if the triple that it ends can be frequent.
                        still = still & goes[3][np.minimum(at + k - 2, len(c.codes) - 1)]
                        lead.append(np.where(still, c.codes[np.minimum(at + k, len(c.codes) - 1)], 0))
                    yield pa.table([*map(pa.array, lead), pa.array(np.ones(len(at), np.int64))], names=[*columns, "n"])

        yield from _counted(tables(), columns)

    return _texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "n"]))


def phrase_counts(longest: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """size, w1..w5 (0 past the end), f of all phrases with at least ``min_count`` occurrences."""
    columns = [f"w{k}" for k in range(1, LONGEST + 1)]
    merged = longest.groupBy(*columns).agg(F.sum("n").alias("n"))
    summed = merged.rollup(*columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    # grouping_id has a bit for each column that is summed over: 2^(5 - k) - 1 for prefixes of k words.
    size = F.lit(LONGEST) - F.bit_count("left_out")
    last = reduce(lambda other, k: F.when(F.col("size") == k, F.col(f"w{k}")).otherwise(other), range(1, LONGEST + 1), F.lit(0))
    phrases = (
        summed.where(F.col("f") >= min_count).withColumn("size", size.cast("int")).where((F.col("size") >= 2) & (last != 0))
        .select("size", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns], "f")
    )
    zero = F.lit(0).cast("long")
    single = words.where(F.col("n") >= min_count).select(
        F.lit(1).alias("size"), F.col("code").alias("w1"), *[zero.alias(c) for c in columns[1:]], F.col("n").alias("f")
    )
    return phrases.unionByName(single)


def _part(row: Column, first: int, size: int) -> list[Column]:
    """w1..w5 of the ``size`` words from word ``first`` (from 1) on."""
    return [(row[f"w{first + k - 1}"] if k <= size else F.lit(0).cast("long")).alias(f"w{k}") for k in range(1, LONGEST + 1)]


def _parts(span: Column, wanted, extra) -> Column:
    """Array of structs, for every size from 2 on, of the parts that ``wanted(size)`` lists as (first, size)."""
    made = {
        size: F.array(*[F.struct(*_part(span, first, n), *extra(size, first, n)) for first, n in wanted(size)])
        for size in range(2, LONGEST + 1) if wanted(size)
    }
    return reduce(lambda other, size: F.when(F.col("size") == size, made[size]).otherwise(other), made, F.lit(None))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase, the first part and the rest at its lowest-scoring cut, n the words of the language;
    score is floor(1000 * a * n / (l * r)), in exact decimals. Best first: score, then a, then the phrase's bytes.
    """
    words, seed = collision_free_words(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(max((every // WORDS_PER_SLOT).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    frequent = frequent_slots(docs, seed, bits, min_count)
    counts = cut_lineage(phrase_counts(windows(docs, seed, bits, frequent), words, min_count))
    return _ranked(_uncovered(_scored(counts, words, totals), counts), words, top)


def _scored(counts: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with lang, n and l, r, score of their lowest-scoring cut (the earliest of equal ones)."""
    columns = [f"w{k}" for k in range(1, LONGEST + 1)]
    names = words.select(F.col("code").alias("w1"), "lang")
    candidates = counts.where("size >= 2").withColumnRenamed("f", "a")
    whole = candidates.withColumn("whole", F.struct(*columns))
    rests = whole.select("size", "whole", "a", F.inline(_parts(
        F.col("whole"), lambda size: [(k + 1, size - k) for k in range(1, size)], lambda size, first, n: [F.lit(first - 1).alias("cut")]
    )))
    rests = rests.join(counts.select(*columns, F.col("f").alias("r")), columns).drop(*columns)
    firsts = rests.select("size", "whole", "a", "cut", "r", *[
        F.when(F.lit(k) <= F.col("cut"), F.col(f"whole.w{k}")).otherwise(0).alias(f"w{k}") for k in range(1, LONGEST + 1)
    ])
    cuts = firsts.join(counts.select(*columns, F.col("f").alias("l")), columns)
    cuts = cuts.join(names, "w1").join(totals, "lang")
    # Counts of up to 10^17 words fit these decimals.
    score = F.expr(
        "cast((cast(1000 * cast(a as decimal(17,0)) as decimal(20,0)) * cast(n as decimal(18,0)))"
        " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
    )
    cuts = cuts.withColumn("score", score)
    best = F.min(F.struct("score", "cut", "l", "r"))
    return cuts.groupBy("whole", "size", "a", "lang", "n").agg(best.alias("b")).select("whole", "size", "a", "lang", "n", "b.l", "b.r", "b.score")


def _uncovered(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Without the candidates that stand in a longer one of nearly their count."""
    columns = [f"w{k}" for k in range(1, LONGEST + 1)]
    longer = counts.where("size >= 3").withColumn("span", F.struct(*columns))

    def inner(size: int) -> list[tuple[int, int]]:
        return [(first, n) for n in range(2, size) for first in range(1, size - n + 2)]

    covers = longer.select("f", F.inline(_parts(F.col("span"), inner, lambda size, first, n: []))).groupBy(*columns).agg(F.max("f").alias("most"))
    joined = scored.select("*", *[F.col(f"whole.{c}").alias(c) for c in columns]).join(covers, columns, "left")
    return joined.where(F.col("most").isNull() | (100 * F.col("most") < COVERED_PERCENT * F.col("a"))).drop("most")


def _ranked(kept: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language; each language is cut in ``SALTS`` parts before it comes together."""
    pieces = kept.select(
        "lang", "a", "l", "r", "n", "score", "whole",
        F.posexplode(F.filter(F.array(*[f"w{k}" for k in range(1, LONGEST + 1)]), lambda w: w != 0)).alias("at", "code"),
    )
    spelled = pieces.join(words.select("code", "word"), "code").groupBy("whole", "lang", "a", "l", "r", "n", "score").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"])).alias("phrase")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = spelled.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
