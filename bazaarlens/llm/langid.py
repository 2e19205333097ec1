"""Language identification in two levels: family first, then one-versus-one linear SVMs inside the family.

Features are relative frequencies of hashed byte n-grams of lower-cased words (2 to
4 bytes, word ends marked). The SVMs are trained by Spark ML on a bounded sample of
labelled documents, cut into chunks so that short texts are known too. A text is
scored whole: scores of its different words, weighted by their counts.

Defined results: null text or text without a letter gives ``und`` with score 0; with
one language learned, all other texts get it with score 1; with none, ``und``. Ties
between classes go to the alphabetically first one. Repeated rows are each
predicted; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.llm.words import flat_bytes, slices, split_words, sums, texts_of
from bazaarlens.session import cut_lineage

UNKNOWN = "und"
DIMENSIONS = 2048
NGRAMS = (2, 3, 4)
# Bounds of the training sample: documents of a language, and words of a chunk.
DOCS_PER_LANGUAGE = 600
CHUNKS_PER_LANGUAGE = 1_200
CHUNK_WORDS = 24
# Families of languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "pl", "ru", "sk", "uk"),
}


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


@dataclass(frozen=True)
class Duel:
    """A linear SVM that is above zero for ``first`` and below for ``second``."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    duels: tuple[Duel, ...]  # between families (names) and between languages of one family


def word_ngrams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word: (bucket of each n-gram, index of its word)."""
    data, bounds = flat_bytes(distinct)
    lengths = np.diff(bounds)
    # Every word with a mark before and after it.
    framed = np.zeros(len(data) + 2 * len(lengths), np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    framed[np.arange(len(data)) + 2 * owner + 1] = data
    word = np.repeat(np.arange(len(lengths)), lengths + 2)
    buckets, words = [], []
    for n in NGRAMS:
        count = len(framed) - n + 1
        if count <= 0:
            continue
        code = np.full(count, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + framed[k : k + count]
            code ^= code >> np.uint64(29)
        inside = word[:count] == word[n - 1 :]
        buckets.append((code[inside] % np.uint64(DIMENSIONS)).astype(np.int64))
        words.append(word[:count][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(words)


def _words(batch: pa.RecordBatch):
    return split_words(pc.utf8_lower(texts_of(batch, "text")), r"[^\pL]+")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ``CHUNK_WORDS`` words of every text, with features."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words = _words(batch)
            buckets, owner = word_ngrams(words.distinct)
            order = np.argsort(owner, kind="stable")
            buckets = buckets[order]
            starts = np.searchsorted(owner[order], np.arange(len(words.distinct) + 1))
            langs, doc_ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for i in range(batch.num_rows):
                codes = words.codes[words.offsets[i] : words.offsets[i + 1]]
                for at in range(0, len(codes), CHUNK_WORDS):
                    grams = np.concatenate([buckets[starts[c] : starts[c + 1]] for c in codes[at : at + CHUNK_WORDS]])
                    counts = np.bincount(grams, minlength=DIMENSIONS) / max(1, len(grams))
                    rows.append((langs[i], doc_ids[i], at, counts.astype(np.float32)))
                    if len(rows) == 500:
                        yield _chunk_batch(rows)
                        rows = []
            if rows:
                yield _chunk_batch(rows)


def _chunk_batch(rows: list) -> pa.RecordBatch:
    values = pa.array(np.concatenate([r[3] for r in rows]), pa.float32())
    features = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * DIMENSIONS, pa.int32()), values)
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), features]
    return pa.RecordBatch.from_arrays(columns, ["lang", "doc_id", "at", "features"])


def _sampled(df: DataFrame, keys: tuple[str, ...], rows: int) -> DataFrame:
    """For each language the ``rows`` rows whose hashed keys are smallest. Spark applies the limit before its shuffle."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64(*keys, F.lit(11)), *keys)
    return df.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= rows).drop("_at")


def train(labelled: DataFrame) -> Model:
    """Fits on at most ``DOCS_PER_LANGUAGE`` documents and ``CHUNKS_PER_LANGUAGE`` chunks of each language.

    ``labelled`` has doc_id, text and lang; rows without text or lang do not count.
    """
    usable = labelled.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)
    )
    # The sample is chosen by id before any text moves, then its texts are joined.
    ids = _sampled(usable.select("doc_id", "lang"), ("doc_id",), DOCS_PER_LANGUAGE).distinct()
    docs = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    chunks = docs.repartition(16, "doc_id").mapInArrow(
        _chunks, "lang string, doc_id long, at long, features array<float>"
    )
    chunks = cut_lineage(_sampled(chunks, ("doc_id", "at"), CHUNKS_PER_LANGUAGE))
    languages = tuple(sorted(r["lang"] for r in chunks.select("lang").distinct().collect()))
    family = {lang: family_of(lang) for lang in languages}
    vectors = chunks.select("lang", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    duels = _duels(vectors, {f: [x for x in languages if family[x] == f] for f in set(family.values())})
    for name in set(family.values()):
        duels += _duels(vectors, {lang: [lang] for lang in languages if family[lang] == name})
    return Model(languages, tuple(duels))


def _duels(vectors: DataFrame, members: dict[str, list[str]]) -> list[Duel]:
    names, out = sorted(members), []
    for i, first in enumerate(names):
        for second in names[i + 1 :]:
            rows = vectors.where(F.col("lang").isin(*members[first], *members[second])).select(
                F.col("lang").isin(*members[first]).cast("double").alias("label"), "features"
            )
            fitted = LinearSVC(maxIter=40, regParam=1e-5, standardization=False).fit(rows)
            out.append(Duel(first, second, fitted.coefficients.toArray(), float(fitted.intercept)))
    return out


def _level(names: list[str], duels: tuple[Duel, ...], margins: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winner (index into ``names``) and its mean probability over its duels, for every text."""
    n = len(next(iter(margins.values()))) if margins else 0
    shares = np.zeros((n, len(names)))
    for duel in duels:
        p = 1 / (1 + np.exp(-np.clip(4 * margins[duel.first, duel.second], -30, 30)))
        shares[:, names.index(duel.first)] += p
        shares[:, names.index(duel.second)] += 1 - p
    best = shares.argmax(axis=1)
    return best, shares[np.arange(n), best] / max(1, len(names) - 1)


def predict_batch(model: Model, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    words = _words(batch)
    lengths = np.diff(words.offsets)
    known = lengths > 0
    if not model.languages:
        return [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
    buckets, owner = word_ngrams(words.distinct)
    grams = np.bincount(owner, minlength=len(words.distinct))
    total = sums(grams[words.codes].astype(float), words.offsets)
    margins = {}
    for duel in model.duels:
        by_word = np.bincount(owner, weights=duel.weights[buckets], minlength=len(words.distinct))
        margins[duel.first, duel.second] = sums(by_word[words.codes], words.offsets) / np.maximum(1, total) + duel.bias
    families = sorted({family_of(x) for x in model.languages})
    inside = lambda names: tuple(d for d in model.duels if d.first in names and d.second in names)
    top, top_p = _level(families, inside(families), margins) if len(families) > 1 else (np.zeros(len(known), int), np.ones(len(known)))
    lang, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
    for k, name in enumerate(families):
        members = [x for x in model.languages if family_of(x) == name]
        won, p = _level(members, inside(members), margins) if len(members) > 1 else (np.zeros(len(known), int), np.ones(len(known)))
        here = (top == k) & known
        lang[here] = np.array(members, object)[won[here]]
        score[here] = (top_p * p)[here]
    return lang.tolist(), score


def predicted(text: Column, model: Model) -> Column:
    """Struct of lang and score of each text. Only the texts travel to Python and only the results back."""

    @F.arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [predict_batch(model, batch) for batch in slices(whole, "text")]
        langs = [lang for part, _ in parts for lang in part]
        scores = np.concatenate([np.zeros(0), *[score for _, score in parts]])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])

    return run(text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text) and lang_pred, lang_score for every row; input columns of these names are replaced."""
    both = predicted(F.col("text"), model)
    return docs.withColumn("lang_score", both).withColumns(
        {"lang_pred": F.col("lang_score.lang"), "lang_score": F.col("lang_score.score")}
    )


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in whose text a language is found, as they are."""
    return docs.where(predicted(F.col("text"), model)["lang"] != UNKNOWN)
