"""Language identification: held-out accuracy and edge cases."""

import math
import re

from pyspark.sql import functions as F

from bazaarlens.llm import langid
from bazaarlens.llm.queries import op8_language_id
from conftest import DATA


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    both = op8_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = both[both.held_out & (both.lang_pred != "und")]
    assert len(both) == docs.count() and len(held) > 100
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all()


def plain_prediction(model, text):
    """Language and score of one text, n-gram by n-gram."""
    buckets = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        framed = b"\0" + word.encode() + b"\0"
        for n in langid.NGRAMS:
            for at in range(len(framed) - n + 1):
                code = n
                for byte in framed[at : at + n]:
                    code = (code * 0x9E3779B97F4A7C15 + byte) % 2**64
                    code ^= code >> 29
                buckets.append(code % langid.DIMENSIONS)
    if not buckets:
        return "und", 0.0

    def winner(names):
        shares = dict.fromkeys(names, 0.0)
        for duel in model.duels:
            if duel.first in shares and duel.second in shares:
                margin = sum(duel.weights[b] for b in buckets) / len(buckets) + duel.bias
                p = 1 / (1 + math.exp(-max(-30, min(30, 4 * margin))))
                shares[duel.first] += p
                shares[duel.second] += 1 - p
        best = max(names, key=lambda x: shares[x])
        return best, shares[best] / (len(names) - 1) if len(names) > 1 else 1.0

    family, p = winner(sorted({langid.family_of(x) for x in model.languages}))
    lang, q = winner([x for x in model.languages if langid.family_of(x) == family])
    return lang, p * q


def test_predictions_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = langid.train(docs)
    rows = langid.predict(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == docs.count() and len(model.languages) > 2
    for r in rows[::4]:
        lang, score = plain_prediction(model, r["text"] or "")
        assert r["lang_pred"] == lang and math.isclose(r["lang_score"], score, abs_tol=1e-9)


def test_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of with", "en"), ("der und das mit", "de"), ("le les des avec", "fr")] * 5)]
    labelled = spark.createDataFrame([*rows, (90, None, "en"), (91, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(labelled)
    assert model.languages == ("de", "en", "fr")
    texts = [(1, None), (2, ""), (3, "12 !!"), (None, "the of " * 9000), (4, "der das und"), (4, "der das und")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "de")], key=str
    )
    assert langid.predict(df.limit(0), model).count() == 0
    clashing = df.withColumn("lang_pred", F.lit("own")).withColumn("lang_score", F.lit("own")).withColumn("score", F.lit(1))
    again = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(clashing, model).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)
    known = langid.keep_known(clashing, model)
    assert known.columns == clashing.columns and [r["lang_pred"] for r in known.collect()] == ["own"] * 3
    nothing = langid.train(labelled.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    single = langid.train(labelled.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(df, single).collect()} == {"und", "en"}
