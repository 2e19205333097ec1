"""The pipeline on the smallest tables: what each stage keeps."""

import corpus_pipeline
from bazaarlens.llm import decontaminate, near
from conftest import DATA

FOLDER = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    assert len(corpus_pipeline.STAGES) == 4
    found = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs).collect()}
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    letters = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    expected = {i for i, c in found.items() if i == c and i in letters} - leaked
    result = corpus_pipeline.run(spark, FOLDER)
    rows = result.collect()
    assert result.columns == [*docs.columns, "ids", "round_trip"]
    assert {r["doc_id"] for r in rows} == expected and len(rows) == len(expected)
    assert all(r["round_trip"] for r in rows)


def test_odd_columns_and_rows(spark, tmp_path):
    """Names that stages use inside, null ids and texts, repeated rows, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, first_id long, lang_pred string, decoded string, ids string"
    prose = ["the and of with this that for was on are " * 5, "der und das mit ist ein nicht von zu dem " * 5]
    rows = [(k, prose[k % 2] + f" {k}" * 80, ("en", "de")[k % 2], "s", 1, 9, "x", "y", "z") for k in range(20)]
    rows += [rows[0], (None, rows[1][1], "de", *rows[1][3:]), (50, None, "en", *rows[0][3:]), (51, "", "en", *rows[0][3:])]
    folder = str(tmp_path)
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    for part, expected in ((rows, {*range(20), None}), ([], set())):
        docs = spark.createDataFrame(part, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        found = docs.collect()
        assert docs.columns == [*[c for c in schema.replace(",", "").split()[::2] if c != "ids"], "ids", "round_trip"]
        assert {r["doc_id"] for r in found} == expected and len(found) == len(expected)
        assert all(r["round_trip"] and (r["first_id"], r["lang_pred"], r["decoded"]) == (9, "x", "y") for r in found)
