"""The corpus pipeline: STAGES in order, each written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.llm import decontaminate, langid, near, sentencepiece
from bazaarlens.llm.queries import PIECES, labelled_documents
from bazaarlens.llm.tables import read
from bazaarlens.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without text or letters go."""
    model = langid.train(labelled_documents(docs))
    return langid.keep_known(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts."""
    return near.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether decoding gives the text again.

    Input columns named ids or round_trip are replaced."""
    return sentencepiece.encode_verified(docs, sentencepiece.load_pieces(PIECES))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode_pieces),
]

# No stage with trained models or sketches can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
