"""Reading the corpus tables and other small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; the residue decides the fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows. Reads no more than one row past the bound from each task."""
    return df.limit(rows + 1).count() <= rows
