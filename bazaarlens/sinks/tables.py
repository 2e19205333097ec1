"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bazaarlens.functions.numbers import finite


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[finite(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays: join their elements."""
    arrays = {name for name, kind in df.dtypes if kind.startswith("array")}
    return df.select(
        *[F.array_join(F.col(c).cast("array<string>"), ", ").alias(c) if c in arrays else F.col(c) for c in df.columns]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with a header line in each."""
    _flat(clean(df)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = clean(df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
