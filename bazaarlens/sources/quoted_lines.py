"""Splittable reading of CSV files whose quoted fields hold line breaks.

Spark's multi-line reader gives a whole file to one task. Here lines are read in splits, and
whether a line begins inside a quoted field follows from the lines before it: each line maps the state
before it (outside or inside quotes) to the state after it. Of such a map only three things count: it keeps the
state, swaps it, or sets it. So the state at a line is the value set last, swapped as often as lines since then
swap; both are windows inside a split, and one row a split carries the state across splits. Lines of
one record are then joined and parsed by Spark's own ``from_csv``.

A quote counts only at the start of a field or when it closes one, so a stray quote in plain text opens nothing.

Defined results: a line break inside a field is read as LF, CR LF included; blank records are no rows; a record
with fewer fields than the header is filled with nulls and one with more is cut, as Spark's reader does. Lines end with
LF or CR LF. A quote that is never closed takes the rest of its file into one record, as in Spark's reader.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _opens(text: Column, sep: str) -> Column:
    """1 if a line (without doubled quotes) that begins outside quotes ends inside a field, else 0."""
    start = rf'(^|{re.escape(sep)})"'
    return F.regexp_replace(text, rf'{start}[^"]*"', "$1").rlike(start).cast("int")


def line_map(line: Column, sep: str) -> Column:
    """Struct of the state after ``line`` for a state before it of outside (``from0``) and inside (``from1``) quotes."""
    text = F.replace(line, F.lit('""'), F.lit(""))
    closes = F.locate('"', text)
    # What follows the closing quote is no start of a field.
    rest = F.concat(F.lit("x"), F.substring(text, closes + 1, F.length(text)))
    after = F.when(closes == 0, F.lit(1)).otherwise(_opens(rest, sep))
    return F.struct(_opens(text, sep).alias("from0"), after.alias("from1"))


def records(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """``record`` (text of each record but the first, which is the header) of the file ``path``."""
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select(
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.regexp_replace(text, r"\r$", "").alias("line"),
    ).withColumn("map", line_map(F.col("line"), sep))
    sets, swaps = F.col("map.from0") == F.col("map.from1"), F.col("map.from0") > F.col("map.from1")
    upto = Window.partitionBy("split").orderBy("id")
    swapped = F.sum(swaps.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)) % 2
    lines = lines.withColumn("swapped", swapped).withColumn("set", F.when(sets, F.col("map.from0").bitwiseXOR(F.col("swapped"))))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select(
        "split",
        "id",
        "line",
        # State before the line, and the one after it, but for what the split begins with: null there stands for "as it came".
        F.last("set", ignorenulls=True).over(before).alias("set_before"),
        F.coalesce(F.lag("swapped").over(upto), F.lit(0)).alias("swapped_before"),
        F.last("set", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("set"),
        "swapped",
    )

    # One row a split: its map as a whole, then the state it begins with.
    whole = lines.groupBy("split").agg(F.max_by(F.struct("set", "swapped"), "id").alias("end"))
    by_split = Window.orderBy("split")  # as many rows as the file has splits
    earlier = by_split.rowsBetween(Window.unboundedPreceding, -1)
    end = whole.select("split", F.col("end.set").alias("set"), F.col("end.swapped").alias("swapped"))
    end = end.withColumn("total", F.sum("swapped").over(by_split.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    end = end.withColumn("base", F.coalesce(F.lag("total").over(by_split), F.lit(0)))
    end = end.withColumn("fixed", F.col("set").bitwiseXOR(F.col("base")))
    came = F.coalesce(F.last("fixed", ignorenulls=True).over(earlier), F.lit(0)).bitwiseXOR(F.col("base"))
    states = end.select("split", came.cast("int").alias("came"))

    lines = lines.join(states, "split")
    inside = F.coalesce("set_before", "came").bitwiseXOR(F.col("swapped_before"))
    begins = F.when(inside == 0, F.struct("split", "id"))
    lines = lines.withColumn("begin", begins)
    own = F.last("begin", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("record", own)
    # A split's first lines can belong to the last record that an earlier split began.
    last = lines.groupBy("split").agg(F.max("begin").alias("last"))
    last = last.select("split", F.last("last", ignorenulls=True).over(earlier).alias("left_open"))
    lines = lines.join(last, "split").withColumn("record", F.coalesce("record", "left_open"))
    parts = F.sort_array(F.collect_list(F.struct("split", "id", "line")))
    joined = lines.groupBy("record").agg(F.concat_ws("\n", F.transform(parts, lambda x: x["line"])).alias("text"))
    filled = joined.where(F.trim("text") != "")
    header = filled.agg(F.min("record").alias("header")).scalar()
    return filled.where(F.col("record") > header).select(F.col("text").alias("record"))


def read_quoted(spark: SparkSession, path: str, columns: list[str], sep: str, encoding: str) -> DataFrame:
    """The rows of ``path`` with every column as text, like Spark's multi-line reader."""
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = records(spark, path, sep, encoding).select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(columns)])
