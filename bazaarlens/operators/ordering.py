"""Ranks and running totals that never put a whole table in one task.

A plain ``Window.orderBy`` without partition columns sends every row to a single
task. Here rows are range-partitioned on the order, numbered inside each slice,
and shifted by the totals of the slices before it (one small row per slice).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.session import cut_lineage


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds ``position`` (1, 2, ... in ``order``) and, for each ``name: column`` of
    ``sums``, the inclusive running sum ``name`` and the grand total ``name_total``;
    ``position_total`` is the number of rows. All restart for each value of ``by``.

    ``order`` must be total within ``by``: no two rows equal on it.
    """
    sums = dict(sums or {})
    by = list(by)
    sliced = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id())
    upto = Window.partitionBy("_slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(
        "*",
        F.count(F.lit(1)).over(upto).alias("_at"),
        *[F.sum(column).over(upto).alias(f"_upto_{name}") for name, column in sums.items()],
    )
    # Slice borders come from sampling, so both readers below need one fixed copy.
    local = cut_lineage(local)

    ends = local.groupBy("_slice", *by).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(column).alias(f"_sum_{name}") for name, column in sums.items()]
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    shifts = ends.select(
        F.col("_slice").alias("_of__slice"),
        *[F.col(c).alias(f"_of_{c}") for c in by],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("position_total"),
        *[
            piece
            for name in sums
            for piece in (
                F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}"),
                F.sum(f"_sum_{name}").over(whole).alias(f"{name}_total"),
            )
        ],
    )
    if not by:
        shifts = F.broadcast(shifts)  # one row per range slice: bounded by the partition count
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_slice", *by)])
    return local.join(shifts, match).select(
        *df.columns,
        (F.col("_before") + F.col("_at")).alias("position"),
        "position_total",
        *[
            piece
            for name in sums
            for piece in ((F.col(f"_before_{name}") + F.col(f"_upto_{name}")).alias(name), f"{name}_total")
        ],
    )


def value_ranks(
    df: DataFrame, metrics: Sequence[str], weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Ranks of every metric at once, ties included; adds for each metric ``m``
    ``m_avg_rank`` (ascending, ties share their mean), ``m_dense_desc`` (dense,
    largest first) and ``m_ties`` (rows with that value), plus ``rank_rows``.

    ``weight`` counts a row several times. ``df`` is read twice, so it must give
    the same bits each time (see ``cut_lineage``). Rows with a null metric get
    null ranks for it.
    """
    by = list(by)
    count = F.sum(weight) if weight else F.count(F.lit(1))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    values = (
        df.select(*by, *([weight] if weight else []), F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "metric", "value")
        .agg(count.alias("ties"))
    )
    ranked = running_totals(values, [F.col("value").asc()], {"upto": "ties"}, by=[*by, "metric"])
    ranked = ranked.select(
        *by,
        "metric",
        "value",
        "ties",
        (F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)).alias("avg_rank"),
        (F.col("position_total") - F.col("position") + 1).alias("dense_desc"),
        F.col("upto_total").alias("rank_rows"),
    )
    out = df
    for m in metrics:
        side = ranked.where(F.col("metric") == m).select(
            *[F.col(c).alias(f"_{c}") for c in by],
            F.col("value").alias("_value"),
            F.col("avg_rank").alias(f"{m}_avg_rank"),
            F.col("dense_desc").alias(f"{m}_dense_desc"),
            F.col("ties").alias(f"{m}_ties"),
            F.col("rank_rows").alias(f"{m}_rank_rows"),
        )
        match = reduce(
            lambda a, b: a & b,
            [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by],
            F.col(m).cast("double") == F.col("_value"),
        )
        out = out.join(side, match, "left").drop("_value", *[f"_{c}" for c in by])
    return out


def sequence_within(
    df: DataFrame, key: str, when: str, tie: str, position: str, total: str
) -> DataFrame:
    """Adds the 1-based position of each row among the rows of its ``key`` ordered
    by ``when`` then ``tie``, and the number of rows of that key.

    Rows are numbered inside (key, day); the days of a key, at most one row per
    calendar day, give the shift. A key holding a large part of all rows is thus
    spread over its days instead of filling one task.
    """
    day = F.to_date(when)
    per_day = df.groupBy(F.col(key).alias("_key"), day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    days = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_day.select(
        "_key",
        "_day",
        F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_key")).alias("_total"),
    )
    in_day = Window.partitionBy(key, "_own_day").orderBy(when, tie)
    numbered = df.withColumn("_own_day", day).withColumn("_at", F.row_number().over(in_day))
    match = F.col(key).eqNullSafe(F.col("_key")) & F.col("_own_day").eqNullSafe(F.col("_day"))
    return numbered.join(shifts, match, "left").select(
        *df.columns,
        (F.col("_before") + F.col("_at")).alias(position),
        F.col("_total").alias(total),
    )
