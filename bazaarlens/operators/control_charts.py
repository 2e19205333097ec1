"""Process-control and chart statistics as DataFrames.

Period series hold one row per period (months), so a window over all of them and
an array of their labels are both small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bazaarlens.functions.numbers import clip, ratio

MIN_POINTS = 3
SIGMAS = 3


def _out_of_control(points: Column, upper: Column, lower: Column) -> Column:
    broken = F.filter(points, lambda p: (p["value"] > upper) | (p["value"] < lower))
    return F.transform(broken, lambda p: p["period"])


def control_chart(series: DataFrame, period: str, value: str, lower_at_zero: bool = False) -> DataFrame:
    """One row: centre line, mean ± 3 sample deviations, labels outside the limits.
    No row with fewer than three points."""
    points = F.array_sort(F.collect_list(F.struct(F.col(period).alias("period"), F.col(value).alias("value"))))
    facts = series.dropna(subset=[period, value]).agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(value).alias("center_line"),
        F.stddev_samp(value).alias("deviation"),
        points.alias("series"),
    )
    upper = F.col("center_line") + SIGMAS * F.col("deviation")
    lower = F.col("center_line") - SIGMAS * F.col("deviation")
    if lower_at_zero:
        lower = F.greatest(F.lit(0.0), lower)
    limits = facts.where(F.col("points") >= MIN_POINTS).withColumns(
        {"upper_control_limit": upper, "lower_control_limit": lower}
    )
    return limits.select(
        "center_line",
        "upper_control_limit",
        "lower_control_limit",
        _out_of_control(F.col("series"), F.col("upper_control_limit"), F.col("lower_control_limit")).alias(
            "out_of_control_periods"
        ),
    )


def p_chart_points(series: DataFrame, period: str, events: str, trials: str, rate: str) -> DataFrame:
    """Per period: pooled rate and its 3-sigma limits clipped to [0, 1]."""
    every = Window.partitionBy()
    used = series.dropna(subset=[period, events, trials, rate]).where(F.col(trials) > 0)
    pooled = ratio(F.sum(events).over(every), F.sum(trials).over(every))
    points = used.select(
        F.col(period).alias("period"),
        F.col(rate).alias("rate"),
        F.col(trials).alias("trials"),
        pooled.alias("center_line"),
        F.count(F.lit(1)).over(every).alias("_points"),
    ).where(F.col("_points") >= MIN_POINTS)
    sigma = F.sqrt(F.col("center_line") * (1 - F.col("center_line")) / F.col("trials"))
    limits = points.withColumns(
        {
            "upper_control_limit": clip(F.col("center_line") + SIGMAS * sigma, 0.0, 1.0),
            "lower_control_limit": clip(F.col("center_line") - SIGMAS * sigma, 0.0, 1.0),
        }
    )
    outside = (F.col("rate") > F.col("upper_control_limit")) | (F.col("rate") < F.col("lower_control_limit"))
    return limits.select(
        "period", "rate", "center_line", "upper_control_limit", "lower_control_limit", outside.alias("out_of_control")
    )


def p_chart(series: DataFrame, period: str, events: str, trials: str, rate: str) -> DataFrame:
    """One row: pooled rate, widest limits, labels outside their own limits."""
    points = p_chart_points(series, period, events, trials, rate)
    broken = F.array_sort(F.collect_list(F.when(F.col("out_of_control"), F.col("period"))))
    summary = points.agg(
        F.first("center_line").alias("center_line"),
        F.max("upper_control_limit").alias("upper_control_limit"),
        F.min("lower_control_limit").alias("lower_control_limit"),
        broken.alias("out_of_control_periods"),
    )
    return summary.where(F.col("center_line").isNotNull())


def linear_trend(series: DataFrame, period: str, value: str) -> DataFrame:
    """Per period: least-squares line over 0, 1, 2, ... (three points at least)."""
    every = Window.partitionBy()
    numbered = series.dropna(subset=[period, value]).select(
        F.col(period).alias("period"),
        F.col(value).alias("value"),
        (F.row_number().over(Window.orderBy(period)) - 1).cast("double").alias("x"),
    )
    fitted = numbered.withColumns(
        {
            "points": F.count(F.lit(1)).over(every),
            "slope": F.regr_slope("value", "x").over(every),
            "intercept": F.regr_intercept("value", "x").over(every),
        }
    ).where(F.col("points") >= MIN_POINTS)
    return fitted.select(
        "period", "value", "slope", "intercept", (F.col("intercept") + F.col("slope") * F.col("x")).alias("trend")
    )


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outliers per group. Works on counted
    distinct values, so the exact percentile keeps one entry per distinct value."""
    counted = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    quartiles = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    boxes = counted.groupBy(group).agg(quartiles.alias("q"), F.sum("n").alias("rows"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    boxes = boxes.select(
        group,
        "rows",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - reach).alias("_low"),
        (F.col("q")[2] + reach).alias("_high"),
    )
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return (
        counted.join(boxes, group)
        .groupBy(group, "rows", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("_least"),
            F.max(F.when(inside, F.col(value))).alias("_most"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
            F.min(F.when(~inside, F.col(value))).alias("lowest_outlier"),
            F.max(F.when(~inside, F.col(value))).alias("highest_outlier"),
        )
        .select(
            group,
            "rows",
            "q1",
            "median",
            "q3",
            F.least("q1", "_least").alias("whisker_low"),
            F.greatest("q3", "_most").alias("whisker_high"),
            "outliers",
            "lowest_outlier",
            "highest_outlier",
        )
    )


def bubble_sizes(df: DataFrame, x: str, y: str, size: str, largest: float = 800.0) -> DataFrame:
    """Adds ``bubble_size``: ``size`` moved to start at 1 and scaled to ``largest``."""
    used = df.dropna(subset=[x, y, size])
    span = used.agg(F.struct(F.min(size).alias("low"), F.max(size).alias("high"))).scalar()
    moved = F.col(size) - span["low"] + 1
    return used.withColumn("bubble_size", moved / (span["high"] - span["low"] + 1) * largest)
