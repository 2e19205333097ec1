"""Two-group tests and correlations.

All passes over rows are Spark aggregates; only the tail probability of a
one-row result is computed after the fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bazaarlens.functions.numbers import ratio
from bazaarlens.functions.tails import mann_whitney_exact, normal_pvalue, student_pvalue
from bazaarlens.operators.ordering import running_totals, value_ranks
from bazaarlens.session import cut_lineage


def welch(df: DataFrame, value: str, in_group_a: Column, small_sample: int = 20) -> DataFrame:
    """One row: sizes, means, t and degrees of freedom for unequal variances.
    ``t`` is null when a group has fewer than two values."""
    x = F.col(value)
    a, b = F.when(in_group_a, x), F.when(~in_group_a, x)
    facts = df.where(x.isNotNull()).agg(
        F.count(a).alias("n_group_a"),
        F.count(b).alias("n_group_b"),
        F.avg(a).alias("mean_group_a"),
        F.avg(b).alias("mean_group_b"),
        F.var_samp(a).alias("_va"),
        F.var_samp(b).alias("_vb"),
    )
    sa, sb = F.col("_va") / F.col("n_group_a"), F.col("_vb") / F.col("n_group_b")
    enough = (F.col("n_group_a") >= 2) & (F.col("n_group_b") >= 2)
    t = ratio(F.col("mean_group_a") - F.col("mean_group_b"), F.sqrt(sa + sb))
    freedom = ratio((sa + sb) * (sa + sb), sa * sa / (F.col("n_group_a") - 1) + sb * sb / (F.col("n_group_b") - 1))
    return facts.select(
        "n_group_a",
        "n_group_b",
        "mean_group_a",
        "mean_group_b",
        F.when(enough, t).alias("t_statistic"),
        F.when(enough, freedom).alias("degrees_of_freedom"),
        (F.least("n_group_a", "n_group_b") < small_sample).alias("small_sample"),
    )


def mann_whitney(df: DataFrame, value: str, in_group_a: Column) -> DataFrame:
    """One row: U of group a, its mean, tie-corrected deviation and z with
    continuity correction. Ranks are taken over distinct values."""
    counted = (
        df.where(F.col(value).isNotNull() & in_group_a.isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(F.count_if(in_group_a).alias("a"), F.count(F.lit(1)).alias("ties"))
    )
    ranked = running_totals(counted, [F.col("value").asc()], {"upto": "ties"})
    t = F.col("ties").cast("double")
    sums = ranked.agg(
        F.sum("a").alias("n_group_a"),
        F.sum(F.col("ties") - F.col("a")).alias("n_group_b"),
        F.sum(F.col("a") * (F.col("upto") - (t - 1) / 2)).alias("_rank_sum"),
        F.sum(t * t * t - t).alias("_tie_sum"),
        F.max("ties").alias("_most_ties"),
    )
    na, nb = F.col("n_group_a").cast("double"), F.col("n_group_b").cast("double")
    n = na + nb
    u = F.col("_rank_sum") - na * (na + 1) / 2
    mean = na * nb / 2
    deviation = F.sqrt(na * nb / 12 * (n + 1 - ratio(F.col("_tie_sum"), n * (n - 1))))
    return sums.select(
        "n_group_a",
        "n_group_b",
        u.alias("u_statistic"),
        mean.alias("u_mean"),
        deviation.alias("u_deviation"),
        ratio(F.greatest(u, na * nb - u) - mean - 0.5, deviation).alias("z_statistic"),
        # Small samples without ties have an exact distribution.
        ((F.least("n_group_a", "n_group_b") <= 8) & (F.col("_most_ties") == 1)).alias("exact_advised"),
    )


def two_group_tests(df: DataFrame, value: str, in_group_a: Column, label: str, small_sample: int = 20) -> DataFrame:
    """One row: sizes, means and both p-values, null without two values in each
    group. The rank test is exact if a group has at most eight values and none is
    tied. Runs at once: the tail probabilities are taken from the one-row statistics."""
    means = welch(df, value, in_group_a, small_sample).first()
    ranks = mann_whitney(df, value, in_group_a).first()
    enough = min(means["n_group_a"], means["n_group_b"]) >= 2
    if not enough:
        rank_pvalue = None
    elif ranks["exact_advised"]:
        rank_pvalue = mann_whitney_exact(int(ranks["u_statistic"]), ranks["n_group_a"], ranks["n_group_b"])
    else:
        rank_pvalue = normal_pvalue(ranks["z_statistic"])
    row = (
        label,
        means["n_group_a"],
        means["n_group_b"],
        means["mean_group_a"],
        means["mean_group_b"],
        student_pvalue(means["t_statistic"], means["degrees_of_freedom"]),
        rank_pvalue,
        means["small_sample"],
    )
    schema = (
        "label string, n_group_a bigint, n_group_b bigint, mean_group_a double, mean_group_b double, "
        "ttest_pvalue double, mannwhitney_pvalue double, small_sample boolean"
    )
    return df.sparkSession.createDataFrame([row], schema)


def spearman_statistic(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho and t over complete pairs (three at least).

    Equal pairs are counted first; ranks are centred on their known mean before
    multiplying, which keeps the sums accurate for very many rows."""
    pairs = (
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .dropna()
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = value_ranks(cut_lineage(pairs), ["x", "y"], weight="n")
    middle = (F.col("x_rank_rows") + 1) / F.lit(2.0)
    dx, dy, w = F.col("x_avg_rank") - middle, F.col("y_avg_rank") - middle, F.col("n").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
    )
    rho = F.when(F.col("n") >= 3, ratio(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))))
    t = F.col("rho") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return sums.select("n", rho.alias("rho")).select("n", "rho", t.alias("t_statistic"))


def spearman(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """One row: n, rho and p-value. Runs at once, like ``two_group_tests``."""
    found = spearman_statistic(df, x, y).first()
    row = (label, found["n"], found["rho"], student_pvalue(found["t_statistic"], float(found["n"] - 2)))
    return df.sparkSession.createDataFrame([row], "label string, n bigint, rho double, pvalue double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns on complete rows, long form."""
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(a, b) for a in columns for b in columns]

    def pearson(a: str, b: str) -> Column:
        return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # null for a constant column

    one_row = complete.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one_row.select(F.inline(F.array(*cells)))
