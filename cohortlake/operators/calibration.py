"""Confidence calibration: expected calibration error, reliability table, score histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge(i: Column, n: int) -> Column:
    """The i-th of n+1 evenly spaced edges on [0, 1], in the same floating-point form as linspace."""
    return F.when(i >= n, F.lit(1.0)).otherwise(i * F.lit(1.0 / n))


def upper_closed_bin(v: Column, n: int) -> Column:
    """Index of the bin (lo, hi] holding ``v``; the first bin also holds its lower edge."""
    g = F.ceil(v * n).cast("int") - 1
    g = F.when(v <= edge(g, n), g - 1).when(v > edge(g + 1, n), g + 1).otherwise(g)
    return F.greatest(F.least(g, F.lit(n - 1)), F.lit(0))


def lower_closed_bin(v: Column, n: int) -> Column:
    """Index of the bin [lo, hi) holding ``v``; the last bin also holds its upper edge."""
    g = F.floor(v * n).cast("int")
    g = F.when(v < edge(g, n), g - 1).when(v >= edge(g + 1, n), g + 1).otherwise(g)
    return F.least(g, F.lit(n - 1))


def with_confidence(df: DataFrame, y: str, score: str) -> DataFrame:
    """Add pred (score >= 0.5), conf (probability of pred) and correct."""
    pred = F.when(F.col(score) >= 0.5, 1).otherwise(0)
    return df.select(
        "*", pred.alias("pred"),
        F.when(F.col(score) >= 0.5, F.col(score)).otherwise(1.0 - F.col(score)).alias("conf"),
        (pred == F.col(y)).alias("correct"),
    )


def _bins(df: DataFrame, by: Sequence[str], y: str, score: str, n_bins: int) -> DataFrame:
    rows = with_confidence(df, y, score).withColumn("bin", upper_closed_bin(F.col("conf"), n_bins))
    return rows.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("conf").alias("conf")
    )


def expected_calibration_error(
    df: DataFrame, by: Sequence[str], y: str, score: str, n_bins: int = 10
) -> DataFrame:
    """Sum over bins of (share of rows) * |accuracy - confidence|; 0.0 for no rows."""
    bins = _bins(df, by, y, score, n_bins)
    gap = F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf")))
    return bins.groupBy(*by).agg(F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(0.0)).alias("ece"))


def reliability_table(df: DataFrame, by: Sequence[str], y: str, score: str, n_bins: int = 10) -> DataFrame:
    """Every bin of every group: acc, conf, n, gap; an empty bin has acc 0 and conf at its middle."""
    bins = _bins(df, by, y, score, n_bins)
    grid = bins.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    full = grid.join(bins, [*by, "bin"], "left")
    i = F.col("bin")
    conf = F.coalesce("conf", (edge(i, n_bins) + edge(i + 1, n_bins)) / 2)
    acc = F.coalesce("acc", F.lit(0.0))
    return full.select(
        *by, "bin", F.coalesce("n", F.lit(0)).alias("n"), acc.alias("acc"), conf.alias("conf"),
        F.abs(acc - conf).alias("gap"),
    )


def score_histogram(df: DataFrame, by: Sequence[str], score: str, n_bins: int = 10) -> DataFrame:
    """Counts of scores in even bins on [0, 1] for each ``by`` group (say, the true class), zeros included."""
    inside = df.where(F.col(score).between(0.0, 1.0)).withColumn("bin", lower_closed_bin(F.col(score), n_bins))
    counts = inside.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
