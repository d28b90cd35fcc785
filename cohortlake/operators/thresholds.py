"""Decision-threshold sweep in one pass: count rows per threshold cell, then sum from the top."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.metrics import ratio

# fixed values: the sweep grid and the starting point of each search
START, STOP, COUNT = 0.01, 0.99, 99
DEFAULT_THRESHOLD = 0.5
SEARCHES = {"f1": 0.0, "balanced_accuracy": 0.0, "youden": -1.0}


def grid_value(i: Column) -> Column:
    """The i-th threshold, computed like an evenly spaced linspace."""
    step = (STOP - START) / (COUNT - 1)
    return F.when(i >= COUNT - 1, F.lit(STOP)).otherwise(i * F.lit(step) + F.lit(START))


def thresholds_reached(p: Column) -> Column:
    """How many grid thresholds satisfy p >= threshold (0..99)."""
    step = (STOP - START) / (COUNT - 1)
    near = F.round((p - START) / step).cast("int")
    return (
        F.when(p < START, 0)
        .when(p >= STOP, COUNT)
        .otherwise(near + F.when(p >= grid_value(near), 1).otherwise(0))
    )


def threshold_sweep(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """tp, fp, tn, fn, f1, balanced_accuracy, youden at each of the 99 thresholds.

    N rows shrink to at most 100 cells per group before anything is multiplied by the grid.
    """
    cells = df.groupBy(*by, thresholds_reached(F.col(score)).alias("cell")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    grid = (
        cells.groupBy(*by)
        .agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(COUNT))))
    )
    down = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    above = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(down)
    swept = grid.join(cells, [*by, "cell"], "left").select(
        *by, (F.col("cell") - 1).alias("i"), "n_pos", "n_neg", above("pos").alias("tp"), above("neg").alias("fp")
    )
    counts = swept.select(
        *by, "i", grid_value(F.col("i")).alias("threshold"), "tp", "fp",
        (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"),
        "n_pos", "n_neg",
    )
    sens, spec = ratio(F.col("tp"), F.col("n_pos")), ratio(F.col("tn"), F.col("n_neg"))
    balanced = F.when(F.col("n_pos") == 0, spec).when(F.col("n_neg") == 0, sens).otherwise((sens + spec) / 2)
    two_sided = ((F.col("n_pos") > 0) | (F.col("fp") > 0)) & ((F.col("n_neg") > 0) | (F.col("fn") > 0))
    return counts.select(
        *by, "i", "threshold", "tp", "fp", "tn", "fn",
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        balanced.alias("balanced_accuracy"),
        F.when(two_sided, sens + spec - 1.0).alias("youden"),
    )


def best_thresholds(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best value and lowest threshold reaching it, per measure; the default where nothing improves."""
    aggs = []
    for m, start in SEARCHES.items():
        better = F.max(m) > start
        aggs += [
            F.when(better, F.max_by("threshold", F.struct(F.col(m), -F.col("i"))))
            .otherwise(DEFAULT_THRESHOLD).alias(f"best_{m}_threshold"),
            F.when(better, F.max(m)).otherwise(start).alias(f"best_{m}_value"),
        ]
    return sweep.groupBy(*by).agg(*aggs)
