"""Aggregation of repeated predictions: (subject, run, class, prob) rows -> one prediction per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("mean", "median", "majority")


def tta_mean(df: DataFrame, by: Sequence[str], value: str = "prob") -> DataFrame:
    """Mean over runs; also used for logits."""
    return df.groupBy(*by, "cls").agg(F.avg(value).alias(value))


def tta_median(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lower middle value over runs (no averaging for an even run count)."""
    return df.groupBy(*by, "cls").agg(F.expr("percentile_disc(0.5) within group (order by prob)").alias("prob"))


def tta_majority(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-hot of the class most runs vote for; ties go to the smallest class, in a run and over runs."""
    n_classes = df.groupBy(*by).agg(F.max("cls").alias("_last"))
    vote = df.groupBy(*by, "run").agg(F.max_by("cls", F.struct(F.col("prob"), -F.col("cls"))).alias("cls"))
    tally = vote.groupBy(*by, "cls").agg(F.count("*").alias("_n"))
    winner = tally.groupBy(*by).agg(F.max_by("cls", F.struct(F.col("_n"), -F.col("cls"))).alias("_win"))
    return (
        winner.join(n_classes, list(by))
        .withColumn("cls", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .select(*by, "cls", F.when(F.col("cls") == F.col("_win"), 1.0).otherwise(0.0).alias("prob"))
    )


def aggregate_runs(df: DataFrame, by: Sequence[str], method: str = "mean") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown aggregation method {method}")
    return {"mean": tta_mean, "median": tta_median, "majority": tta_majority}[method](df, by)


def scans_by_runs(scans: DataFrame, runs: int) -> DataFrame:
    """Every scan once per run 0..runs-1, row by row without a join."""
    return scans.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


# fixed values: measure columns of the comparison table
MEASURES = {
    "accuracy": "Accuracy",
    "roc_auc": "ROC_AUC",
    "pr_auc": "PR_AUC",
    "macro_f1": "Macro_F1",
    "balanced_accuracy": "Balanced_Accuracy",
    "sensitivity": "Sensitivity",
    "specificity": "Specificity",
}


def tta_comparison(baseline: DataFrame, augmented: DataFrame, by: Sequence[str], latency: str) -> DataFrame:
    """Rows Baseline and TTA per group, seven measures and the latency; missing measures are 0."""
    def row(df: DataFrame, mode: str) -> DataFrame:
        return df.select(
            *by,
            F.lit(mode).alias("Mode"),
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(n) for c, n in MEASURES.items()],
            F.col(latency).alias("Latency_sec"),
        )

    return row(baseline, "Baseline").unionByName(row(augmented, "TTA"))


def tta_deltas(comparison: DataFrame, by: Sequence[str]) -> DataFrame:
    """TTA minus Baseline for every measure, and for the latency."""
    pick = lambda c, mode: F.max(F.when(F.col("Mode") == mode, F.col(c)))
    cols = {c: n for c, n in MEASURES.items()} | {"latency": "Latency_sec"}
    return comparison.groupBy(*by).agg(
        *[(pick(n, "TTA") - pick(n, "Baseline")).alias(f"{c}_delta") for c, n in cols.items()]
    )

