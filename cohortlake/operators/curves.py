"""ROC and precision-recall curves, AUC and average precision.

Rows collapse to one per distinct score first; ranks then come from bucketed
running sums, so neither ties nor continuous scores put a run into one task.
``by`` names at least one column (a run, a fold); give a single run a literal one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.ordered import running, value_edges, with_value_bucket

STEP = ("pos", "neg")


def score_table(
    df: DataFrame, by: Sequence[str], y: str, score: str, edges: list[float] | None = None
) -> DataFrame:
    """Per distinct score: pos, neg; tp / fp = counts at this score or above; n_pos / n_neg = group totals.

    ``above`` and ``below`` hold the (pos, neg) of the next higher and next lower score.  ``edges``
    from a cheaper table with the same scores save a pass over ``df``.
    """
    edges = value_edges(df, score) if edges is None else edges
    tied = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    return running(
        with_value_bucket(tied, "score", edges),
        by,
        "_bucket",
        ["score"],
        {"tp": (F.sum, F.col("pos")), "fp": (F.sum, F.col("neg"))},
        descending=True,
        totals={"n_pos": F.col("pos"), "n_neg": F.col("neg")},
        previous={"above": F.struct(*STEP)},
        following={"below": F.struct(*STEP)},
    )


def _rate(a: str, b: str):
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def ranking_columns(undefined: float = 0.5) -> list:
    """Aggregates over a score table: ``roc_auc`` (tie-corrected) and ``pr_auc`` (average precision).

    Each distinct score loses pos * (negatives above + half of the tied ones) from the rank
    statistic, and adds its recall step times the precision reached to the average precision.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    both = (n_pos > 0) & (n_neg > 0)
    lost = F.sum(pos * (F.col("fp") - neg / 2))
    hits = F.sum(pos * F.col("tp") / (F.col("tp") + F.col("fp")))
    return [
        F.when(both, 1.0 - F.try_divide(lost, n_pos * n_neg)).otherwise(undefined).alias("roc_auc"),
        F.when(both, F.try_divide(hits, n_pos)).otherwise(undefined).alias("pr_auc"),
    ]


def ranking_scores(df: DataFrame, by: Sequence[str], y: str, score: str, undefined: float = 0.5) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` per group; 0.5 where the truth holds one class."""
    return score_table(df, by, y, score).groupBy(*by).agg(*ranking_columns(undefined))


def roc_auc(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    return ranking_scores(df, by, y, score).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    return ranking_scores(df, by, y, score).select(*by, "pr_auc")


def roc_auc_ovr(df: DataFrame, by: Sequence[str], y: str, scores: dict[int, str]) -> DataFrame:
    """Unweighted mean over classes of one-vs-rest AUC; ``scores`` maps class -> score column."""
    long = df.select(
        *by,
        F.col(y).alias("_y"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).alias("score")) for k, c in scores.items()])
        ).alias("s"),
    ).select(*by, "s.cls", "s.score", (F.col("_y") == F.col("s.cls")).cast("int").alias("hit"))
    return roc_auc(long, [*by, "cls"], "hit", "score").groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"))


def roc_points(df: DataFrame, by: Sequence[str], y: str, score: str, drop_collinear: bool = True) -> DataFrame:
    """(threshold, tpr, fpr) by falling threshold, opened by (inf, 0, 0).

    A point stays if the step into it differs from the step out of it, or if it is an end of the curve.
    """
    table = score_table(df, by, y, score)
    top, end = F.col("above").isNull(), F.col("below").isNull()
    if drop_collinear:
        table = table.where(top | end | (F.struct(*STEP) != F.col("below")))
    point = F.struct(
        F.col("score").alias("threshold"), _rate("tp", "n_pos").alias("tpr"), _rate("fp", "n_neg").alias("fpr")
    )
    origin = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    rows = F.when(top, F.array(origin, point)).otherwise(F.array(point))
    return table.select(*by, F.explode(rows).alias("p")).select(*by, "p.*")


def pr_points(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the closing (null, 1, 0)."""
    table = score_table(df, by, y, score)
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(_rate("tp", "n_pos"), F.lit(1.0)).alias("recall"),
    )
    closing = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    rows = F.when(F.col("above").isNull(), F.array(closing, point)).otherwise(F.array(point))
    return table.select(*by, F.explode(rows).alias("p")).select(*by, "p.*")


def trapezoid_auc(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under ROC points from :func:`roc_points` by the trapezoid rule."""
    finite = points.where(F.col("threshold") < float("inf"))
    steps = running(
        with_value_bucket(finite, "threshold", value_edges(finite, "threshold")), by, "_bucket", ["threshold"], {},
        descending=True, previous={"_from": F.struct("fpr", "tpr")},
    )
    x, h = F.coalesce(F.col("_from.fpr"), F.lit(0.0)), F.coalesce(F.col("_from.tpr"), F.lit(0.0))
    return steps.groupBy(*by).agg(F.sum((F.col("fpr") - x) * (F.col("tpr") + h) / 2).alias("auc"))
