"""Classification metrics as grouped counts; ``by`` columns evaluate many runs or folds in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Non-empty cells (by, y, pred, n); every metric below reads only these few rows."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """All K x K cells over the labels seen as truth or prediction, zeros included."""
    labels = cells.groupBy(*by).agg(
        F.array_distinct(F.concat(F.collect_set("y"), F.collect_set("pred"))).alias("_l")
    )
    grid = labels.withColumn("y", F.explode("_l")).withColumn("pred", F.explode("_l")).drop("_l")
    return grid.join(cells, [*by, "y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class: tp, predicted, support, precision, recall, f1 (0 where undefined)."""
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("y").alias("label"),
                    F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.col("n").alias("support"),
                ),
                F.struct(
                    F.col("pred").alias("label"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("support"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    return sums.select(
        "*",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def accuracy(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.groupBy(*by).agg(
        ratio(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy")
    )


def precision_recall_f1(cells: DataFrame, by: Sequence[str], positive: int = 1) -> DataFrame:
    """Binary scores of ``positive`` when at most two true classes exist, macro means otherwise."""
    per_class = class_scores(cells, by)
    names = ("precision", "recall", "f1")
    picked = [
        F.when(
            F.count_if(F.col("support") > 0) <= 2,
            F.coalesce(F.max(F.when(F.col("label") == positive, F.col(m))), F.lit(0.0)),
        ).otherwise(F.avg(m)).alias(m)
        for m in names
    ]
    return per_class.groupBy(*by).agg(*picked)


def balanced_accuracy(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    return (
        class_scores(cells, by).where("support > 0").groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))
    )


def sensitivity_specificity(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Binary TP/(TP+FN) and TN/(TN+FP); both 0 when the truth holds one class only."""
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("pred") == p), F.col("n")).otherwise(0))
    sums = cells.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp")
    )
    both = ((F.col("tp") + F.col("fn")) > 0) & ((F.col("tn") + F.col("fp")) > 0)
    return sums.select(
        *by,
        F.when(both, ratio(F.col("tp"), F.col("tp") + F.col("fn"))).otherwise(0.0).alias("sensitivity"),
        F.when(both, ratio(F.col("tn"), F.col("tn") + F.col("fp"))).otherwise(0.0).alias("specificity"),
    )


def classification_report(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows: one per class, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    per_class = class_scores(cells, by)
    cols = ("precision", "recall", "f1")
    line = lambda name, values, support: F.struct(
        name.alias("label"), *[v.cast("double").alias(c) for c, v in zip(cols, values)], support.cast("bigint").alias("support")
    )
    total = F.sum("support")
    right = ratio(F.sum("tp"), total)
    # the rows of the (few) classes and their summaries come from one aggregate
    whole = per_class.groupBy(*by).agg(
        F.collect_list(line(F.col("label").cast("string"), [F.col(c) for c in cols], F.col("support"))).alias("rows"),
        line(F.lit("accuracy"), [right] * 3, total).alias("overall"),
        line(F.lit("macro avg"), [F.avg(c) for c in cols], total).alias("macro"),
        line(F.lit("weighted avg"), [ratio(F.sum(F.col(c) * F.col("support")), total) for c in cols], total).alias("weighted"),
    )
    return whole.select(*by, F.inline(F.concat("rows", F.array("overall", "macro", "weighted"))))


def binary_summary(
    df: DataFrame, by: Sequence[str], y: str, score: str, threshold: float = 0.5, edges: list[float] | None = None
) -> DataFrame:
    """One row per group: the seven measures used to compare runs and folds.

    Everything comes from one table of distinct scores: the ranking measures from its running
    counts, the others from its totals on either side of the threshold.
    """
    from cohortlake.operators.curves import ranking_columns, score_table

    high = F.col("score") >= threshold
    side = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    sums = score_table(df, by, y, score, edges).groupBy(*by).agg(
        *ranking_columns(),
        side("pos", high).alias("tp"), side("neg", high).alias("fp"),
        side("pos", ~high).alias("fn"), side("neg", ~high).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, n = tp + fn, tn + fp
    sens, spec = ratio(tp, p), ratio(tn, n)
    # means over the classes that occur: in truth or prediction for F1, in truth for recall
    f1 = F.array(
        F.when(tp + fp + fn > 0, ratio(2 * tp, 2 * tp + fp + fn)), F.when(tn + fp + fn > 0, ratio(2 * tn, 2 * tn + fp + fn))
    )
    recall = F.array(F.when(p > 0, sens), F.when(n > 0, spec))

    def mean(values: Column) -> Column:
        known = F.filter(values, lambda v: v.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)

    both = (p > 0) & (n > 0)
    return sums.select(
        *by, ratio(tp + tn, p + n).alias("accuracy"), "roc_auc", "pr_auc", mean(f1).alias("macro_f1"),
        mean(recall).alias("balanced_accuracy"), F.when(both, sens).otherwise(0.0).alias("sensitivity"),
        F.when(both, spec).otherwise(0.0).alias("specificity"),
    )
