"""Cross-validation reports: out-of-fold assembly and the fold summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: metadata key -> report column
SUMMARY_COLUMNS = {
    "best_val_accuracy": "Accuracy",
    "best_val_roc_auc": "ROC_AUC",
    "best_val_pr_auc": "PR_AUC",
    "best_val_macro_f1": "Macro_F1",
    "best_val_balanced_accuracy": "Balanced_Accuracy",
    "best_val_sensitivity": "Sensitivity",
    "best_val_specificity": "Specificity",
}


def union_folds(folds: dict[int, DataFrame]) -> DataFrame:
    """All fold predictions in one table with a ``Fold`` column (rows are kept, not deduplicated)."""
    if not folds:
        raise ValueError("no fold predictions to assemble")
    return reduce(DataFrame.unionByName, [df.withColumn("Fold", F.lit(i)) for i, df in folds.items()])


def cv_summary(per_fold: DataFrame, metrics: list[str], fold: str = "Fold") -> DataFrame:
    """Fold rows plus ``Mean`` and ``Std`` rows (sample deviation, null for a single fold).

    The (few) fold rows are gathered by the aggregate that also gives the two summary rows, so the folds
    are worked out once.
    """
    rows = per_fold.select(
        F.col(fold).cast("string").alias("Fold"), *[F.coalesce(F.col(m), F.lit(0.0)).cast("double").alias(m) for m in metrics]
    )
    line = lambda name, values: F.struct(name.alias("Fold"), *[v.alias(m) for v, m in zip(values, metrics)])
    whole = rows.agg(
        F.collect_list(line(F.col("Fold"), [F.col(m) for m in metrics])).alias("rows"),
        line(F.lit("Mean"), [F.avg(m) for m in metrics]).alias("mean"),
        line(F.lit("Std"), [F.stddev_samp(m) for m in metrics]).alias("std"),
    )
    return whole.select(F.inline(F.concat("rows", F.array("mean", "std"))))


def report_from_documents(docs: DataFrame, folds: int) -> DataFrame:
    """Fold documents (run, doc: JSON metadata of one fold) -> the report of :func:`cv_summary`.

    The fold is the number at the end of ``run``.  An absent metric is 0; a document that cannot be parsed
    is skipped.  Missing folds are an error that names them, as is a table without any.
    """
    from cohortlake.operators.runs import meta_get, parse_metadata

    number = F.regexp_extract("run", "([0-9]+)$", 1).try_cast("int")
    read = parse_metadata(docs.select("run", "doc")).where(F.col("meta").isNotNull()).withColumn("Fold", number)
    rows = read.select("Fold", *[meta_get([k], 0.0).alias(c) for k, c in SUMMARY_COLUMNS.items()])
    found = {r[0] for r in rows.select("Fold").distinct().collect()}  # at most as many as there are folds
    missing = sorted(set(range(folds)) - found)
    if missing:
        raise ValueError(f"no predictions for folds {', '.join(map(str, missing))}")
    return cv_summary(rows, list(SUMMARY_COLUMNS.values()))
