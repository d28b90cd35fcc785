"""Cohort compilation: validate an index, split it, fold it, summarise it, write the four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlake.operators.balance import cohort_statistics, membership_balance
from cohortlake.operators.cohort import validate_index
from cohortlake.operators.splits import expand_folds, stratified_kfold, stratified_split


def compile_cohort(index: DataFrame, out: str, folds: int = 5, seed: int = 42) -> dict[str, str]:
    """Write index, splits, folds and statistics below ``out``; returns their paths.

    The validated index is written first and read back, so the later steps neither redo the
    joins behind it nor depend on them.
    """
    spark = index.sparkSession
    paths = {n: f"{out}/{n}" for n in ("index", "splits", "folds", "statistics", "split_balance", "fold_balance")}
    index.write.mode("overwrite").parquet(paths["index"])
    stored = validate_index(spark.read.parquet(paths["index"]))
    subjects = stored.select("subject_id", "label")
    stratified_split(subjects, "subject_id", "label", seed=seed).write.mode("overwrite").parquet(paths["splits"])
    assigned = stratified_kfold(subjects, "subject_id", "label", folds, seed)
    expand_folds(assigned, "subject_id", folds).write.mode("overwrite").parquet(paths["folds"])
    splits, roles = spark.read.parquet(paths["splits"]), spark.read.parquet(paths["folds"])
    cohort_statistics(stored).write.mode("overwrite").parquet(paths["statistics"])
    membership_balance(splits.drop("label"), subjects, ["split"], "subject_id", "label").write.mode(
        "overwrite"
    ).parquet(paths["split_balance"])
    membership_balance(roles, subjects, ["fold", "role"], "subject_id", "label").write.mode("overwrite").parquet(
        paths["fold_balance"]
    )
    return paths
