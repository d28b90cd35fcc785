"""Class counts, weights and balance tables of cohorts, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """N / (K * n_c) per class; counts shrink to K rows before the window."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    total, k = F.sum("_n").over(w), F.count("*").over(w)
    return counts.select(*by, label, (total / (k * F.col("_n"))).alias("weight"))


def imbalance_ratio(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg((F.max("_n") / F.greatest(F.min("_n"), F.lit(1))).alias("imbalance"))


def class_balance(df: DataFrame, label: str, keep_null: bool = False) -> DataFrame:
    """Rows per class; null labels are dropped, or counted as Unknown."""
    labelled = df.withColumn(label, F.coalesce(label, F.lit("Unknown"))) if keep_null else df.where(
        F.col(label).isNotNull()
    )
    return labelled.groupBy(label).agg(F.count("*").alias("n"))


def with_label(members: DataFrame, cohort: DataFrame, subject: str, label: str) -> DataFrame:
    """Look up each member's class; a subject without one is Unknown."""
    labels = cohort.groupBy(subject).agg(F.max(label).alias(label))
    return members.join(labels, subject, "left").withColumn(label, F.coalesce(label, F.lit("Unknown")))


def membership_balance(members: DataFrame, cohort: DataFrame, by: Sequence[str], subject: str, label: str) -> DataFrame:
    """Per ``by`` group (split, or fold and role): class, n and the group's total."""
    counts = with_label(members, cohort, subject, label).groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))


def count_where(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def histogram(name: str, is_level: Column, key: Column, n: str = "n") -> Column:
    """Map column from the rows of one grouping set."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(is_level, F.struct(key.alias("k"), F.col(n).alias("v")))))).alias(name)


def at_total(total: Column, column: str) -> Column:
    """Value of the one row of the empty grouping set."""
    return F.max(F.when(total, F.col(column))).alias(column)


def cohort_statistics(index: DataFrame) -> DataFrame:
    """One row: scans, subjects, per-diagnosis and per-sex counts, mean age, site histogram.

    Rows are counted by site in the map tasks; the totals are sums over sites.  Distinct subjects are counted by themselves,
    so that no row is copied for each grouping set.
    """
    site = F.coalesce(F.col("site").cast("string"), F.lit("Unknown"))
    counted = {
        "total_mri_scans": F.count("*"), "asd_count": count_where(F.col("label") == "ASD"), "control_count": count_where(F.col("label") == "CONTROL"),
        "male_count": count_where(F.col("sex") == "Male"), "female_count": count_where(F.col("sex") == "Female"),
        "_ages": F.count("age"), "_age": F.sum("age"),
    }
    sites = index.groupBy(site.alias("_site")).agg(*[c.alias(n) for n, c in counted.items()])
    subjects = index.agg(F.countDistinct("subject_id").alias("indexed_subjects"))
    both = sites.unionByName(subjects, allowMissingColumns=True)
    sums = {n: F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in counted if not n.startswith("_")}
    sums["indexed_subjects"] = F.max("indexed_subjects").alias("indexed_subjects")
    order = ["total_mri_scans", "indexed_subjects", "asd_count", "control_count", "male_count", "female_count"]
    return both.agg(
        *[sums[n] for n in order], F.coalesce(F.try_divide(F.sum("_age"), F.sum("_ages")), F.lit(0.0)).alias("mean_age"),
        histogram("site_distribution", F.col("_site").isNotNull(), F.col("_site"), "total_mri_scans"),
    )


def dataset_summary(index: DataFrame, name: str) -> DataFrame:
    """One row: name, files, distinct subjects, class distribution (null labels left out)."""
    sets = index.groupingSets([["label"], []], "label").agg(
        F.grouping_id().alias("_level"), F.count("*").alias("total_files"), F.countDistinct("subject_id").alias("unique_subjects")
    )
    total = F.col("_level") == 1
    return sets.agg(
        *[F.coalesce(at_total(total, c), F.lit(0).cast("bigint")).alias(c) for c in ("total_files", "unique_subjects")],
        histogram("class_distribution", ~total & F.col("label").isNotNull(), F.col("label"), "total_files"),
    ).select(F.lit(name).alias("dataset_name"), "total_files", "unique_subjects", "class_distribution")
