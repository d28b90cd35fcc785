"""Dataset audit: roll scan rows up to one report.

Input rows: path, subject, class, format, valid, spacing array<double>, dims array<int>, patient_id, manufacturer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.balance import at_total, histogram


def valid_scans(scans: DataFrame) -> DataFrame:
    return scans.where(F.col("valid"))


def corrupt_files(scans: DataFrame) -> DataFrame:
    return scans.where(~F.coalesce(F.col("valid"), F.lit(False))).select("path")


def spacing_distribution(scans: DataFrame) -> DataFrame:
    """(axis, min, max, mean) of voxel spacing over valid scans."""
    rows = valid_scans(scans).select(F.posexplode("spacing").alias("axis", "s"))
    return rows.groupBy("axis").agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"))


def distinct_dimensions(scans: DataFrame) -> DataFrame:
    return valid_scans(scans).select("dims").distinct()


def distinct_formats(scans: DataFrame) -> DataFrame:
    return valid_scans(scans).select("format").distinct()


def manufacturer_histogram(scans: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("manufacturer"), F.lit("")), F.lit("Unknown"))
    return valid_scans(scans).groupBy(name.alias("manufacturer")).agg(F.count("*").alias("n"))


def class_counts(scans: DataFrame) -> DataFrame:
    return valid_scans(scans).groupBy("class").agg(F.count("*").alias("n"))


def missing_metadata(scans: DataFrame) -> DataFrame:
    pid = F.coalesce(F.col("patient_id"), F.lit(""))
    return valid_scans(scans).agg(F.count_if(pid.isin("", "Anonymous_Patient")).alias("missing_metadata_count"))


def audit_cells(scans: DataFrame) -> DataFrame:
    """Scans counted by class, manufacturer, format, dimensions and validity, with the sums and extremes that a report needs.

    As many rows as there are combinations; counted in the map tasks, so that what a report expands is small.
    """
    pid = F.coalesce(F.col("patient_id"), F.lit(""))
    made = F.coalesce(F.nullif(F.col("manufacturer"), F.lit("")), F.lit("Unknown"))
    rows = scans.select(
        F.col("class").alias("_class"), made.alias("_made"), "format", "dims", F.coalesce(F.col("valid"), F.lit(False)).alias("_ok"),
        pid.isin("", "Anonymous_Patient").alias("_anonymous"), *[F.col("spacing")[i].alias(f"_s{i}") for i in range(3)],
    )
    return rows.groupBy("_class", "_made", "format", "dims", "_ok").agg(
        F.count("*").alias("_n"), F.count_if("_anonymous").alias("_anon"),
        *[fn(f"_s{i}").alias(f"_{n}{i}") for n, fn in (("min", F.min), ("max", F.max), ("sum", F.sum), ("count", F.count)) for i in range(3)],
    )


def audit_report(scans: DataFrame) -> DataFrame:
    """One row with every rollup.  The corrupt list itself stays a table (:func:`corrupt_files`).

    Totals, classes and manufacturers are grouping sets over :func:`audit_cells`; subjects are counted by themselves.
    """
    lists = {"formats_present": "format", "unique_dimensions": "dims"}
    ok = F.col("_ok")
    of = lambda n, fn, i: fn(F.when(ok, F.col(f"_{n}{i}")))
    sets = audit_cells(scans).groupingSets([["_class"], ["_made"], []], "_class", "_made").agg(
        F.grouping_id().alias("_level"),
        F.sum("_n").alias("total_files"),
        F.coalesce(F.sum(F.when(ok, F.col("_n"))), F.lit(0)).alias("_valid"),
        F.coalesce(F.sum(F.when(~ok, F.col("_n"))), F.lit(0)).alias("corrupt_count"),
        *[F.array_sort(F.collect_set(F.when(ok, F.col(c)))).alias(n) for n, c in lists.items()],
        F.coalesce(F.sum(F.when(ok, F.col("_anon"))), F.lit(0)).alias("missing_metadata_count"),
        *[F.array(*[of(n, fn, i) for i in range(3)]).alias(f"{n}_spacing") for n, fn in (("min", F.min), ("max", F.max))],
        F.array(*[F.try_divide(of("sum", F.sum, i), of("count", F.sum, i)) for i in range(3)]).alias("mean_spacing"),
    )
    subjects = scans.agg(F.countDistinct("subject").alias("total_subjects")).select(F.lit(-1).cast("bigint").alias("_level"), "total_subjects")
    both = sets.withColumn("_level", F.col("_level").cast("bigint")).unionByName(subjects, allowMissingColumns=True)
    total = F.col("_level") == 3
    some = F.col("_valid") > 0
    counts = ["total_files", "corrupt_count", "missing_metadata_count"]
    return both.agg(
        F.max("total_subjects").alias("total_subjects"),
        *[F.coalesce(at_total(total, c), F.lit(0).cast("bigint")).alias(c) for c in counts],
        *[at_total(total, c) for c in (*lists, "min_spacing", "max_spacing", "mean_spacing")],
        histogram("class_balance", (F.col("_level") == 1) & some & F.col("_class").isNotNull(), F.col("_class"), "_valid"),
        histogram("scanner_manufacturers", (F.col("_level") == 2) & some, F.col("_made"), "_valid"),
    )
