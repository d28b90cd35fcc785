"""Sinks: prediction and curve files, comparison tables, trial logs, versioned volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.metadata import decode_label, fixed
from cohortlake.operators.runs import COMPARISON_COLUMNS, upsert_comparison
from cohortlake.session import delete, file_exists, file_system, fresh_path

# fixed values: header of the predictions file
PREDICTION_COLUMNS = [
    "Subject", "True_Label", "Pred_Label", "Probability_ASD", "Probability_Control", "Logit_ASD", "Logit_Control", "Correct",
]


def write_csv(df: DataFrame, name: str, path: str | None = None) -> str:
    path = path or fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").csv(path, header=True)
    return path


def prediction_rows(scored: DataFrame) -> DataFrame:
    """subject, y, pred, probs, logits -> the text columns of the predictions file."""
    right = F.when(F.col("y") == F.col("pred"), "True").otherwise("False")
    cells = [
        F.col("subject").cast("string"), decode_label(F.col("y")), decode_label(F.col("pred")),
        fixed(F.col("probs")[1]), fixed(F.col("probs")[0]), fixed(F.col("logits")[1]), fixed(F.col("logits")[0]), right,
    ]
    return scored.select(*[c.alias(n) for c, n in zip(cells, PREDICTION_COLUMNS)])


def write_predictions(scored: DataFrame, path: str | None = None) -> str:
    return write_csv(prediction_rows(scored), "predictions", path)


def write_curve(points: DataFrame, by: Sequence[str], cols: Sequence[str], path: str | None = None) -> str:
    """Curve points with four decimals; the closing precision-recall point has no threshold and is left out."""
    rows = points.where(F.col("threshold").isNotNull())
    inf = F.col("threshold") == float("inf")
    text = [F.when(inf, "inf").otherwise(fixed(F.col(c))).alias(c) if c == "threshold" else fixed(F.col(c)).alias(c) for c in cols]
    return write_csv(rows.select(*by, *text), "curve", path)


def write_documents(df: DataFrame, name: str, doc: str, path: str | None = None) -> str:
    path = path or fresh_path(df.sparkSession, "documents")
    df.select(F.col(name).alias("run"), F.col(doc).alias("doc")).write.mode("overwrite").parquet(path)
    return path


class ComparisonTable:
    """Comparison rows keyed by Experiment.  Every upsert writes a new version folder, so a failed
    write leaves the last good version readable.  The newest complete version is looked up on storage:
    a table that is opened again goes on from there, and no version is ever overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[tuple[int, bool]]:
        """(number, complete) of the version folders."""
        fs, at = file_system(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return [(n, file_exists(self.spark, f"{self.path}/v{n}/_SUCCESS")) for n in sorted(numbers)]

    @property
    def version(self) -> int:
        return max((n for n, whole in self._versions() if whole), default=0)

    def read(self) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in COMPARISON_COLUMNS)
        version = self.version
        if version == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.csv(f"{self.path}/v{version}", header=True, schema=schema)

    def upsert(self, new: DataFrame) -> None:
        following = 1 + max((n for n, _ in self._versions()), default=0)
        upsert_comparison(self.read(), new).write.mode("error").csv(f"{self.path}/v{following}", header=True)


def write_volumes(slabs: DataFrame, path: str, cache_version: str, clear: bool = False) -> str:
    """Processed slabs under ``cache_version``; other versions are left alone.

    ``clear`` removes the whole version first.  Otherwise only scans that the version lacks are added, so a
    rerun changes nothing.  ``scan_id`` buckets, not scans, are the partition folders, so their count stays bounded.
    """
    spark = slabs.sparkSession
    folder = f"{path.rstrip('/')}/cache_version={cache_version}"
    if clear:
        delete(spark, folder)
    elif file_exists(spark, folder):
        there = spark.read.parquet(folder).select("scan_id").distinct()
        slabs = slabs.join(there, "scan_id", "left_anti")
    out = slabs.withColumn("scan_bucket", F.pmod(F.xxhash64(F.col("scan_id").cast("string")), F.lit(256)).cast("int"))
    out.repartition("scan_bucket", "z").write.mode("append").partitionBy("scan_bucket").parquet(folder)
    return path
