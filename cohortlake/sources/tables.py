"""Tabular sources: phenotype CSV, cohort index, split and fold files, run documents, fold predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.session import file_exists
from cohortlake.operators.cohort import OPTIONAL_PHENOTYPE, REQUIRED_PHENOTYPE, check_phenotype_columns

INDEX_SCHEMA = (
    "subject_id string, site string, path string, label string, age double, sex string, fiq double, viq double, "
    "piq double, dataset string, modality string, scanner_site string, channels map<string,string>, mask string"
)
PREDICTION_SCHEMA = (
    "Subject string, True_Label string, Pred_Label string, Probability_ASD double, Probability_Control double, "
    "Logit_ASD double, Logit_Control double, Correct boolean"
)


def read_phenotype(spark: SparkSession, path: str) -> DataFrame:
    """Phenotype CSV as text cells plus ``row_no``, the position in the file that settles duplicates.

    Positions order rows inside and across the splits of a file, because splits are planned in file order.
    """
    raw = check_phenotype_columns(spark.read.csv(path, header=True))
    known = [c for c in REQUIRED_PHENOTYPE + OPTIONAL_PHENOTYPE if c in raw.columns]
    code = lambda c: F.col(c).try_cast("double").cast("int").alias(c)
    return raw.select(
        *[code(c) if c in ("DX_GROUP", "SEX") else F.col(c) for c in known],
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("row_no"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Cohort index JSON (an array of records)."""
    return spark.read.schema(INDEX_SCHEMA).json(path, multiLine=True)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``{split: [subject]}`` JSON -> (subject_id, split)."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return doc.select(F.explode("m").alias("split", "s")).select(F.explode("s").alias("subject_id"), "split")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """``[{train: [...], val: [...]}]`` JSON -> (subject_id, fold, role)."""
    doc = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "array<map<string,array<string>>>").alias("folds")
    )
    roles = doc.select(F.posexplode("folds").alias("fold", "m")).select("fold", F.explode("m").alias("role", "s"))
    return roles.select(F.explode("s").alias("subject_id"), "fold", "role")


def read_run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<run>/experiment_meta.json`` files -> (run, doc)."""
    files = spark.read.text(f"{root}/*/experiment_meta.json", wholetext=True)
    run = F.regexp_extract(F.input_file_name(), r"([^/]+)/experiment_meta\.json$", 1)
    return files.select(run.alias("run"), F.col("value").alias("doc"))


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    """Many run documents kept as (run, doc) rows rather than one small file each."""
    return spark.read.schema("run string, doc string").parquet(path)


def read_fold_predictions(spark: SparkSession, root: str, folds: int | None = None) -> DataFrame:
    """``<root>/fold_<i>/predictions.csv`` files in one table with ``Fold``.

    With the number of ``folds`` the listing is checked: missing folds are an error that names them.
    """
    if folds is not None:
        missing = [i for i in range(folds) if not file_exists(spark, f"{root.rstrip('/')}/fold_{i}/predictions.csv")]
        if missing:
            raise ValueError(f"no predictions for folds {', '.join(map(str, missing))}")
    df = spark.read.csv(f"{root}/fold_*/predictions.csv", header=True, schema=PREDICTION_SCHEMA)
    return df.withColumn("Fold", F.regexp_extract(F.input_file_name(), r"fold_(\d+)/", 1).cast("int"))


def read_cache_meta(spark: SparkSession, path: str) -> DataFrame:
    """One-row fingerprint of a preprocessed cache."""
    schema = "pipeline_hash string, git_commit string, target_shape array<int>, dataset string, created_at string, n4 string"
    return spark.read.schema(schema).json(path, multiLine=True)
