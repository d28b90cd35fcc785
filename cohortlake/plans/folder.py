"""Audit of a folder of scans as one plan: find the scans, read every file once, judge it, roll the judgements up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import paths as P
from cohortlake.functions.formats import detect_format
from cohortlake.operators import audit
from cohortlake.operators.volumes.stats import verdict
from cohortlake.session import file_exists, file_system, materialised, small_files
from cohortlake.sources import files as file_source

# pictures by extension, in either case
PICTURES = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"
# all scan files (paths.SCAN_EXTENSIONS), likewise
SCANS = "*.{[nN][iI][iI],[nN][iI][iI].[gG][zZ],[dD][cC][mM],[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"
SCHEME = "^[A-Za-z][A-Za-z0-9.+-]*:/+"
# fixed value: patient of scans whose format names none
ANONYMOUS = "Anonymous_Patient"


def _below(spark: SparkSession, root: str) -> Column:
    """``path`` relative to the root.

    File sources spell a path with one slash or three behind its scheme, so scheme and slashes take no part.
    """
    fs, at = file_system(spark, root)
    base = re.sub(SCHEME, "/", fs.makeQualified(at).toString()).rstrip("/")
    bare = F.regexp_replace("path", SCHEME, "/")
    return F.substring(bare, F.lit(len(base) + 2), F.length(bare))


def audited_scans(spark: SparkSession, root: str) -> DataFrame:
    """One row per scan below ``root``: where it lies, what its header says, whether it is whole, its errors and the verdict.

    path (relative), kind, format, subject, class, dims, spacing, patient_id, manufacturer, error, errors, valid.

    Names alone decide which files are scans, so other files are never read.  Scan files are read once, in the task
    that gets the file, and leave it as one narrow row, which is stored; discovery and verdicts read these rows.  Only pictures are read
    a second time, by Spark's image source, which decodes them.  A
    folder of .dcm files is one scan; its slices are not decoded, so it is judged by the preambles of all its files and has no
    dimensions.  Files of no bytes are not listed, as Spark's file sources pass over them.  The rows are stored, so reports over them read no file again.
    """
    if not file_exists(spark, root):
        raise ValueError(f"no folder to audit: {root}")
    rel = _below(spark, root)
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SCANS).load(root)
    fmt = detect_format(F.col("content"), P.basename(F.col("path")))
    # by content: a .dcm file without the preamble has its format from its name only
    whole = F.coalesce(detect_format(F.col("content"), F.lit("")) == "dicom", F.lit(False))
    kinds = named.select(rel.alias("path"), fmt.alias("format"), whole.alias("whole"), F.when(fmt == "nifti", F.col("content")).alias("content"))
    # the image source spells paths as URIs, with escapes
    plain = F.url_decode(F.replace("scan_id", F.lit("+"), F.lit("%2B")))
    with small_files(spark):
        files = materialised(file_source.judged(kinds, "format", "whole"), "folder-files")
        pictures = materialised(file_source.judged_images(spark, root, PICTURES).withColumn("path", plain).select(
            rel.alias("path"), F.col("shape").alias("dims"), "intensity_valid",
        ), "folder-pictures")
    found = file_source.discover_scans(files.select("path"))
    volumes = files.where("format = 'nifti'").select(
        "path", "format", F.col("shape").alias("dims"), "spacing", F.col("error").isNull().alias("readable"),
        "intensity_valid", "empty_slices_detected", "error",
    )
    # a picture that the source could not decode has a name and a format, but no pixels
    drawn = files.where("format = 'image'").select("path", "format").join(pictures, "path", "left").select(
        "path", "format", "dims", F.array(*[F.lit(1.0)] * 3).alias("spacing"), F.col("dims").isNotNull().alias("readable"), "intensity_valid",
        F.when(F.col("dims").isNotNull(), F.lit(False)).alias("empty_slices_detected"),
        F.when(F.col("dims").isNull(), F.lit("ValueError: the picture cannot be decoded")).alias("error"),
    )
    owner = F.when(F.col("path").endswith(".dcm"), P.parent(F.col("path"))).otherwise(F.col("path"))
    series = files.where("format = 'dicom'").select(owner.alias("path"), "whole").groupBy("path").agg(F.bool_and("whole").alias("readable"))
    slices = series.select(
        "path", F.lit("dicom").alias("format"), F.lit(None).cast("array<int>").alias("dims"), F.lit(None).cast("array<double>").alias("spacing"),
        "readable", F.when(F.col("readable"), F.lit(True)).alias("intensity_valid"),
        F.when(F.col("readable"), F.lit(False)).alias("empty_slices_detected"),
        F.when(~F.col("readable"), F.lit("ValueError: a slice has no DICOM preamble")).alias("error"),
    )
    judged = volumes.unionByName(drawn).unionByName(slices)
    met = found.join(judged, "path")
    checks = met.withColumns({
        "exists": F.lit(True),
        "voxel_spacing_valid": F.when(F.col("readable"), F.coalesce(F.forall("spacing", lambda v: v > 0), F.lit(True))),
        "dimensions_valid": F.when(F.col("readable"), F.coalesce(F.size("dims").isin(2, 3) | F.col("dims").isNull(), F.lit(True))),
    })
    rows = verdict(checks).select(
        "path", "kind", "format", P.folder_subject(F.col("path")).alias("subject"), P.path_class(F.col("path")).alias("class"), "dims", "spacing",
        F.when(F.col("format") != "dicom", ANONYMOUS).alias("patient_id"), F.lit(None).cast("string").alias("manufacturer"),
        "error", "errors", F.col("is_valid").alias("valid"),
    )
    return materialised(rows, "folder-audit")


def folder_report(scans: DataFrame) -> DataFrame:
    """The report of :func:`audit.audit_report` over audited scans; the broken ones are :func:`audit.corrupt_files`."""
    return audit.audit_report(scans)
