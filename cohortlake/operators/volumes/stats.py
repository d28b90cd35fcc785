"""Volume statistics: moments, slices, contrast, blur, slice gaps, foreground box, quality, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.volumes import summary
from cohortlake.operators.volumes.slabs import scans_of, voxels


def volume_statistics(slabs: DataFrame) -> DataFrame:
    """scan_id, min, max, mean, std (population).  Partial sums per task; only those are shuffled."""
    v = slabs.select("scan_id", F.explode("px").alias("v"))
    return v.groupBy("scan_id").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def shape_text(slabs: DataFrame) -> DataFrame:
    """scan_id, shape ([x, y, z]) and dtype name."""
    kind = {"array<float>": "float32", "array<double>": "float64"}.get(dict(slabs.dtypes)["px"], "other")
    return scans_of(slabs, "nx", "ny", "nz").select("scan_id", F.array("nx", "ny", "nz").alias("shape"), F.lit(kind).alias("dtype"))


def slice_statistics(slabs: DataFrame) -> DataFrame:
    """mean, min and max per slice, row by row."""
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    return slabs.select(
        "scan_id", "c", "z", "nz", (total / F.size("px")).alias("mean"),
        F.array_min("px").alias("min"), F.array_max("px").alias("max"),
    )


def signal_range(stats: DataFrame) -> DataFrame:
    """dynamic_range and snr (0 for a flat volume) from :func:`volume_statistics`."""
    snr = F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0)
    return stats.select("scan_id", (F.col("max") - F.col("min")).alias("dynamic_range"), snr.alias("snr"))


def tissue_contrast(slabs: DataFrame, exact: bool = True) -> DataFrame:
    """(p90 - p10) / (p90 + p10 + 1e-5) over positive voxels; 0 where there are none."""
    if exact:
        return summary.contrast_of(slabs, summary.slice_summaries(slabs, positive=True))
    bright = slabs.select("scan_id", F.explode("px").alias("v")).where("v > 0")
    p = bright.groupBy("scan_id").agg(
        F.percentile_approx("v", 0.1).alias("p10"), F.percentile_approx("v", 0.9).alias("p90")
    )
    ratio = (F.col("p90") - F.col("p10")) / (F.col("p90") + F.col("p10") + 1e-5)
    return scans_of(slabs).join(p.select("scan_id", ratio.alias("contrast")), "scan_id", "left").fillna(0.0, ["contrast"])


def to_grey(px: Column) -> Column:
    """Scale to 0..255 and truncate; a flat slice becomes zeros."""
    lo, hi = F.array_min(px), F.array_max(px)
    return F.transform(
        px, lambda v: F.when(hi == lo, 0).otherwise(F.floor(F.try_divide(v - lo, hi - lo) * 255.0)).cast("int")
    )


def blur_index(slabs: DataFrame) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian of the central slice, borders mirrored; 0 if flat."""
    mid = F.when(F.col("nz") > 1, F.floor(F.col("nz") / 2)).otherwise(0)
    grey = slabs.where((F.col("c") == 0) & (F.col("z") == mid)).select("scan_id", "nx", "ny", to_grey(F.col("px")).alias("g"))
    n = F.col("nx") * F.col("ny")

    def mirrored(i: Column, size: Column) -> Column:
        return F.when(size == 1, 0).when(i < 0, 1).when(i >= size, size - 2).otherwise(i)

    def at(x: Column, y: Column) -> Column:
        return F.get("g", (mirrored(x, F.col("nx")) * F.col("ny") + mirrored(y, F.col("ny"))).cast("int"))

    def laplacian(i: Column) -> Column:
        x, y = F.floor(i / F.col("ny")), i % F.col("ny")
        return (at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) - 4 * F.get("g", i)).cast("double")

    lap = grey.select("scan_id", n.alias("n"), F.transform(F.sequence(F.lit(0), n - 1), laplacian).alias("l"))
    total = lambda f: F.aggregate("l", F.lit(0.0), lambda a, v: a + f(v))
    mean = total(lambda v: v) / F.col("n")
    return lap.select("scan_id", (total(lambda v: v * v) / F.col("n") - mean * mean).alias("blur"))


def slice_differences(slabs: DataFrame) -> DataFrame:
    """|mean(z) - mean(z-1)| of channel 0; a group is the slice count of one scan, one number each."""
    return _differences(slice_statistics(slabs.where("c = 0")))


def _differences(means: DataFrame) -> DataFrame:
    w = Window.partitionBy("scan_id").orderBy("z")
    return means.select("scan_id", "z", "nz", F.abs(F.col("mean") - F.lag("mean").over(w)).alias("diff")).where(
        "diff IS NOT NULL"
    )


def slice_gaps(slabs: DataFrame, factor: float = 8.0, at_least: int = 5) -> DataFrame:
    """missing_slices: a jump above ``factor`` times the median jump, for volumes of enough slices."""
    return _gaps(scans_of(slabs), slice_differences(slabs), factor, at_least)


def _gaps(scans: DataFrame, differences: DataFrame, factor: float = 8.0, at_least: int = 5) -> DataFrame:
    d = differences.groupBy("scan_id").agg(
        F.max("diff").alias("top"), F.median("diff").alias("mid"), F.first("nz").alias("nz")
    )
    gap = (F.col("nz") >= at_least) & (F.col("mid") != 0) & (F.col("top") > factor * F.col("mid"))
    return scans.join(d.select("scan_id", gap.alias("missing_slices")), "scan_id", "left").fillna(False, ["missing_slices"])


def foreground_box(slabs: DataFrame) -> DataFrame:
    """Index range of non-zero voxels (any channel) per axis: x0..x1, y0..y1, z0..z1."""
    v = voxels(slabs).where("v <> 0")
    return v.groupBy("scan_id").agg(
        *[f(a).alias(f"{a}{i}") for a in ("x", "y", "z") for i, f in ((0, F.min), (1, F.max))]
    )


def resolution(spacing: Column) -> Column:
    size = spacing[0] * spacing[1] * spacing[2]
    return F.when(size > 0, F.try_divide(F.lit(1.0), size)).otherwise(0.0)


def overall_quality(snr: Column, blur: Column, motion: Column, contrast: Column) -> Column:
    """Weighted score in [0, 1]: signal .3, sharpness .3, stillness .2, contrast .2."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    score = (
        F.least(snr / 20.0, F.lit(1.0)) * 0.3 + F.least(blur / 500.0, F.lit(1.0)) * 0.3
        + F.greatest(1.0 - motion, F.lit(0.0)) * 0.2 + unit(contrast) * 0.2
    )
    return unit(score)


def quality_report(slabs: DataFrame, spacing: DataFrame, motion: float = 0.15) -> DataFrame:
    """All quality measures per scan; ``spacing`` holds scan_id and spacing array<double>.

    The voxels are read twice: once for a summary of every slice, from which all else follows, and once for the
    values of the bins in which the two percentiles of the contrast lie.
    """
    slices = summary.slice_summaries(slabs, positive=True, blur=True)
    parts = slices.groupBy("scan_id").agg(F.first("nz").alias("slice_count"), F.max("blur").alias("blur"))
    gaps = _gaps(parts.select("scan_id"), _differences(slices.where("c = 0")))
    for p in (signal_range(summary.moments(slices)), summary.contrast_of(slabs, slices), gaps, spacing):
        parts = parts.join(p, "scan_id", "left")  # a scan whose central slice is missing has no blur
    parts = parts.fillna(0.0, ["blur"])
    return parts.select(
        "scan_id", F.col("snr").alias("noise_score"), F.col("blur").alias("blur_score"),
        F.lit(motion).alias("motion_score"), F.col("contrast").alias("contrast_score"), "dynamic_range",
        resolution(F.col("spacing")).alias("resolution"), "slice_count", "missing_slices",
        F.lit(motion > 0.7).alias("has_artifacts"),
        overall_quality(F.col("snr"), F.col("blur"), F.lit(motion), F.col("contrast")).alias("overall_score"),
    )


# fixed values: messages in reporting order
ERRORS = {
    "exists": "File does not exist on disk.",
    "readable": "File exists but is not readable (permissions error).",
    "voxel_spacing_valid": "Invalid or negative voxel spacing dimensions detected.",
    "dimensions_valid": "MRI shape dimensions do not meet requirements.",
    "intensity_valid": "Constant or flat voxel intensities detected.",
    "no_empty_slices": "Blank zero-intensity slice volumes detected inside scan.",
}


def volume_checks(slabs: DataFrame, info: DataFrame) -> DataFrame:
    """Validity flags per scan.  ``info``: scan_id, spacing, n_dims, patient_id, orientation."""
    s = slice_statistics(slabs)
    per = s.groupBy("scan_id").agg(
        (F.max("max") > F.min("min")).alias("intensity_valid"),
        ((F.first("nz") > 1) & F.bool_or(F.col("max") == F.col("min"))).alias("empty_slices_detected"),
    )
    return info.join(per, "scan_id").select(
        "scan_id",
        F.forall("spacing", lambda v: v > 0).alias("voxel_spacing_valid"),
        F.col("n_dims").isin(2, 3).alias("dimensions_valid"),
        "intensity_valid",
        F.col("orientation").isNotNull().alias("orientation_valid"),
        (F.coalesce("patient_id", F.lit("")) != "").alias("metadata_complete"),
        "empty_slices_detected",
    )


def verdict(checks: DataFrame) -> DataFrame:
    """Ordered error list and is_valid.  Rows that never loaded (null flags) carry file errors only and are invalid."""
    loaded = F.col("intensity_valid").isNotNull()
    flags = {**{k: F.col(k) for k in ERRORS if k != "no_empty_slices"}, "no_empty_slices": ~F.col("empty_slices_detected")}
    listed = F.filter(
        F.array(*[F.when(~flags[k], F.lit(msg)) for k, msg in ERRORS.items()]), lambda m: m.isNotNull()
    )
    return checks.withColumn("errors", listed).withColumn("is_valid", loaded & (F.size("errors") == 0))


def otsu_threshold(slabs: DataFrame, bins: int = 128) -> DataFrame:
    """Per scan the histogram threshold with the largest between-class variance (upper edge of its bin).

    Voxels shrink to at most ``bins`` counts per scan in the map tasks.
    """
    stats = slabs.groupBy("scan_id").agg(F.min(F.array_min("px")).alias("lo"), F.max(F.array_max("px")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    v = slabs.join(stats, "scan_id").select("scan_id", "lo", "hi", F.explode("px").alias("v"))
    bin_no = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1))).otherwise(0)
    hist = v.groupBy("scan_id", "lo", "hi", bin_no.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("scan_id").orderBy("bin")
    whole = Window.partitionBy("scan_id")
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    mass = F.col("n") * centre
    cum = hist.select(
        "scan_id", "lo", "hi", "bin", F.sum("n").over(upto).alias("n0"), F.sum("n").over(whole).alias("n"),
        F.sum(mass).over(upto).alias("m0"), F.sum(mass).over(whole).alias("m"),
    )
    gap = F.try_divide(F.col("m0"), F.col("n0")) - F.try_divide(F.col("m") - F.col("m0"), F.col("n") - F.col("n0"))
    between = F.coalesce(F.col("n0") * (F.col("n") - F.col("n0")) * gap * gap, F.lit(0.0))
    pick = F.max_by("bin", F.struct(F.round(F.try_divide(between, F.col("n") * F.col("n")), 12), -F.col("bin")))
    best = cum.groupBy("scan_id", "lo", "hi").agg(pick.alias("bin"))
    return best.select("scan_id", "bin", (F.col("lo") + (F.col("bin") + 1) * width).alias("threshold"))
