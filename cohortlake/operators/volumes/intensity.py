"""Voxel-wise intensity operators: in-slice array expressions, per-scan statistics joined where needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import draws
from cohortlake.operators.volumes import summary
from cohortlake.operators.volumes.stats import volume_statistics


def mapped(slabs: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every voxel."""
    return slabs.withColumn("px", F.transform("px", fn))


def with_scan(slabs: DataFrame, per_scan: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """As :func:`mapped`, with the columns of a per-scan table in reach.

    One narrow row per scan is joined; whether it is broadcast follows its measured size.
    """
    return mapped(slabs.join(per_scan, "scan_id"), fn).select(*slabs.columns)


def normalise(slabs: DataFrame, mode: str = "z_score") -> DataFrame:
    """z_score: (v - mean) / (population std + 1e-8); min_max: (v - min) / (max - min + 1e-8)."""
    stats = volume_statistics(slabs)
    if mode == "z_score":
        return with_scan(slabs, stats, lambda v: (v - F.col("mean")) / (F.col("std") + 1e-8))
    if mode == "min_max":
        return with_scan(slabs, stats, lambda v: (v - F.col("min")) / (F.col("max") - F.col("min") + 1e-8))
    raise ValueError(f"unsupported normalisation mode {mode}; use z_score or min_max")


def scale_shift(slabs: DataFrame, scale: Column | float = 1.0, shift: Column | float = 0.0) -> DataFrame:
    return mapped(slabs, lambda v: v * scale + shift)


def scale_by_factor(slabs: DataFrame, factor: Column | float) -> DataFrame:
    """v * (1 + factor)."""
    return mapped(slabs, lambda v: v * (1 + factor))


def adjust_contrast(slabs: DataFrame, gamma: Column | float) -> DataFrame:
    """((v - min) / (range + 1e-7)) ^ gamma * range + min."""
    stats = volume_statistics(slabs).select("scan_id", F.col("min").alias("_lo"), (F.col("max") - F.col("min")).alias("_span"))
    lo, span = F.col("_lo"), F.col("_span")
    power = F.lit(float(gamma)) if isinstance(gamma, (int, float)) else gamma
    return with_scan(slabs, stats, lambda v: F.pow((v - lo) / (span + 1e-7), power) * span + lo)


def percentile_scale(
    slabs: DataFrame, lower: float = 0.01, upper: float = 0.99, low: float = 0.0, high: float = 1.05
) -> DataFrame:
    """Map the percentile range linearly to [low, high] without clipping; a flat range only shifts."""
    p = summary.scan_percentiles(slabs, summary.slice_summaries(slabs), {"_a": lower, "_b": upper})
    a, span = F.col("_a"), F.col("_b") - F.col("_a")
    return with_scan(
        slabs, p,
        lambda x: F.when(span == 0, x - a + low).otherwise(F.try_divide(x - a, span) * (high - low) + low),
    )


def noisy(px: Column, std: Column | float, seed: int) -> Column:
    """px + N(0, std); each voxel's draw depends on the seed and its own position only."""
    keys = [F.lit(seed), F.col("scan_id"), F.col("c"), F.col("z")]
    return F.transform(px, lambda v, i: v + draws.normal(*keys, i) * std)


def gaussian_noise(slabs: DataFrame, std: Column | float, seed: int = 42) -> DataFrame:
    return slabs.withColumn("px", noisy(F.col("px"), std, seed))
