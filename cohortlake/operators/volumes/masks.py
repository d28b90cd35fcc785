"""Masks: Otsu, ball morphology, masking, overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.volumes.slabs import with_halo
from cohortlake.operators.volumes.stats import otsu_threshold


def ball(radius: int) -> list[tuple[int, int, int]]:
    """Offsets of the ball with half-voxel rim: |d|^2 <= (radius + 1/2)^2."""
    r = range(-radius, radius + 1)
    return [(x, y, z) for x in r for y in r for z in r if x * x + y * y + z * z <= (radius + 0.5) ** 2]


def _shifted_any(cube: np.ndarray, first: int, wanted: list[int], radius: int) -> list[np.ndarray]:
    """For each wanted slice: is any voxel of the ball around a pixel set?  Outside counts as unset."""
    n, nx, ny = cube.shape
    full = np.zeros((n + 2 * radius, nx + 2 * radius, ny + 2 * radius), dtype=bool)
    full[radius : radius + n, radius : radius + nx, radius : radius + ny] = cube > 0
    out = np.zeros((len(wanted), nx, ny), dtype=bool)
    z0 = wanted[0] - first + radius
    for dx, dy, dz in ball(radius):
        out |= full[
            z0 + dz : z0 + dz + len(wanted), radius + dx : radius + dx + nx, radius + dy : radius + dy + ny
        ]
    return list(out.astype(float))


def dilate(mask: DataFrame, radius: int = 1) -> DataFrame:
    return with_halo(mask, radius, lambda cube, first, wanted, _: _shifted_any(cube, first, wanted, radius))


def erode(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Unset wherever the ball meets an unset voxel; outside the volume counts as set."""
    def kernel(cube, first, wanted, _):
        return [1.0 - s for s in _shifted_any(1.0 - (cube > 0), first, wanted, radius)]

    return with_halo(mask, radius, kernel)


def closing(mask: DataFrame, radius: int = 1) -> DataFrame:
    """Dilate then erode, with room around the volume so that the border behaves like the inside."""
    from cohortlake.operators.volumes.geometry import cut, place

    size = [F.col(n) for n in ("nx", "ny", "nz")]
    wide = place(mask, [F.lit(radius)] * 3, [s + 2 * radius for s in size])
    done = erode(dilate(wide, radius), radius)
    return cut(done, [F.lit(radius)] * 3, [s - 2 * radius for s in size])


def opening(mask: DataFrame, radius: int = 1) -> DataFrame:
    return dilate(erode(mask, radius), radius)


def otsu_mask(slabs: DataFrame, bins: int = 128) -> DataFrame:
    """1 above the Otsu threshold, else 0."""
    t = otsu_threshold(slabs, bins).select("scan_id", "threshold")
    j = slabs.join(t, "scan_id")
    return j.withColumn("px", F.transform("px", lambda v: F.when(v > F.col("threshold"), 1.0).otherwise(0.0))).select(
        *slabs.columns
    )


def _grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """Is any voxel of the ball round a voxel set?  Outside the array counts as unset."""
    n = mask.shape
    full = np.pad(mask, radius)
    out = np.zeros(n, dtype=bool)
    for dx, dy, dz in ball(radius):
        out |= full[tuple(slice(radius + d, radius + d + k) for d, k in zip((dz, dx, dy), n))]
    return out


def _shrunk(mask: np.ndarray, radius: int) -> np.ndarray:
    """Outside the array counts as set."""
    return ~_grown(~mask, radius)


def head_mask(slabs: DataFrame, close_radius: int = 3, open_radius: int = 1) -> DataFrame:
    """Otsu mask, closed and opened: all four steps in one pass over blocks, with room for all of them.

    As in :func:`closing`, the volume gets a margin of unset voxels first, so that its border behaves like the
    inside; a block that ends inside the volume has real slices there instead.
    """
    def kernel(cube, first, wanted, info):
        r = close_radius
        below, above = (r if first == 0 else 0), (r if first + len(cube) == info["nz"] else 0)
        wide = np.pad(cube > 0, ((below, above), (r, r), (r, r)))
        wide = _shrunk(_grown(wide, r), r)
        mask = wide[below : below + len(cube), r : r + info["nx"], r : r + info["ny"]]
        mask = _grown(_shrunk(mask, open_radius), open_radius)
        return [mask[z - first].astype(float) for z in wanted]

    return with_halo(otsu_mask(slabs), 2 * (close_radius + open_radius), kernel)


def apply_mask(slabs: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxel times mask, slice by slice.  A mask without channels counts for every channel."""
    m = mask.select("scan_id", "z", F.col("px").alias("_m")) if "c" not in mask.columns else mask.where("c = 0").select(
        "scan_id", "z", F.col("px").alias("_m")
    )
    return slabs.join(m, ["scan_id", "z"]).withColumn("px", F.zip_with("px", "_m", lambda v, w: v * w)).select(
        *slabs.columns
    )


def dice(pred: DataFrame, target: DataFrame) -> DataFrame:
    """(scan_id, dice) of two 0/1 masks: 2|P and T| / (|P| + |T|), 1 if both are empty.

    Slices are matched, not voxels; a slice that only one side has counts as empty on the other.
    """
    key = ["scan_id", "c", "z"]
    both = pred.select(*key, F.col("px").alias("p")).join(target.select(*key, F.col("px").alias("t")), key, "full_outer")
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    common = total(F.zip_with("p", "t", lambda a, b: (a * b).cast("double")))
    sums = both.select("scan_id", common.alias("i"), (total(F.col("p")) + total(F.col("t"))).alias("n")).groupBy(
        "scan_id"
    ).agg(F.sum("i").alias("i"), F.sum("n").alias("n"))
    return sums.select(
        "scan_id", F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide(2.0 * F.col("i"), F.col("n"))).alias("dice")
    )
