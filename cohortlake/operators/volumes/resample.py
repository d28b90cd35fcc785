"""Regridding: resample to a spacing, resize to a shape.

Interpolation is separable: blocks of output slices fetch the input slices they read, then each
axis is interpolated in turn.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import affine as A
from cohortlake.functions.metadata import voxel_spacing
from cohortlake.operators.volumes.slabs import COLUMNS, by_blocks, shape_of
from cohortlake.session import stacked


def _interpolated(cube: np.ndarray, axis: int, positions: np.ndarray, first: int, n: int, nearest: bool) -> np.ndarray:
    """Sample ``cube`` along one axis; its index 0 is position ``first`` of an axis of ``n``.

    A position past the last sample's far half reads 0; between, the last sample is held.
    """
    inside = positions < n - 0.5
    shape = [-1 if a == axis else 1 for a in range(3)]
    take = lambda k: np.take(cube, np.clip(k.astype(int) - first, 0, cube.shape[axis] - 1), axis=axis)
    if nearest:
        return take(np.minimum(np.floor(positions + 0.5), n - 1)) * inside.reshape(shape)
    lo = np.minimum(np.floor(positions), n - 1)
    part = np.minimum(positions - lo, 1.0).reshape(shape)
    return (take(lo) * (1 - part) + take(np.minimum(lo + 1, n - 1)) * part) * inside.reshape(shape)


def regrid(slabs: DataFrame, grid: DataFrame, nearest: bool = False) -> DataFrame:
    """Slabs on a new grid.  ``grid``: scan_id, new_size array<int>, ratio array<double> (old index per new index).

    Scans whose size and ratio do not change pass through untouched.
    """
    names = ["_rx", "_ry", "_rz"]
    j = slabs.join(
        grid.select("scan_id", "new_size", *[F.col("ratio")[k].alias(c) for k, c in enumerate(names)]), "scan_id"
    )
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    new = [F.col("new_size")[k] for k in range(3)]
    same = (n[0] == new[0]) & (n[1] == new[1]) & (n[2] == new[2])
    for c in names:
        same = same & (F.col(c) == 1)
    kept = j.where(same).select(*COLUMNS)
    # an input slice is read by output slices around z / ratio; the last one also covers the rest
    z, rz = F.col("z"), F.col("_rz")
    lo = F.ceil((z - 1) / rz) - 1
    hi = F.when(z == n[2] - 1, new[2] - 1).otherwise(F.floor((z + 1) / rz) + 1)

    def kernel(cube, first, wanted, info):
        out = _interpolated(cube, 0, np.array(wanted) * info["_rz"], first, info["nz"], nearest)
        out = _interpolated(out, 1, np.arange(info["_nx"]) * info["_rx"], 0, info["nx"], nearest)
        return _interpolated(out, 2, np.arange(info["_ny"]) * info["_ry"], 0, info["ny"], nearest)

    return stacked(kept, by_blocks(j.where(~same), lo, hi, kernel, names, new))


def _current(slabs: DataFrame, affines: DataFrame) -> DataFrame:
    sp = voxel_spacing(F.col("affine"), F.lit("nifti"))
    return affines.join(shape_of(slabs), "scan_id").select(
        "scan_id", "affine", F.array("nx", "ny", "nz").alias("size"), sp.alias("spacing")
    )


def _regridded(slabs: DataFrame, plan: DataFrame, nearest: bool):
    out = regrid(slabs, plan.select("scan_id", "new_size", "ratio"), nearest)
    moved = plan.select("scan_id", A.scaled_axes(F.col("affine"), [F.col("ratio")[k] for k in range(3)]).alias("affine"))
    params = plan.select("scan_id", F.col("size").alias("original_shape"), F.col("spacing").alias("original_spacing"))
    return out, moved, params


def _floats(values: Sequence[float]):
    return F.array(*[F.lit(float(v)) for v in values])


def resample(slabs: DataFrame, affines: DataFrame, spacing: Sequence[float]):
    """(slabs, affines, params) at the target spacing; sizes round half to even; same origin."""
    extent = F.zip_with("size", "spacing", lambda n, s: n * s)
    plan = _current(slabs, affines).select(
        "*",
        F.zip_with(extent, _floats(spacing), lambda e, t: F.bround(e / t).cast("int")).alias("new_size"),
        F.zip_with(_floats(spacing), "spacing", lambda t, s: t / s).alias("ratio"),
    )
    return _regridded(slabs, plan, nearest=False)


def resize(slabs: DataFrame, affines: DataFrame, target: Sequence[int], interpolator: str = "linear"):
    """(slabs, affines, params) at the target shape, physical extent kept; linear or nearest."""
    if interpolator not in ("linear", "nearest"):
        raise ValueError(f"interpolator {interpolator} is not offered; use linear or nearest")
    plan = _current(slabs, affines).select(
        "*",
        F.array(*[F.lit(int(t)) for t in target]).alias("new_size"),
        F.zip_with("size", _floats(target), lambda n, t: n / t).alias("ratio"),
    )
    return _regridded(slabs, plan, interpolator == "nearest")


def restore_grid(slabs: DataFrame, affines: DataFrame, params: DataFrame):
    """Inverse of resample or resize: back to the recorded shape and spacing, linear."""
    cur = _current(slabs, affines).join(params, "scan_id")
    plan = cur.select(
        "scan_id", "affine", "size", "spacing",
        F.col("original_shape").alias("new_size"),
        F.zip_with("original_spacing", "spacing", lambda old, s: old / s).alias("ratio"),
    )
    out, moved, _ = _regridded(slabs, plan, nearest=False)
    return out, moved
