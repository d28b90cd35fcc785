"""Affine matrices as ``array<array<double>>`` expressions, and axis orientation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: orientation letters, two per world axis
LETTERS = "RLAPSI"


def cell(affine: Column, r: int, c: int) -> Column:
    return F.element_at(F.element_at(affine, r + 1), c + 1)


def matrix(cells: Sequence[Sequence[Column]]) -> Column:
    """4x4 affine from its three upper rows.

    The outer transform keeps the cells one value: the optimizer copies the expressions of a plain
    array constructor into every later use of a cell, and chained steps would multiply them.
    """
    last = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return F.transform(F.array(*[F.array(*row) for row in cells], last), lambda row: row)


def moved_origin(affine: Column, steps: Sequence[Column]) -> Column:
    """Same axes, origin moved by ``steps`` voxels along them."""
    rows = []
    for r in range(3):
        shift = cell(affine, r, 0) * steps[0] + cell(affine, r, 1) * steps[1] + cell(affine, r, 2) * steps[2]
        rows.append([cell(affine, r, 0), cell(affine, r, 1), cell(affine, r, 2), cell(affine, r, 3) + shift])
    return matrix(rows)


def scaled_axes(affine: Column, factors: Sequence[Column]) -> Column:
    """Same directions and origin, voxel size along axis i times ``factors[i]``."""
    return matrix(
        [[cell(affine, r, c) * factors[c] for c in range(3)] + [cell(affine, r, 3)] for r in range(3)]
    )


def _codes(affines: np.ndarray) -> list[str]:
    """Orientation letters of a stack of 4 x 4 affines."""
    axes = affines[:, :3, :3]
    size = np.sqrt((axes**2).sum(axis=1, keepdims=True))
    u, s, vt = np.linalg.svd(axes / np.where(size > 0, size, 1.0))
    keep = s > s.max(axis=1, keepdims=True) * 3 * np.finfo(float).eps
    rot = (u * keep[:, None, :]) @ vt  # nearest rotation, so shear does not tilt the choice
    every, out = np.arange(len(rot)), np.full(len(rot), "", dtype=object)
    letters = np.array([["L", "R"], ["P", "A"], ["I", "S"]], dtype=object)
    for axis in range(3):
        world = np.abs(rot[:, :, axis]).argmax(axis=1)
        out = out + letters[world, (rot[every, world, axis] >= 0).astype(int)]
        rot[every, world] = 0
    return out.tolist()


def orientation(affine: Column) -> Column:
    """Three-letter orientation of the voxel axes: the closest axis-aligned frame (one affine per scan)."""
    @F.pandas_udf("string")
    def codes(col: pd.Series) -> pd.Series:
        known = col.notna()
        out = pd.Series([None] * len(col), index=col.index, dtype=object)
        if known.any():
            out[known] = _codes(np.array([[list(r) for r in rows] for rows in col[known]], dtype=float))
        return out

    # so marked, Spark works it out once per row and does not copy it into every expression that uses it
    return codes.asNondeterministic()(affine)


def axis_source(codes: Column, target: Column, t: int) -> Column:
    """Input axis (0..2) that becomes output axis ``t`` when going from ``codes`` to ``target``."""
    worlds = lambda c: F.translate(c, LETTERS, "001122")
    return F.position(F.substring(worlds(target), t + 1, 1), worlds(codes)) - 1


def axis_flipped(codes: Column, target: Column, t: int) -> Column:
    """Whether output axis ``t`` runs against its input axis."""
    return ~F.contains(codes, F.substring(target, t + 1, 1))
