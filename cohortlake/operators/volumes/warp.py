"""Cross-slice kernels on blocks of slices: affine warp, zoom, Gaussian smoothing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.volumes.slabs import scans_of, with_halo


def gaussian_weights(sigma: float, truncated: float = 4.0) -> list[float]:
    """1-D kernel from differences of the error function, cut at ``truncated`` deviations."""
    tail = int(max(sigma * truncated, 0.5) + 0.5)
    t = math.sqrt(0.5) / sigma
    return [0.5 * (math.erf(t * (x + 0.5)) - math.erf(t * (x - 0.5))) for x in range(-tail, tail + 1)]


def _smooth_axis(cube: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    tail = len(weights) // 2
    room = [(tail, tail) if a == axis else (0, 0) for a in range(3)]
    padded, n = np.pad(cube, room), cube.shape[axis]
    return sum(w * np.take(padded, range(k, k + n), axis=axis) for k, w in enumerate(weights))


def gaussian_smooth(slabs: DataFrame, sigma: float | tuple[str, str, str]) -> DataFrame:
    """Separable smoothing with zeros outside.  ``sigma`` is one number, or three per-scan columns.

    A block gets as many neighbouring slices as the kernel of its scan is long, so no tail is lost.
    """
    names = list(dict.fromkeys(sigma)) if isinstance(sigma, tuple) else []
    tail = F.floor(F.greatest(F.col(sigma[2]) * 4.0, F.lit(0.5)) + 0.5).cast("int") if names else None
    halo = tail if names else len(gaussian_weights(sigma)) // 2

    def kernel(cube, first, wanted, info):
        sx, sy, sz = (info[c] for c in sigma) if names else (sigma,) * 3
        out = _smooth_axis(cube, gaussian_weights(sz), 0)
        for s, axis in ((sx, 1), (sy, 2)):
            out = _smooth_axis(out, gaussian_weights(s), axis)
        return [out[z - first] for z in wanted]

    return with_halo(slabs, halo, kernel, names)


def rotation(rx: float, ry: float, rz: float) -> np.ndarray:
    """Turns about the first, second and third axis, applied in reverse order."""
    c, s = np.cos([rx, ry, rz]), np.sin([rx, ry, rz])
    about = [
        [[1, 0, 0], [0, c[0], -s[0]], [0, s[0], c[0]]],
        [[c[1], 0, s[1]], [0, 1, 0], [-s[1], 0, c[1]]],
        [[c[2], -s[2], 0], [s[2], c[2], 0], [0, 0, 1]],
    ]
    return np.linalg.multi_dot([np.array(m, dtype=float) for m in about])


# per-scan columns of a warp: angles (rad), translation (voxels), scale
WARP = ["rx", "ry", "rz", "tx", "ty", "tz", "sx", "sy", "sz"]


def reach(of: Callable[[str], Column] = F.col) -> Column:
    """Most slices a sampled position can lie away from its output slice, plus one for interpolation.

    ``of`` gives the column of each of the :data:`WARP` values.
    """
    half = [(F.col(n) - 1) / 2 for n in ("nx", "ny", "nz")]
    span = [half[k] * F.abs(of(f"s{a}")) + F.abs(of(f"t{a}")) for k, a in enumerate("xyz")]
    bx, by = F.abs(F.sin(of("rx"))), F.abs(F.sin(of("ry")))
    # third row of the rotation is bounded by the sines of the tilts; its diagonal cosine costs the rest
    drop = F.abs(F.cos(of("rx")) * F.cos(of("ry")) * of("sz") - 1) * half[2] + F.abs(of("tz"))
    return (F.ceil((bx + by) * (span[0] + span[1]) + drop) + 1).cast("int")


#: Voxels sampled at a time; blocks of up to so many voxels keep their corners for the next scan of the same warp.
POINTS, KEPT = 1 << 16, 1 << 12


def _corners(first: int, wanted: tuple[int, ...], shape: tuple[int, int, int], numbers: tuple[float, ...]) -> Iterator[tuple]:
    """For each of the eight corners round a sampled position: (voxels that have it, its place in the cube, its weight)."""
    n = np.array(shape)
    centre = (n - 1) / 2
    values = dict(zip(WARP, numbers, strict=True))
    rot = rotation(values["rx"], values["ry"], values["rz"])
    scale = np.array([values["sx"], values["sy"], values["sz"]])
    shift = np.array([values["tx"], values["ty"], values["tz"]])
    z, x, y = np.meshgrid(wanted, np.arange(n[0]), np.arange(n[1]), indexing="ij")
    q = np.stack([x.ravel(), y.ravel(), z.ravel()], 1) - centre
    src = (q * scale + shift) @ rot.T + centre
    lo = np.floor(src).astype(int)
    frac = src - lo
    for corner in np.ndindex(2, 2, 2):
        at = lo + corner
        ok = np.flatnonzero(((at >= 0) & (at < n)).all(axis=1))
        w = np.where(corner, frac, 1 - frac).prod(axis=1)
        own = at[ok]
        yield ok, ((own[:, 2] - first) * n[0] + own[:, 0]) * n[1] + own[:, 1], w[ok]


@lru_cache(maxsize=64)
def _kept_corners(*place) -> tuple:
    return tuple(_corners(*place))


def sampled(cube: np.ndarray, first: int, wanted: list[int], shape: tuple[int, int, int], values: dict) -> list[np.ndarray]:
    """The ``wanted`` output slices of a warp; ``cube`` holds the input slices from ``first`` on that they read."""
    flat, size, numbers = cube.reshape(-1), shape[0] * shape[1], tuple(float(values[n]) for n in WARP)
    step = max(1, POINTS // size)
    out = []
    for low in range(0, len(wanted), step):
        some = tuple(wanted[low : low + step])
        total = np.zeros(size * len(some))
        corners = _kept_corners if len(total) <= KEPT else _corners
        for ok, at, w in corners(first, some, shape, numbers):
            total[ok] += w * flat[at]
        out.extend(total.reshape(len(some), shape[0], shape[1]))
    return out


def affine_warp(slabs: DataFrame, params: DataFrame) -> DataFrame:
    """Sample input position R(S q + t) + centre for every output voxel q + centre; trilinear, zeros outside.

    ``params``: scan_id and the :data:`WARP` columns.
    """
    def kernel(cube, first, wanted, info):
        return sampled(cube, first, wanted, (info["nx"], info["ny"], info["nz"]), info)

    joined = slabs.join(params.select("scan_id", *WARP), "scan_id")
    return with_halo(joined, reach(), kernel, WARP)


def fixed_warp(slabs: DataFrame, **values: float) -> DataFrame:
    """:func:`affine_warp` with the same parameters for every scan; absent ones are neutral."""
    neutral = {c: 1.0 if c.startswith("s") else 0.0 for c in WARP} | values
    scans = scans_of(slabs).select("scan_id", *[F.lit(float(v)).alias(c) for c, v in neutral.items()])
    return affine_warp(slabs, scans)


def zoom(slabs: DataFrame, factor: float) -> DataFrame:
    """Enlarge about the centre, size kept: positions are read at 1 / factor."""
    return fixed_warp(slabs, sx=1 / factor, sy=1 / factor, sz=1 / factor)
