"""Slab <-> voxel views, in-slice remapping, and the block engine for cross-slice neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = ["scan_id", "c", "_b"]
COLUMNS = ["scan_id", "c", "z", "nx", "ny", "nz", "px"]


def voxels(slabs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(scan_id, c, x, y, z, v): one row per voxel, for relational use.  A projection, no shuffle."""
    rows = slabs.select("scan_id", "c", "z", "ny", *(extra or []), F.posexplode("px").alias("i", "v"))
    return rows.select(
        "scan_id", "c", F.floor(F.col("i") / F.col("ny")).cast("int").alias("x"),
        (F.col("i") % F.col("ny")).cast("int").alias("y"), "z", "v", *(extra or []),
    )


def reslab(vox: DataFrame) -> DataFrame:
    """Voxel rows with nx, ny, nz back to slabs; a group is one slice."""
    item = F.struct((F.col("x") * F.col("ny") + F.col("y")).alias("i"), "v")
    packed = vox.groupBy("scan_id", "c", "z", "nx", "ny", "nz").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return packed.withColumn("px", F.col("_s.v")).select(*COLUMNS)


def window(
    px: Column, nx: Column, ny: Column, ox: Column | int, oy: Column | int, sx: Column, sy: Column, fill: float = 0.0
) -> Column:
    """The sx x sy pixels from (ox, oy) on, ``fill`` where they lie outside the slice.

    Whole rows are sliced and joined, so the lambda runs once per row, not per pixel.
    """
    def as_int(c) -> Column:
        return (c if isinstance(c, Column) else F.lit(c)).cast("int")

    ox, oy, sx, sy = as_int(ox), as_int(oy), as_int(sx), as_int(sy)
    left = F.least(F.greatest(-oy, F.lit(0)), sy)
    start = F.greatest(oy, F.lit(0))
    count = F.greatest(F.least(ny, oy + sy) - start, F.lit(0))
    pixels = lambda n: F.array_repeat(F.lit(float(fill)), n)

    def row(x: Column) -> Column:
        r = x + ox
        inside = F.concat(pixels(left), F.slice(px, r * ny + start + 1, count), pixels(sy - left - count))
        return F.when((r >= 0) & (r < nx), inside).otherwise(pixels(sy))

    return F.flatten(F.transform(F.sequence(F.lit(0), sx - 1), row))


def rows_reversed(px: Column, nx: Column, ny: Column) -> Column:
    """Slice mirrored along x."""
    return F.flatten(F.transform(F.sequence(nx - 1, F.lit(0), F.lit(-1)), lambda x: F.slice(px, x * ny + 1, ny)))


def columns_reversed(px: Column, nx: Column, ny: Column) -> Column:
    """Slice mirrored along y."""
    return rows_reversed(F.reverse(px), nx, ny)


def transposed(px: Column, nx: Column, ny: Column) -> Column:
    """Slice with x and y exchanged."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), ny - 1),
            lambda y: F.transform(F.sequence(F.lit(0), nx - 1), lambda x: F.get(px, x * ny + y)),
        )
    )


def reshaped(slabs: DataFrame, px: Column, z: Column, size: list[Column]) -> DataFrame:
    """Rows with new pixels, slice number and shape.

    The new values get names of their own first: inside a lambda, a column that shares its name
    with an alias of the same select would be read as that alias.
    """
    new = {"px": px, "z": z.cast("int"), **{n: s.cast("int") for n, s in zip(("nx", "ny", "nz"), size)}}
    out = slabs.withColumns({f"_{n}": c for n, c in new.items()})
    return out.select(*[F.col(f"_{c}").alias(c) if c in new else F.col(c) for c in slabs.columns])


def scans_of(slabs: DataFrame, *columns: str) -> DataFrame:
    """One row per scan with the given per-scan columns, whichever slices the scan has."""
    if not columns:
        return slabs.select("scan_id").distinct()
    return slabs.groupBy("scan_id").agg(*[F.first(c).alias(c) for c in columns])


def shape_of(slabs: DataFrame) -> DataFrame:
    """(scan_id, nx, ny, nz, channels), whichever slices the scan has."""
    return slabs.groupBy("scan_id").agg(
        F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.first("nz").alias("nz"), F.countDistinct("c").alias("channels")
    )


def stacked_channels(rows: DataFrame, order: list[str]) -> DataFrame:
    """Slabs of single modalities (scan_id, modality, ...) -> channels 0.. in ``order``.

    Only scans that have every modality; the others are reported by ``cohort.ragged_modalities``.
    """
    known = rows.where(F.col("modality").isin(order))
    whole = known.groupBy("scan_id").agg(F.countDistinct("modality").alias("n")).where(F.col("n") == len(order))
    channel = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("modality")) - 1
    return known.join(whole, "scan_id", "left_semi").withColumn("c", channel.cast("int")).select(*COLUMNS)


def standardised(slabs: DataFrame) -> DataFrame:
    """float32 voxels with a channel column (0 where there is none)."""
    out = slabs if "c" in slabs.columns else slabs.withColumn("c", F.lit(0))
    return out.withColumn("px", F.col("px").cast("array<float>")).select(*COLUMNS)


def by_blocks(
    slabs: DataFrame, lo: Column, hi: Column, kernel: Callable, params: list[str] | None = None,
    size: list[Column] | None = None, block: int = 32,
) -> DataFrame:
    """Compute output slices in blocks of ``block``, each from the input slices it needs.

    ``lo`` and ``hi`` give the first and last output slice that reads an input slice.
    ``kernel(cube, first_z, wanted_z, info)`` gets those input slices as a (slices, nx, ny) array
    starting at slice ``first_z`` and returns one 2-D array per wanted z.  ``params`` are per-scan
    columns passed on in ``info``; ``size`` is the output shape if it differs.  A group holds one
    block's input only, whatever the size of the scan.
    """
    params = params or []
    size = size or [F.col(n) for n in ("nx", "ny", "nz")]
    new = ["_nx", "_ny", "_nz"]
    shaped = slabs.withColumns({n: s.cast("int") for n, s in zip(new, size)})
    at = lambda z: F.floor(F.least(F.greatest(z, F.lit(0)), F.col("_nz") - 1) / block)
    needed = (hi >= 0) & (lo < F.col("_nz")) & (lo <= hi)
    sent = shaped.where(needed).withColumn("_b", F.explode(F.sequence(at(lo), at(hi))))
    kinds = dict(slabs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" if c != "px" else "px array<double>" for c in COLUMNS)
    used = [*BLOCK, "z", "nx", "ny", "nz", *new, *params, "px"]

    def solve(rows: dict, a: int, b: int, out: dict) -> None:
        info = {n: rows[n][a] for n in ("nx", "ny", "nz", *new, *params)}
        cube = np.stack(rows["px"][a:b]).astype(float).reshape(b - a, info["nx"], info["ny"])
        first = rows["_b"][a] * block
        wanted = list(range(first, min(first + block, info["_nz"])))
        for z, picture in zip(wanted, kernel(cube, int(rows["z"][a]), wanted, info)):
            for c, v in zip(COLUMNS, (rows["scan_id"][a], rows["c"][a], z, info["_nx"], info["_ny"], info["_nz"], picture.ravel())):
                out[c].append(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by block; the last block of a batch may go on in the next one
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf[BLOCK]
            starts = np.flatnonzero((key != key.shift()).any(axis=1)).tolist()
            rows, out = {c: pdf[c].tolist() for c in used}, {c: [] for c in COLUMNS}
            for a, b in zip(starts, starts[1:]):
                solve(rows, a, b, out)
            held = pdf.iloc[starts[-1] :]
            if out["z"]:
                yield pd.DataFrame(out)
        if held is not None:
            out = {c: [] for c in COLUMNS}
            solve({c: held[c].tolist() for c in used}, 0, len(held), out)
            yield pd.DataFrame(out)

    return sent.select(*used).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "z").mapInPandas(run, schema)


def with_halo(slabs: DataFrame, halo: Column | int, kernel: Callable, params: list[str] | None = None) -> DataFrame:
    """:func:`by_blocks` for a neighbourhood of ``halo`` slices on either side."""
    return by_blocks(slabs, F.col("z") - halo, F.col("z") + halo, kernel, params)
