"""Exact percentiles and quality figures of scans from one summary per slice; voxels stay in the tasks that read them.

The summary pass counts, per slice, its values in bins of leading bits (sign, exponent, six bits of the fraction).  Summed
per scan these say in which bin a rank lies.  A second pass counts the distinct values of those bins alone.  What is
shuffled are counts: bins in the first pass, values of the wanted bins in the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import materialised

#: Leading bits of a value that name its bin.
BITS = 18


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; -0.0 counts as 0.0, not-a-number comes last."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _bins(values: np.ndarray) -> np.ndarray:
    return (_keys(values) >> np.int64(64 - BITS)).astype(np.int32)


def _slices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    px = batch["px"]
    flat, edges = px.values, px.offsets.to_numpy()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield flat[a:b].to_numpy(zero_copy_only=False).astype(np.float64)


def _sharpness(v: np.ndarray, nx: int, ny: int) -> float:
    """Population variance of the 4-neighbour Laplacian of the grey slice, borders mirrored; 0 if flat."""
    low, high = v.min(), v.max()
    grey = np.floor((v - low) / (high - low) * 255.0).reshape(nx, ny) if high > low else np.zeros((nx, ny))
    for axis in (0, 1):
        around = [(0, 0), (0, 0)]
        around[axis] = (1, 1)
        wide = np.pad(grey, around, "reflect" if grey.shape[axis] > 1 else "edge")
        both = np.take(wide, range(grey.shape[axis]), axis) + np.take(wide, range(2, grey.shape[axis] + 2), axis)
        total = both if axis == 0 else total + both
    laplacian = total - 4 * grey
    mean = laplacian.sum() / laplacian.size
    return float((laplacian * laplacian).sum() / laplacian.size - mean * mean)


SUMMARY = (
    "scan_id {id}, c int, z int, nz int, n long, mean double, m2 double, min double, max double, blur double, "
    "bins array<int>, counts array<long>"
)


def slice_summaries(slabs: DataFrame, positive: bool = False, blur: bool = False) -> DataFrame:
    """One narrow row per slice: moments, extremes, counts per bin (of positive values only, if asked for).

    With ``blur``, the central slice of channel 0 also gets its sharpness.  Written to the shared folder, since
    several figures are derived from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            cells = [batch[c].to_pylist() for c in ("scan_id", "c", "z", "nx", "ny", "nz")]
            for scan, c, z, nx, ny, nz, v in zip(*cells, _slices(batch), strict=True):
                mean = float(v.mean())
                sharp = _sharpness(v, nx, ny) if blur and c == 0 and z == (nz // 2 if nz > 1 else 0) else None
                bins, counts = np.unique(_bins(v[v > 0] if positive else v), return_counts=True)
                rows.append((scan, c, z, nz, len(v), mean, float(((v - mean) ** 2).sum()), float(v.min()), float(v.max()), sharp, bins, counts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds(batch), strict=True)], names=names)

    def kinds(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field("scan_id").type, *[pa.int32()] * 3, pa.int64(), *[pa.float64()] * 5, pa.list_(pa.int32()), pa.list_(pa.int64())]

    schema = SUMMARY.format(id=dict(slabs.dtypes)["scan_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    used = slabs.where(F.size("px") > 0).select("scan_id", *[F.col(c).cast("int").alias(c) for c in ("c", "z", "nx", "ny", "nz")], "px")
    return materialised(used.mapInArrow(run, schema), "slices")


def moments(summaries: DataFrame) -> DataFrame:
    """scan_id, min, max, mean, std (population) from slice summaries: parts are merged pairwise, which keeps small spreads on large means.

    A group is the slices of one scan, three numbers each.
    """
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merged(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2")
        )

    parts = F.sort_array(F.collect_list(F.struct("c", "z", "n", "mean", "m2")))
    whole = summaries.groupBy("scan_id").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.aggregate(parts, zero, merged).alias("_m"))
    return whole.select("scan_id", "min", "max", F.col("_m.mean").alias("mean"), F.sqrt(F.col("_m.m2") / F.col("_m.n")).alias("std"))


def located(summaries: DataFrame, probs: dict[str, float]) -> DataFrame:
    """(scan_id, name, side, bin, rank): for each wanted percentile the bins of the two ranks around it, and the ranks inside them.

    ``side`` is lo or hi; ``part`` is how far the percentile lies from lo to hi.  A group is the bins of one scan.
    """
    pairs = F.explode(F.arrays_zip("bins", "counts")).alias("_b")
    bins = summaries.select("scan_id", pairs).groupBy("scan_id", F.col("_b.bins").alias("bin")).agg(F.sum("_b.counts").alias("_c"))
    scan = Window.partitionBy("scan_id")
    running = bins.withColumns({"_upto": F.sum("_c").over(scan.orderBy("bin")), "_total": F.sum("_c").over(scan)})
    wanted = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
            offset = rank - (F.col("_upto") - F.col("_c"))
            wanted.append(F.when(inside, F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), offset.cast("long").alias("rank"), (at - F.floor(at)).alias("part"))))
    listed = F.filter(F.array(*wanted), lambda s: s.isNotNull())
    return running.select("scan_id", "bin", F.explode(listed).alias("s")).select("scan_id", "bin", "s.*")


def scan_percentiles(slabs: DataFrame, summaries: DataFrame, probs: dict[str, float], positive: bool = False) -> DataFrame:
    """Exact linear-interpolated percentiles of all values of a scan, one column per entry of ``probs``.

    ``summaries`` are those of ``slabs`` with the same ``positive``.  Scans without (positive) values are absent.
    """
    at = materialised(located(summaries, probs), "ranks")
    bins = at.groupBy("scan_id").agg(F.sort_array(F.collect_set("bin")).alias("_wanted"))  # two per percentile at most
    given = slabs.select("scan_id", "px").join(bins, "scan_id")
    kind = dict(slabs.dtypes)["scan_id"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            wanted = batch["_wanted"].to_pylist()
            for i, v in enumerate(_slices(batch)):
                values = v[v > 0] if positive else v
                own = _bins(values)
                hit = np.isin(own, wanted[i])
                found, counts = np.unique(values[hit] + 0.0, return_counts=True)
                if len(found):
                    out.append((np.full(len(found), i), _bins(found), found, counts))
            if out:
                row, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch["scan_id"].take(pa.array(row)), *map(pa.array, rest)], names=["scan_id", "bin", "v", "n"])

    few = given.mapInArrow(pick, f"scan_id {kind}, bin int, v double, n long")
    values = few.groupBy("scan_id", "bin", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("scan_id", "bin").orderBy("v"))
    ranked = values.withColumn("_upto", upto)
    met = ranked.join(at, ["scan_id", "bin"]).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank")))
    side = lambda name, s: F.max(F.when((F.col("name") == name) & (F.col("side") == s), F.col("v")))
    sides = met.groupBy("scan_id").agg(*[
        x for n in probs for x in (
            side(n, "lo").alias(f"_lo_{n}"), side(n, "hi").alias(f"_hi_{n}"), F.max(F.when(F.col("name") == n, F.col("part"))).alias(f"_pt_{n}"),
        )
    ])
    mixed = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_pt_{n}")
    return sides.select("scan_id", *[mixed(n).alias(n) for n in probs])


CONTRAST = {"p10": 0.1, "p90": 0.9}


def contrast_of(slabs: DataFrame, summaries: DataFrame) -> DataFrame:
    """(scan_id, contrast): (p90 - p10) / (p90 + p10 + 1e-5) over positive values; 0 where there are none."""
    p = scan_percentiles(slabs, summaries, CONTRAST, positive=True)
    ratio = (F.col("p90") - F.col("p10")) / (F.col("p90") + F.col("p10") + 1e-5)
    scans = summaries.select("scan_id").distinct()
    return scans.join(p.select("scan_id", ratio.alias("contrast")), "scan_id", "left").fillna(0.0, ["contrast"])
