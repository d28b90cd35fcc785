"""Repeated prediction: all runs of all scans in one plan, keyed by (scan, run)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.volumes import intensity, summary, warp
from cohortlake.operators.volumes.slabs import COLUMNS, by_blocks
from cohortlake.plans.augment import TTA_FIXED, tta_plan
from cohortlake.session import materialised, stacked

KEYED = ["scan_id", "run", *COLUMNS[1:]]
#: Values of a run inside a block: flipped or not, warped or not, the warp.
PLACED = ["flip", "affine", *warp.WARP]


def run_table(scans: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """One row (scan_id, run) per scan and run with its steps as columns: flip, affine, the warp, gamma, levels.

    A step that a run lacks is neutral: 0, unit scale, or null for gamma and levels.
    """
    plan = tta_plan(scans, runs, seed)
    of = lambda name: F.col("transform") == name
    value = lambda step, name: F.max(F.when(of(step), F.try_element_at("params", F.lit(name))))
    steps = plan.groupBy("scan_id", "run").agg(
        F.max(of("flip").cast("double")).alias("flip"), F.max(of("affine").cast("double")).alias("affine"),
        *[value("affine", n).alias(n) for n in warp.WARP], value("contrast", "gamma").alias("gamma"),
        F.max(F.when(of("scale_percentiles"), 1)).alias("levels"),
    )
    every = scans.select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    neutral = {**{n: 0.0 for n in PLACED}, **{n: 1.0 for n in ("sx", "sy", "sz")}}
    return every.join(steps, ["scan_id", "run"], "left").fillna(neutral)


def placed_runs(slabs: DataFrame, table: DataFrame, block: int = 32) -> DataFrame:
    """Flip and warp of all runs: (scan_id, run, c, z, nx, ny, nz, px).

    A slice is sent to its block once, whatever the number of runs: the block gets the neighbours that the widest run
    needs, works out each run's slices and returns them on top of each other; they are parted row by row.
    """
    runs = F.sort_array(F.collect_list(F.struct("run", *PLACED)))
    per_scan = table.groupBy("scan_id").agg(runs.alias("_runs"), F.count("*").cast("int").alias("_n"))
    values = F.transform("_runs", lambda r: F.array(*[r[n] for n in PLACED]))
    given = slabs.join(per_scan, "scan_id").withColumn("_values", values)

    def kernel(cube, first, wanted, info):
        shape, out = (info["nx"], info["ny"], info["nz"]), [[] for _ in wanted]
        for numbers in info["_values"]:
            run = dict(zip(PLACED, numbers, strict=True))
            own = cube[:, ::-1, :] if run["flip"] else cube
            slices = warp.sampled(own, first, wanted, shape, run) if run["affine"] else [own[z - first] for z in wanted]
            for all_runs, picture in zip(out, slices, strict=True):
                all_runs.append(picture)
        return map(_on_top, out)

    widest = F.array_max(F.transform("_runs", lambda r: F.when(r["affine"] > 0, warp.reach(lambda n: r[n])).otherwise(0)))
    size = [F.col("nx") * F.col("_n"), F.col("ny"), F.col("nz")]
    tall = by_blocks(given, F.col("z") - widest, F.col("z") + widest, kernel, ["_values"], size, block)
    numbers = table.groupBy("scan_id").agg(F.sort_array(F.collect_list("run")).alias("_run"))
    tall = tall.join(numbers, "scan_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_run") - 1)))
    nx = (F.col("nx") / F.size("_run")).cast("int")
    part = F.slice("px", F.col("_k") * nx * F.col("ny") + 1, nx * F.col("ny"))
    return tall.select("scan_id", F.get("_run", F.col("_k")).alias("run"), "c", "z", nx.alias("_nx"), "ny", "nz", part.alias("_px")).select(
        "scan_id", "run", "c", "z", F.col("_nx").alias("nx"), "ny", "nz", F.col("_px").alias("px")
    )


def _on_top(pictures):
    import numpy as np

    return np.concatenate(pictures)


def repeated_runs(slabs: DataFrame, runs: int, seed: int = 42, block: int = 32) -> DataFrame:
    """Every scan under every run of repeated prediction: (scan_id, run, c, z, nx, ny, nz, px).

    Run 0 is the scan as it is.  Flips and warps of all runs are made in one block pass and written once; contrast and
    percentile levels, which need figures of the whole (scan, run), read that.  A scan of a run is a scan of its own
    there: its id is the pair.
    """
    table = materialised(run_table(slabs.select("scan_id").distinct(), runs, seed), "runs")
    levels = next(p for steps in TTA_FIXED.values() for name, p in steps if name == "scale_percentiles")
    placed = materialised(placed_runs(slabs, table, block), "runs-placed")
    met = placed.join(table.select("scan_id", "run", "gamma", "levels"), ["scan_id", "run"])
    plain = met.where("gamma is null and levels is null").select(*KEYED)
    pair = F.struct("scan_id", "run").alias("scan_id")
    keyed = met.select(pair, *COLUMNS[1:], "gamma", "levels")
    curved = intensity.adjust_contrast(keyed.where("gamma is not null"), F.col("gamma"))
    levelled = intensity.percentile_scale(keyed.where("levels is not null").select(*COLUMNS), **levels)
    apart = lambda df: df.select("scan_id.scan_id", "scan_id.run", *COLUMNS[1:])
    return stacked(plain, apart(curved), apart(levelled))
