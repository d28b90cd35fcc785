"""Percentiles, quality, compressed files, repeated prediction and early stops against numpy and byte-level cases."""

import gzip
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators.runs import early_stop
from cohortlake.operators.volumes import geometry, intensity, stats, summary, warp
from cohortlake.plans import augment, repeated
from cohortlake.sources import files

SCHEMA = "scan_id string, c int, z int, nx int, ny int, nz int, px array<double>"


def slabs_of(spark, cubes):
    """Cubes (nx, ny, nz) by name -> slabs in several partitions."""
    rows = [(k, 0, z, *v.shape, v[:, :, z].ravel().tolist()) for k, v in cubes.items() for z in range(v.shape[2])]
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def cubes(seed=3):
    draw = np.random.default_rng(seed)
    many = draw.normal(0, 100, (5, 4, 70))
    return {
        "deep": many, "ties": np.round(many), "flat": np.full((3, 3, 2), 7.5), "dark": -np.abs(many[:, :, :6]), "zeros": np.zeros((2, 2, 3)),
        "one": np.full((1, 1, 1), 3.0), "tiny": draw.choice([5e-324, 1e-310, -0.0, 0.0, 1e300, -1e300], (4, 4, 4)),
        "offset": 1e8 + draw.normal(0, 1, (6, 6, 6)),
    }


@pytest.mark.parametrize("positive", [False, True])
def test_percentiles_are_exact(spark, positive):
    c = cubes()
    s = slabs_of(spark, c)
    probs = {"a": 0.0, "b": 0.01, "c": 0.37, "d": 0.5, "e": 0.99, "f": 1.0}
    got = {r["scan_id"]: r for r in summary.scan_percentiles(s, summary.slice_summaries(s, positive), probs, positive).collect()}
    for name, cube in c.items():
        v = cube[cube > 0] if positive else cube.ravel()
        if not len(v):
            assert name not in got
            continue
        for p, q in probs.items():
            assert math.isclose(got[name][p], np.quantile(v, q), rel_tol=1e-12, abs_tol=1e-12), (name, p)


def test_no_voxel_is_shuffled(spark):
    """Every exchange carries counts: none has pixels below it without the pass that counts them in between."""
    s = slabs_of(spark, cubes())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stats.tissue_contrast(s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "px" not in re.sub(r"plan_id.*", "", line)


def test_moments_and_quality(spark):
    c = cubes()
    s = slabs_of(spark, c)
    m = {r["scan_id"]: r for r in summary.moments(summary.slice_summaries(s)).collect()}
    for name in ("deep", "ties", "flat", "offset", "one"):
        assert math.isclose(m[name]["mean"], c[name].mean(), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(m[name]["std"], c[name].std(), rel_tol=1e-6, abs_tol=1e-9), name
    spacing = s.select("scan_id").distinct().withColumn("spacing", F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0)))
    rows = {r["scan_id"]: r for r in stats.quality_report(s, spacing).collect()}
    blur = {r["scan_id"]: r["blur"] for r in stats.blur_index(s).collect()}
    gaps = {r["scan_id"]: r["missing_slices"] for r in stats.slice_gaps(s).collect()}
    for name in ("deep", "ties", "flat", "dark", "zeros", "one", "offset"):
        v = c[name][c[name] > 0]
        p = np.quantile(v, [0.1, 0.9]) if len(v) else [0.0, 0.0]
        assert math.isclose(rows[name]["contrast_score"], (p[1] - p[0]) / (p[1] + p[0] + 1e-5), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(rows[name]["blur_score"], blur[name], rel_tol=1e-9, abs_tol=1e-9)
        assert rows[name]["missing_slices"] == gaps[name] and rows[name]["slice_count"] == c[name].shape[2]


def test_percentile_scale_over_blocks(spark):
    c = {k: v for k, v in cubes().items() if k in ("deep", "flat", "ties")}
    out = intensity.percentile_scale(slabs_of(spark, c))
    for r in out.collect():
        v = c[r["scan_id"]]
        a, b = np.quantile(v, [0.01, 0.99])
        want = (v[:, :, r["z"]] - a) / (b - a) * 1.05 if a != b else v[:, :, r["z"]] - a
        assert np.allclose(np.array(r["px"]).reshape(want.shape), want)


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_plane(spark, axis):
    cube = cubes()["deep"]
    got = geometry.plane(slabs_of(spark, {"a": cube}), axis, F.lit(3)).collect()
    want = {(x, y, z): v for (x, y, z), v in np.ndenumerate(cube) if (x, y, z)[axis] == 3}
    assert {(r["x"], r["y"], r["z"]): r["v"] for r in got} == want and len(got) == len(want)
    assert geometry.plane(slabs_of(spark, {"a": cube}), axis, F.lit(99)).isEmpty()


# --- compressed files -------------------------------------------------------------------------


def test_unpacked_walks_all_members():
    body = bytes(range(256)) * 50
    one, two = gzip.compress(body, mtime=0), gzip.compress(body[::-1], mtime=0)
    whole = lambda raw, step=100: b"".join(files.unpacked(raw, step))
    assert whole(body) == body and whole(one) == body and whole(one + two) == body + body[::-1]
    assert whole(one + two + bytes(30)) == body + body[::-1] and whole(b"") == b"" and whole(gzip.compress(b"")) == b""
    assert max(map(len, files.unpacked(one, 64))) <= 64
    for cut in (1, 7, 8, 9, 40, len(one) - 5):
        with pytest.raises(EOFError):
            whole(one[:-cut])
        with pytest.raises(EOFError):
            whole(one + two[: len(two) - min(cut, len(two) - 3)])
    with pytest.raises(Exception, match="incorrect"):
        whole(one[:-6] + bytes([one[-6] ^ 1]) + one[-5:])
    with pytest.raises(Exception, match="after the last member"):
        whole(one + b"junk")


# --- repeated prediction ----------------------------------------------------------------------


def test_runs_over_block_borders(spark):
    """All runs in one plan give what each run by itself gives, over several blocks and for scans of several sizes."""
    draw = np.random.default_rng(1)
    s = slabs_of(spark, {"a": draw.normal(5, 2, (6, 5, 23)), "b": draw.normal(0, 1, (4, 4, 1)), "c": draw.uniform(0, 1, (3, 7, 40))})
    got = {(r["run"], r["scan_id"], r["z"]): np.array(r["px"]) for r in repeated.repeated_runs(s, 7, block=8).collect()}
    assert len(got) == 7 * (23 + 1 + 40)
    scans = s.select("scan_id").distinct()
    for run in (0, 2, 3, 5, 6):
        plan = augment.tta_plan(scans, 7).where(F.col("run") == run)
        for r in augment.apply_plan(s, plan, ["flip", "affine", "scale_percentiles", "contrast"]).collect():
            assert np.allclose(got[run, r["scan_id"], r["z"]], r["px"], atol=1e-9), (run, r["scan_id"], r["z"])


def test_warp_over_block_borders(spark):
    """A tilted warp of 70 slices in blocks of 32 equals the one sampled from the whole cube."""
    cube = cubes()["deep"]
    values = {"rx": 0.3, "ry": -0.2, "rz": 0.1, "tx": 1.0, "ty": -0.5, "tz": 2.0, "sx": 1.1, "sy": 0.9, "sz": 1.05}
    out = {r["z"]: np.array(r["px"]).reshape(5, 4) for r in warp.fixed_warp(slabs_of(spark, {"a": cube}), **values).collect()}
    want = warp.sampled(np.moveaxis(cube, 2, 0), 0, list(range(70)), cube.shape, values)
    assert all(np.allclose(out[z], want[z]) for z in range(70))


# --- early stop -------------------------------------------------------------------------------


def walked(scores, patience, min_delta):
    best, wait = float("inf"), 0
    for epoch, m in enumerate(scores):
        if m < best - min_delta:
            best, wait = m, 0
        else:
            wait += 1
            if wait >= patience:
                return epoch
    return None


@pytest.mark.parametrize(("patience", "min_delta"), [(3, 0.5), (8, 0.1), (40, 2.0), (1, 1e-9)])
def test_margin_against_a_walk(spark, patience, min_delta):
    """Runs with one record, with thousands, with ties and with steps of exactly the margin; one holds most rows."""
    draw = np.random.default_rng(patience)
    series = {
        1: (5000 - np.arange(4000) * 0.25 + draw.normal(0, 0.2, 4000)).tolist(), 2: [1.0], 3: [3.0, 3.0, 3.0, 2.5, 2.0, 1.5, 1.0, 1.0],
        4: draw.normal(0, 3, 300).tolist(), 5: list(range(20)), 6: (100 / (1 + np.arange(200))).tolist(),
    }
    rows = spark.createDataFrame([(k, e, float(m)) for k, v in series.items() for e, m in enumerate(v)], "run long, epoch long, metric double")
    got = dict(early_stop(rows.repartition(6), "run", "epoch", "metric", patience, min_delta).collect())
    assert got == {k: walked(v, patience, min_delta) for k, v in series.items()}
