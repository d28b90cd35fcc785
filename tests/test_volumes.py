"""Volume operators against plain numpy on small arrays."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import affine as A
from cohortlake.functions.metadata import fixed_text
from cohortlake.operators.volumes import geometry, intensity, masks, resample, stats, warp
from cohortlake.operators.volumes.slabs import standardised
from cohortlake.plans import augment, preprocess
from cohortlake.sources import files

SKEWED = [[0, 1.5, 0, 10], [-1.5, 0, 0, 20], [0, 0, 2, 30], [0, 0, 0, 1]]


def slabs_of(spark, arrays):
    rows = []
    for sid, a in arrays.items():
        nx, ny, nz = a.shape
        rows += [(sid, 0, z, nx, ny, nz, a[:, :, z].ravel().astype(float).tolist()) for z in range(nz)]
    return spark.createDataFrame(rows, "scan_id string, c int, z int, nx int, ny int, nz int, px array<double>")


def affine_of(spark, rows):
    data = [(sid, [[float(v) for v in r] for r in a]) for sid, a in rows.items()]
    return spark.createDataFrame(data, "scan_id string, affine array<array<double>>")


def arrays_of(slabs):
    out = {}
    for r in slabs.collect():
        a = out.setdefault(r["scan_id"], np.full((r["nx"], r["ny"], r["nz"]), np.nan))
        assert np.isnan(a[0, 0, r["z"]])  # no slice twice
        a[:, :, r["z"]] = np.array(r["px"]).reshape(r["nx"], r["ny"])
    return out


def cube(shape=(5, 6, 7), seed=0):
    return np.random.default_rng(seed).integers(10, 100, shape).astype(float)


def test_reorient_with_skewed_axes(spark):
    a = cube((4, 5, 6))
    s, aff = slabs_of(spark, {"v": a}), affine_of(spark, {"v": SKEWED})
    assert aff.select(A.orientation(F.col("affine"))).first()[0] == "PRS"
    out, moved, params = geometry.reorient(s, aff)
    # first voxel axis runs towards P, second towards R: swap them, reverse the old first axis
    assert np.array_equal(arrays_of(out)["v"], a.transpose(1, 0, 2)[:, ::-1, :])
    m = np.array(moved.first()["affine"])
    assert np.allclose(np.diag(m)[:3], [1.5, 1.5, 2]) and np.allclose(m[:3, 3], [10, 20 - 1.5 * 3, 30])
    back = params.select("scan_id", F.col("target").alias("codes"), F.col("codes").alias("target"))
    again, home, _ = geometry.reorient(out, moved, current=back)
    assert np.array_equal(arrays_of(again)["v"], a) and np.allclose(np.array(home.first()["affine"]), SKEWED)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_rotate90(spark, k):
    a = cube()
    assert np.array_equal(arrays_of(geometry.rotate90(slabs_of(spark, {"v": a}), k))["v"], np.rot90(a, k, (1, 2)))


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_flip(spark, axis):
    a = cube()
    assert np.array_equal(arrays_of(geometry.flip(slabs_of(spark, {"v": a}), axis))["v"], np.flip(a, axis))


def test_translate_fills_with_zero(spark):
    a = cube()
    want = np.zeros_like(a)
    want[2:, :-1, 3:] = a[:-2, 1:, :-3]
    assert np.array_equal(arrays_of(geometry.translate(slabs_of(spark, {"v": a}), 2, -1, 3))["v"], want)


def test_crop_and_pad_round_trip(spark):
    a = np.zeros((12, 14, 16))
    a[3:9, 4:10, 5:12] = cube((6, 6, 7))
    s, aff = slabs_of(spark, {"v": a, "blank": np.zeros((3, 3, 3))}), affine_of(spark, {"v": SKEWED, "blank": SKEWED})
    out, moved, params = geometry.crop_foreground(s, aff)
    got = arrays_of(out)
    assert got["v"].shape == (6, 6, 7) and got["blank"].shape == (3, 3, 3)
    origin = np.array({r["scan_id"]: r["affine"] for r in moved.collect()}["v"])[:3, 3]
    assert np.allclose(origin, np.array(SKEWED)[:3, :3] @ [3, 4, 5] + np.array(SKEWED)[:3, 3])
    back, home = geometry.uncrop(out, moved, params)
    assert np.array_equal(arrays_of(back)["v"], a)
    assert all(np.allclose(np.array(r["affine"]), SKEWED) for r in home.collect())
    padded, m2, p2 = geometry.pad(s, aff, (20, 20, 20))
    assert arrays_of(padded)["v"].shape == (20, 20, 20)
    assert np.array_equal(arrays_of(padded)["v"][4:16, 3:17, 2:18], a)
    assert np.array_equal(arrays_of(geometry.unpad(padded, m2, p2)[0])["v"], a)


def test_profile_and_undo(spark):
    a = np.zeros((6, 7, 8))
    a[1:5, 1:6, 2:7] = cube((4, 5, 5))
    vol = preprocess.Volumes(slabs_of(spark, {"v": a}), affine_of(spark, {"v": SKEWED}))
    steps = [("reorient", {}), ("crop_foreground", {}), ("pad", {"target_shape": [9, 9, 9]}), ("center_crop", {"target_shape": [8, 8, 8]})]
    done, history = preprocess.run_steps(vol, steps, history=True)
    assert arrays_of(done.slabs)["v"].shape == (8, 8, 8) and dict(done.slabs.dtypes)["px"] == "array<float>"
    back = preprocess.undo(done)
    assert np.array_equal(arrays_of(back.slabs)["v"], a) and np.allclose(np.array(back.affines.first()["affine"]), SKEWED)
    assert [h.first()["step"] for h in history] == [n for n, _ in steps]
    assert history[0].first()["output_hash"] == history[1].first()["input_hash"] != history[0].first()["input_hash"]
    assert preprocess.describe(steps).startswith("Load -> reorient")
    with pytest.raises(ValueError):
        preprocess.profile("spine")
    with pytest.raises(ValueError):
        preprocess.create("sharpen")


def linear(a, axis, size, ratio):
    n = a.shape[axis]
    out = []
    for i in range(size):
        p = i * ratio
        lo = int(np.floor(p))
        hi = min(lo + 1, n - 1)
        get = lambda k: np.take(a, k, axis)  # noqa: B023,E731
        out.append(np.zeros_like(get(0)) if p >= n - 0.5 else get(lo) * (1 - (p - lo)) + get(hi) * (p - lo))
    return np.stack(out, axis)


def test_resample_and_resize(spark):
    a = cube((5, 4, 6))
    s, aff = slabs_of(spark, {"v": a}), affine_of(spark, {"v": [[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1.5, 0], [0, 0, 0, 1]]})
    out, moved, params = resample.resample(s, aff, (1.0, 1.0, 1.0))
    want = linear(linear(a, 0, 10, 0.5), 2, 9, 1 / 1.5)
    assert np.allclose(arrays_of(out)["v"], want)
    assert np.allclose(np.diag(np.array(moved.first()["affine"])), [1, 1, 1, 1])
    small, _, _ = resample.resize(s, aff, (3, 7, 4))
    want = linear(linear(linear(a, 0, 3, 5 / 3), 1, 7, 4 / 7), 2, 4, 6 / 4)
    assert np.allclose(arrays_of(small)["v"], want)
    back, home = resample.restore_grid(out, moved, params)
    assert arrays_of(back)["v"].shape == a.shape and np.allclose(arrays_of(back)["v"][:, :, ::2][:4], a[:, :, ::2][:4])
    same, _, _ = resample.resample(s, aff, (2.0, 1.0, 1.5))
    assert np.array_equal(arrays_of(same)["v"], a)
    with pytest.raises(ValueError):
        resample.resize(s, aff, (3, 3, 3), "bspline")


def brute_dilate(m, r):
    out = np.zeros_like(m)
    for d in masks.ball(r):
        for p in np.argwhere(m > 0):
            q = p + d
            if (q >= 0).all() and (q < m.shape).all():
                out[tuple(q)] = 1
    return out


@pytest.mark.parametrize("r", [1, 2])
def test_morphology(spark, r):
    m = (np.random.default_rng(4).random((6, 7, 40)) > 0.9).astype(float)
    s = slabs_of(spark, {"v": m})
    # 40 slices make two blocks, so slices cross a block border
    assert np.array_equal(arrays_of(masks.dilate(s, r))["v"], brute_dilate(m, r))
    wide = np.pad(m, r)
    closed = 1 - brute_dilate(1 - brute_dilate(wide, r), r)
    assert np.array_equal(arrays_of(masks.closing(s, r))["v"], closed[r:-r, r:-r, r:-r])
    thick = 1 - m
    assert np.array_equal(arrays_of(masks.erode(slabs_of(spark, {"v": thick}), r))["v"], 1 - brute_dilate(m, r))


def test_warp_against_direct_sampling(spark):
    a = cube((6, 5, 37), 2)
    rot, t, s = (0.15, -0.12, 0.2), np.array([0.6, -0.3, 1.4]), np.array([1.1, 0.9, 1.05])
    got = arrays_of(warp.fixed_warp(slabs_of(spark, {"v": a}), **dict(zip(warp.WARP, [*rot, *t, *s]))))["v"]
    n = np.array(a.shape)
    want = np.zeros_like(a)
    for p in np.ndindex(*a.shape):
        q = warp.rotation(*rot) @ ((np.array(p) - (n - 1) / 2) * s + t) + (n - 1) / 2
        lo = np.floor(q).astype(int)
        for corner in np.ndindex(2, 2, 2):
            at = lo + corner
            if (at >= 0).all() and (at < n).all():
                want[p] += np.prod(np.where(corner, q - lo, 1 - (q - lo))) * a[tuple(at)]
    assert np.allclose(got, want)


def test_smooth_matches_convolution(spark):
    a = cube((4, 5, 36), 3)
    w = warp.gaussian_weights(0.7)
    want = a
    for axis in range(3):
        want = np.apply_along_axis(lambda v: np.convolve(v, w, "full")[len(w) // 2 :][: len(v)], axis, want)
    assert np.allclose(arrays_of(warp.gaussian_smooth(slabs_of(spark, {"v": a}), 0.7))["v"], want)


def test_statistics_and_quality(spark):
    a = cube((4, 5, 6))
    s = slabs_of(spark, {"v": a, "flat": np.full((3, 3, 2), 100.0)})
    got = {r["scan_id"]: r for r in stats.volume_statistics(s).collect()}
    assert got["v"]["std"] == pytest.approx(a.std()) and got["flat"]["std"] == 0
    con = {r["scan_id"]: r["contrast"] for r in stats.tissue_contrast(s).collect()}
    p10, p90 = np.percentile(a, [10, 90])
    assert con["v"] == pytest.approx((p90 - p10) / (p90 + p10 + 1e-5))
    mid = a[:, :, 3]
    g = np.floor((mid - mid.min()) / (mid.max() - mid.min()) * 255).astype(int)
    r = np.pad(g, 1, mode="reflect")
    lap = r[:-2, 1:-1] + r[2:, 1:-1] + r[1:-1, :-2] + r[1:-1, 2:] - 4 * g
    blur = {x["scan_id"]: x["blur"] for x in stats.blur_index(s).collect()}
    assert blur["v"] == pytest.approx(lap.var()) and blur["flat"] == 0.0
    z = arrays_of(intensity.normalise(s))["v"]
    assert abs(z.mean()) < 1e-9 and z.std() == pytest.approx(1)
    with pytest.raises(ValueError):
        intensity.normalise(s, "robust")


def test_slice_gap(spark):
    a = np.zeros((2, 2, 8)) + np.arange(8) * 0.1
    b = a.copy()
    b[:, :, 4:] += 50
    got = {r["scan_id"]: r["missing_slices"] for r in stats.slice_gaps(slabs_of(spark, {"a": a, "b": b, "few": b[:, :, 2:6]})).collect()}
    assert got == {"a": False, "b": True, "few": False}


def test_noise_is_stable_and_normal(spark):
    s = slabs_of(spark, {"v": np.zeros((20, 20, 10))})
    one = arrays_of(intensity.gaussian_noise(s, 2.0))["v"]
    assert np.array_equal(one, arrays_of(intensity.gaussian_noise(s.repartition(5), 2.0))["v"])
    assert abs(one.mean()) < 0.1 and one.std() == pytest.approx(2.0, abs=0.1)


def test_strong_plan_against_numpy(spark):
    """A whole augmentation profile with drawn parameters, replayed step by step."""
    arrays = {f"v{i}": cube((4, 5, 6), i) for i in range(6)}
    s = slabs_of(spark, arrays)
    scans = s.select("scan_id").distinct()
    order = ["RandFlip", "RandRotate90", "RandShiftIntensity", "RandScaleIntensity", "RandAdjustContrast"]
    plan = augment.augmentation_plan(scans, "strong").where(F.col("transform").isin(order))
    got = arrays_of(augment.apply_plan(s, plan, order))
    steps = {(r["scan_id"], r["transform"]): r["params"] for r in plan.collect()}
    for sid, a in arrays.items():
        for t in order:
            if (sid, t) not in steps:
                continue
            p = steps[sid, t]
            if t == "RandFlip":
                a = a[::-1]
            elif t == "RandRotate90":
                a = np.rot90(a, int(p["k"]), (1, 2))
            elif t == "RandShiftIntensity":
                a = a + p["offset"]
            elif t == "RandScaleIntensity":
                a = a * (1 + p["factor"])
            else:
                lo, span = a.min(), a.max() - a.min()
                a = ((a - lo) / (span + 1e-7)) ** p["gamma"] * span + lo
        assert np.allclose(got[sid], a), sid
    for name, steps_ in augment.PROFILES.items():
        assert augment.profile_metadata(name)["enabled_transforms"] == [n for n, _, _ in steps_]
    with pytest.raises(ValueError):
        augment.augmentation_plan(scans, "wild")
    with pytest.raises(ValueError):
        augment.apply_plan(s, plan, ["Rand3DElastic"])


def test_random_shift_augmentation_is_deterministic(spark):
    s = slabs_of(spark, {f"v{i}": cube(seed=i) for i in range(4)})
    one, two = (arrays_of(augment.random_shift_augmentation(d, seed=5)) for d in (s, s.repartition(3)))
    assert all(np.array_equal(one[k], two[k]) for k in one) and one["v0"].shape == (5, 6, 7)


def nifti(a, code=4, kind="<i2"):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into("<hh", head, 70, code, 16)
    struct.pack_into("<8f", head, 76, 1, 1.5, 1.5, 2, 1, 1, 1, 1)
    struct.pack_into("<fff", head, 108, 352, 0, 0)
    struct.pack_into("<hh", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *[v for row in SKEWED[:3] for v in row])
    head[344:348] = b"n+1\0"
    return bytes(head) + a.astype(kind).tobytes(order="F")


def png(rows):
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_files(spark, tmp_path):
    a = cube((10, 12, 14))
    (tmp_path / "plain.nii").write_bytes(nifti(a))
    (tmp_path / "zipped.nii.gz").write_bytes(gzip.compress(nifti(a)))
    (tmp_path / "renamed.jpg").write_bytes(nifti(a))
    (tmp_path / "broken.nii").write_bytes(b"not a scan")
    (tmp_path / "picture.nii.gz").write_bytes(png([[1, 2, 3], [4, 5, 6]]))
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    fmt = {r["path"].split("/")[-1]: r["format"] for r in files.detected(raw).collect()}
    assert fmt == {"plain.nii": "nifti", "zipped.nii.gz": "nifti", "renamed.jpg": "nifti", "broken.nii": "nifti", "picture.nii.gz": "image"}
    cat = {r["path"].split("/")[-1]: r for r in files.catalog(raw).collect()}
    assert cat["plain.nii"]["shape"] == [10, 12, 14] and cat["zipped.nii.gz"]["spacing"] == [1.5, 1.5, 2.0]
    assert np.allclose(np.array(cat["renamed.jpg"]["affine"]), SKEWED) and cat["broken.nii"]["error"]
    got = arrays_of(standardised(files.extract_slabs(raw)))
    assert len(got) == 3 and all(np.array_equal(v, a) for v in got.values())


def test_picture_source(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(png([[1, 2, 3], [4, 5, 250]]))
    s = files.read_images(spark, str(tmp_path))
    a = next(iter(arrays_of(s).values()))
    assert a.shape == (3, 2, 1) and a[:, :, 0].tolist() == [[1, 4], [2, 5], [3, 250]]
    head = files.image_headers(spark, str(tmp_path)).first()
    assert head["header"] == {"height": "2", "width": "3", "channels": "1"}


def test_fixed_text_matches_exact_rounding(spark):
    values = [194.78375, 0.03125, 2.5, -1.00005, 0.1 + 0.2, 1e-9, -1e-9, 123456.78905, float("nan"), float("inf"), None, 0.5, 1.00015]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(fixed_text(F.col("v"), 4), fixed_text(F.col("v"), 0)).collect()]
    assert got == [(None, None) if v is None else (f"{v:.4f}", f"{v:.0f}") for v in values]


def test_scan_without_its_first_slice_is_reported(spark):
    from cohortlake.operators.volumes import stats

    rows = [("whole", 0, z, 2, 2, 6, [float(z + i) for i in range(4)]) for z in range(6)]
    rows += [("beheaded", 0, z, 2, 2, 6, [float(z + i) for i in range(4)]) for z in range(1, 6)]
    slabs = spark.createDataFrame(rows, "scan_id string, c int, z int, nx int, ny int, nz int, px array<double>")
    spacing = spark.createDataFrame([(s, [1.0, 1.0, 1.0]) for s in ("whole", "beheaded")], "scan_id string, spacing array<double>")
    assert {r.scan_id for r in stats.quality_report(slabs, spacing).collect()} == {"whole", "beheaded"}
    assert {r.scan_id for r in stats.shape_text(slabs).collect()} == {"whole", "beheaded"}
    one = [F.lit(1)] * 3
    padded = geometry.place(slabs, one, [F.col(n) + 2 for n in ("nx", "ny", "nz")])
    assert {r.scan_id: r["count"] for r in padded.groupBy("scan_id").count().collect()} == {"whole": 8, "beheaded": 7}


def test_long_kernels_reach_over_block_borders(spark):
    n = 100
    rows = [("a", 0, z, 1, 1, n, [1.0 if z == 20 else 0.0], 4.0) for z in range(n)]
    slabs = spark.createDataFrame(rows, "scan_id string, c int, z int, nx int, ny int, nz int, px array<double>, s double")
    got = {r.z: r.px[0] for r in warp.gaussian_smooth(slabs, ("s", "s", "s")).collect()}
    want = np.array(warp.gaussian_weights(4.0))
    centre = warp.gaussian_weights(4.0)[len(want) // 2]
    for z in range(n):
        k = z - 20 + len(want) // 2
        expected = want[k] * centre * centre if 0 <= k < len(want) else 0.0
        assert abs(got[z] - expected) < 1e-9, z


def test_fixed_text_names_its_value_once(spark):
    """Written out, the steps named the value some thirty times, and the code of four texts in a row got too long."""
    df = spark.createDataFrame([(0.125,)], "v double").select(fixed_text(F.col("v") + 1, 4).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("v#") <= 3
    assert df.first()["t"] == "1.1250"


def test_scans_of_one_warp_share_its_corners(monkeypatch):
    """A fixed run warps all scans alike: its corners are worked out once, and parts of large slices give the same voxels."""
    import numpy as np

    made, own = [], warp.rotation
    monkeypatch.setattr(warp, "rotation", lambda *angles: made.append(angles) or own(*angles))
    values = {n: 0.0 for n in warp.WARP} | {"rx": 0.21, "ty": 0.4, "sx": 1.05, "sy": 1.0, "sz": 1.0}
    cubes = np.random.default_rng(3).normal(size=(5, 4, 3, 6))
    got = [warp.sampled(c, 0, [0, 1, 2, 3], (3, 6, 4), values) for c in cubes]
    assert len(made) == 1
    monkeypatch.setattr(warp, "POINTS", 18)
    monkeypatch.setattr(warp, "KEPT", 0)
    again = [warp.sampled(c, 0, [0, 1, 2, 3], (3, 6, 4), values) for c in cubes]
    assert np.array_equal(got, again) and len(made) == 1 + 5 * 4
