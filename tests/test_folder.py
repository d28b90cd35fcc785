"""Folder audit on files of known faults."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import pytest

from cohortlake.operators import audit
from cohortlake.plans import folder
from cohortlake.workloads import volumes as W


def nifti(cube):
    return next(W._encode([pd.DataFrame({"vec_id": [1], "embedding": [np.asarray(cube, "<f4").ravel()]})]))["content"][0]


@pytest.fixture
def root(tmp_path):
    cube = np.arange(64, dtype=np.float32)
    flat, sound = nifti(np.ones(64)), nifti(cube)
    blank = cube.reshape(4, 4, 4).copy()
    blank[:, :, 2] = 3
    packed = gzip.compress(sound, mtime=0)
    files = {
        "AD/s1/a.nii": sound, "AD/s1/b.nii.gz": packed, "AD/s2/cut.nii.gz": packed[: len(packed) // 2],
        "CN/s3/flat.nii": flat, "CN/s3/blank.nii": nifti(blank), "other/tumor_x.NII": sound, "top.nii": sound, "AD/s1/notes.txt": b"no scan",
        "AD/s4/empty.nii": b"", "CN/s5/two.nii.gz": gzip.compress(sound[:200]) + gzip.compress(sound[200:]),
        "CN/s6/p.PNG": W._png(np.arange(64, dtype=np.uint8).reshape(8, 8)), "CN/s6/broken.png": b"\x89PNG\r\n\x1a\nrest",
        "CN/s7/run/i1.dcm": bytes(128) + b"DICM", "CN/s7/run/i2.dcm": bytes(128) + b"DICM", "CN/s8/run/i1.dcm": b"nothing",
    }
    for name, content in files.items():
        at = tmp_path / "data set" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    return str(tmp_path / "data set")


def test_folder_audit(spark, root):
    scans = folder.audited_scans(spark, root)
    rows = {r.path: r for r in scans.collect()}
    sound = {"AD/s1/a.nii", "AD/s1/b.nii.gz", "other/tumor_x.NII", "top.nii", "CN/s5/two.nii.gz", "CN/s6/p.PNG", "CN/s7/run"}
    broken = {"AD/s2/cut.nii.gz", "CN/s3/flat.nii", "CN/s3/blank.nii", "CN/s6/broken.png", "CN/s8/run"}
    assert {p for p, r in rows.items() if r.valid} == sound
    assert "AD/s4/empty.nii" not in rows  # file sources pass over files of no bytes
    assert {r.path for r in audit.corrupt_files(scans).collect()} == broken
    assert rows["CN/s7/run"].kind == "series" and rows["AD/s2/cut.nii.gz"].error.startswith("EOFError")
    assert rows["other/tumor_x.NII"]["class"] == "TUMOR" and rows["CN/s3/flat.nii"].subject == "s3"
    assert len(rows["CN/s3/flat.nii"].errors) == 2 and len(rows["CN/s3/blank.nii"].errors) == 1


def test_folder_report(spark, root):
    report = folder.folder_report(folder.audited_scans(spark, root)).first()
    assert (report.total_files, report.corrupt_count, report.missing_metadata_count) == (12, 5, 7)
    assert report.formats_present == ["dicom", "image", "nifti"] and report.class_balance == {"AD": 2, "CN": 3, "TUMOR": 1, "Unknown": 1}
    assert sorted(report.unique_dimensions) == [[4, 4, 4], [8, 8, 1]] and report.min_spacing == [1.0, 1.0, 1.0]


def test_empty_and_missing_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert folder.audited_scans(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="no folder"):
        folder.audited_scans(spark, str(tmp_path / "absent"))


def test_files_are_read_once(spark, root, monkeypatch):
    plans = []

    def stored(df, name, of=folder.materialised):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return of(df, name)

    monkeypatch.setattr(folder, "materialised", stored)
    folder.audited_scans(spark, root)
    text = "\n".join(plans)
    assert (text.count("FileScan binaryFile"), text.count("FileScan image")) == (1, 1)


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "run").mkdir()
    for k in range(600):
        (tmp_path / "run" / f"p{k}.dcm").write_bytes(b"slice")
    parts, before = [], spark.conf.get("spark.sql.files.openCostInBytes")

    def stored(df, name, of=folder.materialised):
        if name == "folder-files":
            parts.append(df.rdd.getNumPartitions())
        return of(df, name)

    monkeypatch.setattr(folder, "materialised", stored)
    assert folder.audited_scans(spark, str(tmp_path)).count() == 1
    assert parts and parts[0] <= spark.sparkContext.defaultParallelism + 1
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_grey_of_pictures(spark, tmp_path):
    from cohortlake.sources import files

    def colour(picture):
        rows, cols, _ = picture.shape
        chunk = lambda kind, body: W.struct.pack(">I", len(body)) + kind + body + W.struct.pack(">I", W.zlib.crc32(kind + body))
        lines = b"".join(b"\0" + row.tobytes() for row in picture)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", W.struct.pack(">IIBBBBB", cols, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", W.zlib.compress(lines)) + chunk(b"IEND", b"")

    rng = np.random.default_rng(5)
    flat = np.full((3, 4, 3), 90, np.uint8)
    same_grey = flat.copy()
    same_grey[0, 0] = (90, 90, 91)  # another colour, rounded to the same grey
    for name, p in {"flat": flat, "grey": same_grey, "any": rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)}.items():
        (tmp_path / f"{name}.png").write_bytes(colour(p))
    (tmp_path / "one.png").write_bytes(W._png(np.full((2, 2), 7, np.uint8)))
    got = {r.scan_id: (r["shape"], r.intensity_valid) for r in files.judged_images(spark, str(tmp_path)).collect()}
    want = {r.scan_id: ([r.nx, r.ny, r.nz], max(r.px) > min(r.px)) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got == want and sorted(v for _, v in got.values()) == [False, False, False, True]


def test_files_are_written_by_all_cores(spark, tmp_path):
    at, n = str(tmp_path), 64
    rows = [(k, [float(k + i) for i in range(64)]) for k in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    tracker, group = spark.sparkContext.statusTracker(), "test-write-files"
    spark.sparkContext.setJobGroup(group, "files of a table of one part")
    try:
        root = W.scan_folder(spark, at)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    assert files.count() == n
