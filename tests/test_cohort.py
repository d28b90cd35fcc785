"""Cohort building on small files: sources, integrity, splits, audit, run bookkeeping."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import audit, balance, cohort, runs, splits
from cohortlake.operators.ordered import group_percentiles, hash_rank, sorted_rank
from cohortlake.plans.compile import compile_cohort
from cohortlake.sources import files, tables

HEAD = "SUB_ID,DX_GROUP,SEX,AGE_AT_SCAN,SITE_ID,FIQ,VIQ,PIQ\n"


def phenotype_file(tmp_path, rows):
    path = tmp_path / "pheno.csv"
    path.write_text(HEAD + "\n".join(rows) + "\n")
    return str(path)


def ten_rows():
    return [f"{50952 + i},{1 + i % 2},{1 + i % 2},{10 + i}.5,NYU,{-9999 if i == 4 else 100 + i},108,115" for i in range(10)]


def paths(spark, ids):
    rows = [(f"/d/NYU/sub-00{i}/anat/sub-00{i}_T1w.nii.gz",) for i in ids]
    return spark.createDataFrame(rows, "path string")


def test_index_from_csv(spark, tmp_path):
    pheno = cohort.clean_phenotype(tables.read_phenotype(spark, phenotype_file(tmp_path, ten_rows())), "row_no")
    index = cohort.build_index(paths(spark, range(50952, 50962)), pheno).orderBy("subject_id").collect()
    assert len(index) == 10 and index[0]["subject_id"] == "sub-0050952"
    assert [r["label"] for r in index[:2]] == ["ASD", "CONTROL"] and index[4]["fiq"] is None
    assert index[3]["fiq"] == 103.0 and index[0]["age"] == 10.5 and index[0]["sex"] == "Male"


def test_last_row_of_a_subject_wins(spark, tmp_path):
    path = phenotype_file(tmp_path, ["7,1,1,9.0,NYU,1,1,1", "8,1,1,9.0,NYU,1,1,1", "007,2,2,11.0,USM,2,2,2"])
    rows = {r["sub_key"]: r for r in cohort.clean_phenotype(tables.read_phenotype(spark, path), "row_no").collect()}
    assert rows[7]["label"] == "CONTROL" and rows[7]["site"] == "USM" and len(rows) == 2


def test_missing_column(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("SUB_ID,SEX,AGE_AT_SCAN,SITE_ID\n1,1,9,NYU\n")
    with pytest.raises(cohort.ValidationFailed, match="DX_GROUP"):
        tables.read_phenotype(spark, str(path))


def test_orphans_and_duplicates(spark, tmp_path):
    pheno = cohort.clean_phenotype(tables.read_phenotype(spark, phenotype_file(tmp_path, ten_rows())), "row_no")
    index = cohort.build_index(paths(spark, [50952, 50999]), pheno)
    assert [r["rule"] for r in cohort.orphan_scans(index).collect()] == ["no phenotype row"]
    twice = index.where("has_phenotype").unionByName(index.where("has_phenotype"))
    with pytest.raises(cohort.ValidationFailed, match="duplicate subject"):
        cohort.validate_index(twice)
    with pytest.raises(cohort.ValidationFailed, match="missing field label"):
        cohort.validate_index(index)
    with pytest.raises(cohort.ValidationFailed, match="does not exist"):
        cohort.validate_index(index.where("has_phenotype"), paths(spark, [1]))
    with pytest.raises(cohort.ValidationFailed, match="empty"):
        cohort.validate_index(index.limit(0))


def golden_subjects(spark):
    return spark.createDataFrame(
        [(f"s{i:05d}", "ASD" if i < 531 else "CONTROL") for i in range(1102)], "subject_id string, label string"
    )


def test_known_split_quotas(spark):
    """Sizes and class quotas of a published cohort of 531 + 571 subjects."""
    parts = splits.stratified_split(golden_subjects(spark), "subject_id", "label")
    got = {(r["split"], r["label"]): r["count"] for r in parts.groupBy("split", "label").count().collect()}
    assert got == {
        ("train", "ASD"): 372, ("train", "CONTROL"): 399, ("val", "ASD"): 79, ("val", "CONTROL"): 86,
        ("test", "ASD"): 80, ("test", "CONTROL"): 86,
    }
    folds = splits.stratified_kfold(golden_subjects(spark), "subject_id", "label", 5)
    got = {(r["fold"], r["label"]): r["count"] for r in folds.groupBy("fold", "label").count().collect()}
    assert (got[0, "ASD"], got[0, "CONTROL"]) == (107, 114)
    cover = cohort.split_coverage(parts, golden_subjects(spark)).first()
    assert tuple(cover) == (1102, 1102, 0, 0, 0)


def test_split_is_seeded_and_partition_free(spark):
    df = golden_subjects(spark)
    key = lambda d: {(r["subject_id"], r["split"]) for r in d.collect()}
    a = key(splits.random_split(df, "subject_id", seed=1))
    assert a == key(splits.random_split(df.repartition(13), "subject_id", seed=1))
    assert a != key(splits.random_split(df, "subject_id", seed=2))
    for bad in ((0.8, 0.3, 0.1), (-0.1, 0.6, 0.5)):
        with pytest.raises(ValueError):
            splits.random_split(df, "subject_id", *bad)


def test_tiny_cohort_is_split_without_strata(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "subject_id int, label string")
    sizes = {r["split"]: r["count"] for r in splits.stratified_split(df, "subject_id", "label").groupBy("split").count().collect()}
    assert sizes == {"train": 7, "val": 1, "test": 2}


def test_fold_bounds(spark):
    roles = splits.expand_folds(splits.kfold(golden_subjects(spark), "subject_id", 5), "subject_id", 5)
    assert cohort.in_fold(golden_subjects(spark), roles, 4, "val").count() == 222
    with pytest.raises(ValueError):
        cohort.in_fold(golden_subjects(spark), roles, 5, "val")


def test_split_and_fold_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"], "test": []}, indent=1))
    (tmp_path / "f.json").write_text(json.dumps([{"train": ["a"], "val": ["b"]}, {"train": ["b"], "val": ["a"]}], indent=1))
    (tmp_path / "i.json").write_text(json.dumps([{"subject_id": "a", "path": "/a", "label": "ASD"}, {"subject_id": "c", "path": "/c"}], indent=1))
    s = tables.read_splits(spark, str(tmp_path / "s.json"))
    assert s.count() == 3
    assert cohort.in_split(tables.read_index(spark, str(tmp_path / "i.json")), s, "val").first()["subject_id"] == "c"
    assert cohort.in_split(tables.read_index(spark, str(tmp_path / "i.json")), s, "other").count() == 0
    f = tables.read_folds(spark, str(tmp_path / "f.json"))
    assert f.where("fold = 1 AND role = 'val'").first()["subject_id"] == "a" and f.count() == 4


def test_compile_writes_all_tables(spark, tmp_path):
    index = golden_subjects(spark).select(
        "subject_id", F.concat(F.lit("/p/"), "subject_id").alias("path"), "label", F.lit("Male").alias("sex"),
        F.lit(12.5).alias("age"), F.lit("NYU").alias("site"),
    )
    out = compile_cohort(index, str(tmp_path / "out"))
    stats = spark.read.parquet(out["statistics"]).first()
    assert stats["total_mri_scans"] == 1102 and stats["asd_count"] == 531 and stats["site_distribution"] == {"NYU": 1102}
    assert spark.read.parquet(out["folds"]).count() == 5510
    bal = spark.read.parquet(out["fold_balance"]).where("fold = 0 AND role = 'val' AND label = 'ASD'").first()
    assert (bal["n"], bal["total"]) == (107, 221)


def test_layout_builders(spark):
    rows = [("CONTROL", "s1", "CONTROL/s1/scan.nii.gz"), ("asd_site", "s2", "asd_site/s2/b.nii"), ("asd_site", "s2", "asd_site/s2/a.nii"), ("junk", "s3", "junk/s3/x.nii")]
    from cohortlake.functions import paths as P

    df = spark.createDataFrame(rows, "class_dir string, subject_id string, path string")
    got = cohort.class_folder_index(df, P.two_class_label(F.col("class_dir")), [("nifti", F.contains("path", F.lit(".nii")))]).orderBy("subject_id").collect()
    assert [(r["subject_id"], r["path"], r["label"]) for r in got] == [("s1", "CONTROL/s1/scan.nii.gz", "CONTROL"), ("s2", "asd_site/s2/a.nii", "ASD")]


def test_modalities(spark):
    rows = [("B1", f"/d/B1/B1_{m}.nii.gz") for m in ("t1", "t1ce", "t2", "flair", "seg")] + [("B2", f"/d/B2/B2_{m}.nii.gz") for m in ("t1", "t1ce", "t2")]
    found = spark.createDataFrame(rows, "subject_id string, path string")
    subjects = spark.createDataFrame([("B1",), ("B2",), ("B3",)], "subject_id string")
    index = cohort.modality_index(subjects, found).orderBy("subject_id")
    a, b, c = index.collect()
    assert set(a["channels"]) == {"t1", "t1ce", "t2", "flair"} and a["has_mask"] and not b["has_mask"] and c["channels"] == {}
    gaps = {r["subject_id"]: r["modality"] for r in cohort.ragged_modalities(index).collect()}
    assert gaps == {"B2": "flair", "B3": "t1"}
    assert {r["modality"]: r["missing"] for r in cohort.missing_modalities(index).collect()}["total_missing_channels"] == 5


def test_discovery_on_disk(spark, tmp_path):
    for p in ("AD/s1/t1.nii.gz", "CN/s2/series/1.dcm", "CN/s2/series/2.dcm", "CN/s3/p.PNG", "CN/s3/readme.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = files.discover_scans(files.list_files(spark, str(tmp_path)))
    tails = {(r["path"].split(tmp_path.name + "/")[1], r["kind"]) for r in got.collect()}
    assert tails == {("AD/s1/t1.nii.gz", "file"), ("CN/s2/series", "series"), ("CN/s3/p.PNG", "file")}


def test_audit_of_three_scans(spark):
    rows = [("AD/sub-01/t1.nii.gz", "sub-01", "AD", True), ("AD/sub-02/broken.nii.gz", "sub-02", "AD", False), ("CN/sub-03/t1.nii.gz", "sub-03", "CN", True)]
    scans = spark.createDataFrame(rows, "path string, subject string, class string, valid boolean").select(
        "*", F.lit("nifti").alias("format"), F.array(*[F.lit(1.0)] * 3).alias("spacing"), F.array(*[F.lit(8)] * 3).alias("dims"),
        F.lit("Anonymous_Patient").alias("patient_id"), F.lit(None).cast("string").alias("manufacturer"),
    )
    rep = audit.audit_report(scans).first()
    assert (rep["total_subjects"], rep["total_files"], rep["corrupt_count"]) == (3, 3, 1)
    assert rep["class_balance"] == {"AD": 1, "CN": 1} and rep["mean_spacing"] == [1.0, 1.0, 1.0]
    assert rep["missing_metadata_count"] == 2 and rep["scanner_manufacturers"] == {"Unknown": 2}


def test_run_documents(spark, tmp_path):
    docs = {"focal": '{"best_val_roc_auc": 0.85, "training_time": 120.5, "best_epoch": 3, "macro_f1": 0.7}', "ce": '{"best_val_macro_f1": null, "macro_f1": 0.7}', "bad": "{oops"}
    for name, text in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "experiment_meta.json").write_text(text)
    meta = runs.parse_metadata(tables.read_run_metadata(spark, str(tmp_path)))
    rep = {r["Loss_Function"]: r for r in runs.run_report(meta, "run", "Loss_Function", runs.LOSS_REPORT).collect()}
    assert set(rep) == {"focal", "ce"} and rep["focal"]["ROC_AUC"] == 0.85 and rep["focal"]["F1"] == 0.7
    assert rep["ce"]["F1"] is None and rep["ce"]["ROC_AUC"] == 0.0


def walk(scores, patience, delta):
    best, wait = float("inf"), 0
    for e, s in enumerate(scores):
        if s is None:
            continue
        if s < best - delta:
            best, wait = s, 0
        else:
            wait += 1
            if wait >= patience:
                return e
    return None


@pytest.mark.parametrize("delta", [0.0, 0.3])
def test_early_stop_against_loop(spark, delta):
    rng = random.Random(3)
    series = {r: [None if rng.random() < 0.1 else round(5 - 0.05 * e * (r % 3) + rng.random(), 3) for e in range(60)] for r in range(12)}
    rows = [(r, e, s) for r, ss in series.items() for e, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "run int, epoch int, loss double").repartition(5)
    got = {r["run"]: r["stop_epoch"] for r in runs.early_stop(df, "run", "epoch", "loss", 6, delta).collect()}
    assert got == {r: walk(ss, 6, delta) for r, ss in series.items()}


def test_ranks_and_percentiles(spark):
    rng = random.Random(9)
    rows = [(i % 3, i, round(rng.random(), 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(6)
    by_sort = {r["i"]: r["rn"] for r in sorted_rank(df.select("i"), ["i"]).collect()}
    assert by_sort == {i: i + 1 for i in range(500)}
    ranks = hash_rank(df.select("g", "i"), ["g"], "i", 42).groupBy("g").agg(F.collect_set("rn").alias("r"), F.count("*").alias("n")).collect()
    assert all(sorted(r["r"]) == list(range(1, r["n"] + 1)) for r in ranks)
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", 0.37).alias("p")).collect()}
    got = {r["g"]: r["p"] for r in group_percentiles(df, ["g"], "v", {"p": 0.37}).collect()}
    assert got == {g: pytest.approx(v) for g, v in want.items()}


def test_cache_report(spark):
    subs = spark.createDataFrame([(f"s{i}",) for i in range(20)], "subject_id string")
    cached = subs.select("*", F.array(*[F.lit(v) for v in (1, 8, 8, 8)]).alias("shape"), F.lit("torch.float32").alias("dtype"), F.lit(True).alias("readable"))
    good = runs.cache_report(subs, cached, "h", "h", (1, 8, 8, 8)).first()
    assert good["valid"] and good["subjects_checked"] == 20
    assert not runs.cache_report(subs, cached, "old", "h", (1, 8, 8, 8)).first()["valid"]


def test_batches_keep_short_tail(spark):
    df = spark.createDataFrame([(i, None if i == 2 else 1) for i in range(7)], "subject_id int, label int")
    rows = cohort.batches(df, ["subject_id"], 3, ["subject_id", "label"]).orderBy("batch").collect()
    assert [r["subject_id"] for r in rows] == [[0, 1, 2], [3, 4, 5], [6]] and rows[0]["label"] == [1, 1, -1]


def test_balance_keeps_unknown(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "label string")
    assert {r["label"]: r["n"] for r in balance.class_balance(df, "label", keep_null=True).collect()} == {"a": 2, "Unknown": 1}
    assert {r["label"]: r["n"] for r in balance.class_balance(df, "label").collect()} == {"a": 2}


def test_unlabelled_subjects_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(60)], "subject int, label string")
    for folds in (splits.round_robin_kfold(df, "subject", "label", 5), splits.stratified_kfold(df, "subject", "label", 5)):
        assert folds.count() == 60 and folds.where("label IS NULL").count() == 12
    assert splits.stratified_split(df, "subject", "label").count() == 60


def test_split_without_held_out_part(spark):
    from cohortlake.operators import splits

    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(99, None)], "s long, y string")
    assert {r.split for r in splits.stratified_split(df, "s", "y", 1.0, 0.0, 0.0).collect()} == {"train"}
    with pytest.raises(ValueError):
        splits.stratified_split(df, "s", "y", 0.5, 0.1, 0.1)


def test_running_keeps_null_groups(spark):
    from cohortlake.operators import runs

    rows = [(1, None, 0.5, "COMPLETE"), (2, None, 0.7, "COMPLETE"), (1, "a", 0.1, "COMPLETE")]
    df = spark.createDataFrame(rows, "trial_number long, study string, value double, state string")
    got = {(r.study, r.trial_number): r.best_so_far for r in runs.running_best(df, ["study"]).collect()}
    assert got == {(None, 1): 0.5, (None, 2): 0.7, ("a", 1): 0.1}
