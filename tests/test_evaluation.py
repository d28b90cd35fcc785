"""Exact values of the evaluation operators, and brute-force checks on random predictions."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import losses, scoring
from cohortlake.operators import calibration, curves, cv, metrics, thresholds, tta
from cohortlake.operators.splits import stratified_kfold
from cohortlake.sources import tables


def preds(spark, y, p):
    return spark.createDataFrame([("r", a, float(b)) for a, b in zip(y, p)], "run string, y int, p double")


def test_calibration_error_exact(spark):
    df = preds(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert calibration.expected_calibration_error(df, ["run"], "y", "p").first()["ece"] == pytest.approx(0.15)
    assert calibration.expected_calibration_error(df.limit(0), [], "y", "p").first()["ece"] == 0.0


def test_bin_edges_follow_linspace(spark):
    # 0.6000000000000001 is the floating-point edge 6 * 0.1, 0.6 lies below it
    rows = spark.createDataFrame([(0.6,), (0.6000000000000001,), (0.0,), (1.0,)], "p double")
    got = [r[0] for r in rows.select(calibration.upper_closed_bin(F.col("p"), 10)).collect()]
    assert got == [5, 5, 0, 9]
    got = [r[0] for r in rows.select(calibration.lower_closed_bin(F.col("p"), 10)).collect()]
    assert got == [5, 6, 0, 9]


def test_perfect_separation(spark):
    df = preds(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9])
    best = thresholds.best_thresholds(thresholds.threshold_sweep(df, ["run"], "y", "p"), ["run"]).first()
    assert best["best_f1_value"] == 1.0 and best["best_f1_threshold"] == pytest.approx(0.41)
    scores = curves.ranking_scores(df, ["run"], "y", "p").first()
    assert scores["roc_auc"] == 1.0 and scores["pr_auc"] == 1.0


def test_single_class_defaults(spark):
    df = preds(spark, [1, 1, 1], [0.2, 0.6, 0.9])
    row = metrics.binary_summary(df, ["run"], "y", "p").first()
    assert (row["roc_auc"], row["pr_auc"], row["sensitivity"], row["specificity"]) == (0.5, 0.5, 0.0, 0.0)
    assert row["balanced_accuracy"] == pytest.approx(2 / 3)


def test_ranking_against_pairs(spark):
    rng = random.Random(1)
    y = [rng.randint(0, 1) for _ in range(400)]
    p = [round(rng.random(), rng.choice([1, 2, 6])) for _ in y]
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    df = preds(spark, y, p)
    got = curves.ranking_scores(df, ["run"], "y", "p").first()
    assert got["roc_auc"] == pytest.approx(pairs / len(pos) / len(neg))
    points = curves.roc_points(df, ["run"], "y", "p")
    assert curves.trapezoid_auc(points, ["run"]).first()["auc"] == pytest.approx(got["roc_auc"])
    full = curves.roc_points(df, ["run"], "y", "p", drop_collinear=False).collect()
    want = {(round(sum(b >= t for b in pos) / len(pos), 9), round(sum(b >= t for b in neg) / len(neg), 9)) for t in set(p)}
    assert {(round(r["tpr"], 9), round(r["fpr"], 9)) for r in full if r["threshold"] <= 1} == want
    # one partition or many: the same numbers
    again = curves.ranking_scores(df.repartition(7), ["run"], "y", "p").first()
    assert (again["roc_auc"], again["pr_auc"]) == (pytest.approx(got["roc_auc"]), pytest.approx(got["pr_auc"]))


def test_summary_matches_single_metrics(spark):
    rng = random.Random(5)
    y = [rng.randint(0, 1) for _ in range(200)]
    df = preds(spark, y, [rng.random() for _ in y])
    row = metrics.binary_summary(df, ["run"], "y", "p").first()
    cells = metrics.confusion_counts(df.withColumn("pred", (F.col("p") >= 0.5).cast("int")), ["run"])
    assert metrics.accuracy(cells, ["run"]).first()[1] == pytest.approx(row["accuracy"])
    assert metrics.balanced_accuracy(cells, ["run"]).first()[1] == pytest.approx(row["balanced_accuracy"])
    ss = metrics.sensitivity_specificity(cells, ["run"]).first()
    assert (ss[1], ss[2]) == (pytest.approx(row["sensitivity"]), pytest.approx(row["specificity"]))
    macro = metrics.class_scores(cells, ["run"]).agg(F.avg("f1")).first()[0]
    assert macro == pytest.approx(row["macro_f1"])


RUNS = {0: [[0.1, 0.9], [0.8, 0.2]], 1: [[0.3, 0.7], [0.7, 0.3]], 2: [[0.5, 0.5], [0.3, 0.7]]}


@pytest.mark.parametrize(
    "method, want",
    [
        ("mean", [[0.3, 0.7], [0.6, 0.4]]),
        ("median", [[0.3, 0.7], [0.7, 0.3]]),
        ("majority", [[0.0, 1.0], [1.0, 0.0]]),
    ],
)
def test_repeated_predictions(spark, method, want):
    rows = [(s, r, c, RUNS[r][s][c]) for r in RUNS for s in (0, 1) for c in (0, 1)]
    df = spark.createDataFrame(rows, "subject int, run int, cls int, prob double")
    got = {(r["subject"], r["cls"]): r["prob"] for r in tta.aggregate_runs(df, ["subject"], method).collect()}
    assert got == {(s, c): pytest.approx(want[s][c]) for s in (0, 1) for c in (0, 1)}


def test_unknown_names_raise(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.5)], "subject int, run int, cls int, prob double")
    with pytest.raises(ValueError):
        tta.aggregate_runs(df, ["subject"], "best")
    with pytest.raises(ValueError):
        losses.batch_loss("hinge", F.col("l"), F.col("y"))
    with pytest.raises(ValueError):
        losses.batch_loss("weighted_ce", F.col("l"), F.col("y"))


def test_lower_median_for_even_runs(spark):
    df = spark.createDataFrame([(0, r, 0, p) for r, p in enumerate([0.1, 0.4, 0.6, 0.9])], "subject int, run int, cls int, prob double")
    assert tta.tta_median(df, ["subject"]).first()["prob"] == 0.4


def test_cv_report_of_five_folds(spark):
    acc = [0.70, 0.72, 0.74, 0.76, 0.78]
    rows = cv.cv_summary(spark.createDataFrame(list(enumerate(acc)), "Fold int, Accuracy double"), ["Accuracy"]).collect()
    table = {r["Fold"]: r["Accuracy"] for r in rows}
    assert len(rows) == 7 and table["Mean"] == pytest.approx(0.74)
    assert table["Std"] == pytest.approx(0.0316227766)
    lone = cv.cv_summary(spark.createDataFrame([(0, 0.5)], "Fold int, Accuracy double"), ["Accuracy"]).collect()
    assert {r["Fold"]: r["Accuracy"] for r in lone}["Std"] is None


def test_fold_files(spark, tmp_path):
    head = "Subject,True_Label,Pred_Label,Probability_ASD,Probability_Control,Logit_ASD,Logit_Control,Correct\n"
    for f in (0, 1, 2, 4):
        (tmp_path / f"fold_{f}").mkdir()
        (tmp_path / f"fold_{f}" / "predictions.csv").write_text(
            head + f"s{f}a,Control,Control,0.1,0.9,-1,1,True\ns{f}b,Autism,Control,0.4,0.6,-1,1,False\n"
        )
    df = tables.read_fold_predictions(spark, str(tmp_path))
    assert df.count() == 8 and {r["Fold"] for r in df.select("Fold").distinct().collect()} == {0, 1, 2, 4}
    with pytest.raises(ValueError):
        cv.union_folds({})


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert [r["Fold"] for r in entry.entry(spark).orderBy("Fold").collect()] == ["0", "1", "2", "3", "4", "Mean", "Std"]


def test_small_classes_fall_back_to_plain_folds(spark):
    df = spark.createDataFrame([(i, "a" if i < 11 else "b") for i in range(13)], "subject int, label string")
    sizes = stratified_kfold(df, "subject", "label", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2]


def test_class_figures_cost_no_square_of_the_classes(spark):
    """One row of 1,500 logits: with the maximum or the sum worked out anew for every class this takes a minute."""
    n = 1500
    logits = [((i * 37) % 101) / 10 for i in range(n)]
    rows = spark.createDataFrame([(7, logits)], "y int, logits array<double>")
    record = scoring.prediction_record(F.lit("a"), "m", [f"c{i}" for i in range(n)], F.col("logits"))
    began = time.time()
    got = rows.select(
        record.alias("r"), losses.cross_entropy(F.col("logits"), F.col("y")).alias("ce"),
        losses.smoothed_cross_entropy(F.col("logits"), F.col("y"), 0.1).alias("ls"),
    ).first()
    assert time.time() - began < 20
    top = max(logits)
    lse = top + math.log(sum(math.exp(v - top) for v in logits))
    assert [p["probability"] for p in got["r"]["probabilities"]] == pytest.approx([math.exp(v - lse) for v in logits])
    assert got["r"]["metrics"]["confidence"] == max(p["probability"] for p in got["r"]["probabilities"])
    assert got["ce"] == pytest.approx(lse - logits[7])
    assert got["ls"] == pytest.approx(0.9 * (lse - logits[7]) + 0.1 / n * sum(lse - v for v in logits))


def test_class_figures_of_odd_logits(spark):
    """Nulls, no logits and numbers that are not finite."""
    nan = float("nan")
    rows = spark.createDataFrame([(1, [0.0, None]), (2, None), (3, [nan, 1.0]), (4, [1000.0, 0.0])], "k int, logits array<double>")
    got = {r["k"]: r["p"] for r in rows.select("k", scoring.softmax(F.col("logits")).alias("p")).collect()}
    assert got[1] == [None, None] and got[2] is None and all(math.isnan(v) for v in got[3]) and got[4] == [1.0, 0.0]
