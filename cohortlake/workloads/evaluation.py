"""Evaluation of scored predictions: metrics, curves, calibration, thresholds, cross-validation, TTA, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import losses, scoring
from cohortlake.operators import calibration, curves, cv, metrics, thresholds, tta
from cohortlake.operators.ordered import value_edges
from cohortlake.operators.splits import stratified_kfold
from cohortlake.session import fresh_path
from cohortlake.sources import tables
from cohortlake.workloads import standins as S
from cohortlake.workloads.standins import with_

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def cells_of(spark, sf):
    """Binary confusion cells at threshold 0.5, per run."""
    df = S.predictions(spark, sf).withColumn("pred", scoring.threshold_decision(F.col("p")))
    return metrics.confusion_counts(df, ["run"])


BIN = with_("preds", rest="b AS (SELECT run, y, CASE WHEN p>=0.5 THEN 1 ELSE 0 END AS pred FROM preds)")


@query("A19_confusion_matrix", with_("multi") + """, l AS (SELECT DISTINCT run, y AS k FROM multi UNION SELECT DISTINCT run, pred FROM multi),
c AS (SELECT run, y, pred, count(*) n FROM multi GROUP BY ALL)
SELECT a.run, a.k AS y, b.k AS pred, CAST(coalesce(c.n,0) AS BIGINT) AS n FROM l a JOIN l b ON a.run=b.run
LEFT JOIN c ON c.run=a.run AND c.y=a.k AND c.pred=b.k""")
def _(spark, sf):
    cells = metrics.confusion_counts(S.multiclass(spark, sf), ["run"])
    return metrics.confusion_matrix(cells, ["run"]).select("run", "y", "pred", F.col("n").cast("bigint").alias("n"))


@query("A20_accuracy", BIN + "SELECT run, round(avg(CASE WHEN y=pred THEN 1.0::DOUBLE ELSE 0 END),6) AS accuracy FROM b GROUP BY run")
def _(spark, sf):
    return rounded(metrics.accuracy(cells_of(spark, sf), ["run"]), "accuracy")


PRF = """, m AS ({src}), labels AS (SELECT DISTINCT run, y AS k FROM m UNION SELECT DISTINCT run, pred FROM m),
pc AS (SELECT l.run, l.k, count(*) FILTER (m.y=l.k AND m.pred=l.k)::DOUBLE tp, count(*) FILTER (m.pred=l.k)::DOUBLE pr,
 count(*) FILTER (m.y=l.k)::DOUBLE su FROM labels l JOIN m ON m.run=l.run GROUP BY l.run, l.k),
sc AS (SELECT *, CASE WHEN pr>0 THEN tp/pr ELSE 0 END AS prec, CASE WHEN su>0 THEN tp/su ELSE 0 END AS rec,
 CASE WHEN pr+su>0 THEN 2*tp/(pr+su) ELSE 0 END AS f1 FROM pc)
"""
PRF_BIN = BIN + PRF.format(src="SELECT * FROM b")
PRF_MULTI = with_("multi") + PRF.format(src="SELECT run, y, pred FROM multi")


@query("A21_precision_recall_f1_binary", PRF_BIN + """SELECT run, round(max(prec) FILTER (k=1),6) AS precision,
round(max(rec) FILTER (k=1),6) AS recall, round(max(f1) FILTER (k=1),6) AS f1 FROM sc GROUP BY run""")
def _(spark, sf):
    return rounded(metrics.precision_recall_f1(cells_of(spark, sf), ["run"]), "precision", "recall", "f1")


@query("A21_precision_recall_f1_macro", PRF_MULTI + """SELECT run, round(avg(prec),6) AS precision, round(avg(rec),6) AS recall,
round(avg(f1),6) AS f1 FROM sc GROUP BY run""")
def _(spark, sf):
    cells = metrics.confusion_counts(S.multiclass(spark, sf), ["run"])
    return rounded(metrics.precision_recall_f1(cells, ["run"]), "precision", "recall", "f1")


@query("A22_classification_report", PRF_MULTI + """SELECT run, CAST(k AS VARCHAR) AS label, round(prec,6) AS precision, round(rec,6) AS recall, round(f1,6) AS f1, CAST(su AS BIGINT) AS support FROM sc
UNION ALL SELECT run, 'accuracy', round(sum(tp)/sum(su),6), round(sum(tp)/sum(su),6), round(sum(tp)/sum(su),6), CAST(sum(su) AS BIGINT) FROM sc GROUP BY run
UNION ALL SELECT run, 'macro avg', round(avg(prec),6), round(avg(rec),6), round(avg(f1),6), CAST(sum(su) AS BIGINT) FROM sc GROUP BY run
UNION ALL SELECT run, 'weighted avg', round(sum(prec*su)/sum(su),6), round(sum(rec*su)/sum(su),6), round(sum(f1*su)/sum(su),6), CAST(sum(su) AS BIGINT) FROM sc GROUP BY run""")
def _(spark, sf):
    cells = metrics.confusion_counts(S.multiclass(spark, sf), ["run"])
    return rounded(metrics.classification_report(cells, ["run"]), "precision", "recall", "f1")


@query("A23_balanced_accuracy", PRF_MULTI + "SELECT run, round(avg(rec) FILTER (su>0),6) AS balanced_accuracy FROM sc GROUP BY run")
def _(spark, sf):
    cells = metrics.confusion_counts(S.multiclass(spark, sf), ["run"])
    return rounded(metrics.balanced_accuracy(cells, ["run"]), "balanced_accuracy")


@query("A24_sensitivity_specificity", BIN + """SELECT run, round(count(*) FILTER (y=1 AND pred=1)/count(*) FILTER (y=1)::DOUBLE,6) AS sensitivity,
round(count(*) FILTER (y=0 AND pred=0)/count(*) FILTER (y=0)::DOUBLE,6) AS specificity FROM b GROUP BY run""")
def _(spark, sf):
    return rounded(metrics.sensitivity_specificity(cells_of(spark, sf), ["run"]), "sensitivity", "specificity")


# the AUC oracle counts concordant pairs through cumulative negatives per distinct score
AUC_SQL = """, t AS (SELECT run, p, count(*) FILTER (y=1)::DOUBLE pos, count(*) FILTER (y<>1)::DOUBLE neg FROM {src} GROUP BY run, p),
c AS (SELECT *, sum(neg) OVER (PARTITION BY run ORDER BY p) - neg AS below,
 sum(pos) OVER (PARTITION BY run ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY run ORDER BY p DESC) AS fp FROM t),
a AS (SELECT run, sum(pos) n_p, sum(neg) n_n, sum(pos*(below+neg/2)) u, sum(pos*tp/(tp+fp)) ap FROM c GROUP BY run)
"""


def _auc(src):
    return with_(src) + AUC_SQL.format(src=src)


AUC_OUT = "SELECT run, round(CASE WHEN n_p>0 AND n_n>0 THEN u/(n_p*n_n) ELSE 0.5 END,6) AS roc_auc FROM a"
AP_OUT = "SELECT run, round(CASE WHEN n_p>0 AND n_n>0 THEN ap/n_p ELSE 0.5 END,6) AS pr_auc FROM a"


@query("A25_roc_auc", _auc("preds") + AUC_OUT)
def _(spark, sf):
    return rounded(curves.roc_auc(S.predictions(spark, sf), ["run"], "y", "p"), "roc_auc")


@query("A25_roc_auc_fine_scores", _auc("fine") + AUC_OUT)
def _(spark, sf):
    return rounded(curves.roc_auc(S.fine_predictions(spark, sf), ["run"], "y", "p"), "roc_auc")


@query("A25_A27_ranking_imbalanced", _auc("docs") + "SELECT run, round(CASE WHEN n_p>0 AND n_n>0 THEN u/(n_p*n_n) ELSE 0.5 END,6) AS roc_auc, round(CASE WHEN n_p>0 AND n_n>0 THEN ap/n_p ELSE 0.5 END,6) AS pr_auc FROM a")
def _(spark, sf):
    return rounded(
        curves.ranking_scores(S.document_predictions(spark, sf), ["run"], "y", "p"), "roc_auc", "pr_auc"
    )


@query("A26_roc_auc_one_vs_rest", with_("multi", rest="""long AS (SELECT run, 0 cls, CASE WHEN y=0 THEN 1 ELSE 0 END y, s0 p FROM multi
 UNION ALL SELECT run, 1, CASE WHEN y=1 THEN 1 ELSE 0 END, s1 FROM multi UNION ALL SELECT run, 2, CASE WHEN y=2 THEN 1 ELSE 0 END, s2 FROM multi),
t AS (SELECT run, cls, p, count(*) FILTER (y=1)::DOUBLE pos, count(*) FILTER (y=0)::DOUBLE neg FROM long GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY run, cls ORDER BY p) - neg AS below FROM t),
a AS (SELECT run, cls, sum(pos*(below+neg/2))/(sum(pos)*sum(neg)) auc FROM c GROUP BY run, cls)""") + "SELECT run, round(avg(auc),6) AS roc_auc FROM a GROUP BY run")
def _(spark, sf):
    scores = {k: f"s{k}" for k in range(3)}
    return rounded(curves.roc_auc_ovr(S.multiclass(spark, sf), ["run"], "y", scores), "roc_auc")


@query("A27_average_precision", _auc("preds") + AP_OUT)
def _(spark, sf):
    return rounded(curves.average_precision(S.predictions(spark, sf), ["run"], "y", "p"), "pr_auc")


ROC_SQL = """, n AS (SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS rn, sum(pos) OVER (PARTITION BY run) n_p, sum(neg) OVER (PARTITION BY run) n_n
 FROM c WINDOW w AS (PARTITION BY run ORDER BY p DESC)),
pts AS (SELECT run, p AS threshold, tp/n_p AS tpr, fp/n_n AS fpr FROM n WHERE rn=1 OR npos IS NULL OR npos<>pos OR nneg<>neg
 UNION ALL SELECT DISTINCT run, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM n)
"""


def _roc_rows(preds):
    """All points of the curve; the opening one has an infinite threshold, so thresholds are text."""
    points = rounded(curves.roc_points(preds, ["run"], "y", "p"), "tpr", "fpr")
    inf = F.col("threshold") == float("inf")
    return points.withColumn("threshold", F.when(inf, "inf").otherwise(F.format_string("%.8f", "threshold")))


@query("W10_roc_curve", _auc("preds") + ROC_SQL + "SELECT run, printf('%.8f', threshold) AS threshold, round(tpr,6) AS tpr, round(fpr,6) AS fpr FROM pts")
def _(spark, sf):
    return _roc_rows(S.predictions(spark, sf))


@query("W10_roc_curve_fine_scores", _auc("fine") + ROC_SQL + "SELECT run, printf('%.8f', threshold) AS threshold, round(tpr,6) AS tpr, round(fpr,6) AS fpr FROM pts")
def _(spark, sf):
    return _roc_rows(S.fine_predictions(spark, sf))


@query("W11_pr_curve", _auc("docs") + """SELECT c.run, round(p,6) AS threshold, round(tp/(tp+fp),6) AS precision, round(CASE WHEN a.n_p>0 THEN tp/a.n_p ELSE 1 END,6) AS recall FROM c JOIN a USING (run)
UNION ALL SELECT run, NULL, 1.0, 0.0 FROM a""")
def _(spark, sf):
    return rounded(
        curves.pr_points(S.document_predictions(spark, sf), ["run"], "y", "p"), "threshold", "precision", "recall"
    )


@query("W12_trapezoid_auc", _auc("fine") + """, g AS (SELECT c.run, p, tp/a.n_p AS tpr, fp/a.n_n AS fpr FROM c JOIN a USING (run)),
s AS (SELECT run, fpr, tpr, coalesce(lag(fpr) OVER w,0) pf, coalesce(lag(tpr) OVER w,0) pt FROM g WINDOW w AS (PARTITION BY run ORDER BY p DESC))
SELECT run, round(sum((fpr-pf)*(tpr+pt)/2),6) AS auc FROM s GROUP BY run""")
def _(spark, sf):
    points = curves.roc_points(S.fine_predictions(spark, sf), ["run"], "y", "p")
    return rounded(curves.trapezoid_auc(points, ["run"]), "auc")


EDGES = "edges AS (SELECT i, CASE WHEN i=0 THEN -1.0 ELSE i*0.1::DOUBLE END lo, CASE WHEN i=9 THEN 1.0 ELSE (i+1)*0.1::DOUBLE END hi, i*0.1::DOUBLE AS lo0 FROM unnest(range(10)) t(i))"


def _conf(src):
    return with_(src, rest=f"""{EDGES},
cf AS (SELECT run, CASE WHEN p>=0.5 THEN 1 ELSE 0 END AS pred, CASE WHEN p>=0.5 THEN p ELSE 1-p END AS conf, y FROM {src}),
bins AS (SELECT run, i, count(*) n, avg(CASE WHEN y=pred THEN 1.0::DOUBLE ELSE 0 END) acc, avg(conf) conf FROM cf JOIN edges ON conf>lo AND conf<=hi GROUP BY run, i)
""")


@query("P18_confidence_correctness", with_("preds") + "SELECT subject, line, round(p,6) AS p, CASE WHEN p>=0.5 THEN 1 ELSE 0 END AS pred, round(CASE WHEN p>=0.5 THEN p ELSE 1-p END,6) AS conf, (CASE WHEN p>=0.5 THEN 1 ELSE 0 END)=y AS correct FROM preds")
def _(spark, sf):
    df = calibration.with_confidence(S.predictions(spark, sf), "y", "p")
    return df.select("subject", "line", r6("p").alias("p"), "pred", r6("conf").alias("conf"), "correct")


@query("A28_expected_calibration_error", _conf("preds") + "SELECT run, round(sum(n*abs(acc-conf))/sum(n),6) AS ece FROM bins GROUP BY run")
def _(spark, sf):
    return rounded(calibration.expected_calibration_error(S.predictions(spark, sf), ["run"], "y", "p"), "ece")


@query("A29_reliability_table", _conf("docs") + """SELECT g.run, CAST(e.i AS INT) AS bin, CAST(coalesce(n,0) AS BIGINT) AS n, round(coalesce(acc,0),6) AS acc,
round(coalesce(conf,(e.lo0+e.hi)/2),6) AS conf, round(abs(coalesce(acc,0)-coalesce(conf,(e.lo0+e.hi)/2)),6) AS gap
FROM (SELECT DISTINCT run FROM bins) g CROSS JOIN edges e LEFT JOIN bins b ON b.run=g.run AND b.i=e.i""")
def _(spark, sf):
    table = calibration.reliability_table(S.document_predictions(spark, sf), ["run"], "y", "p")
    return rounded(table, "acc", "conf", "gap").withColumn("n", F.col("n").cast("bigint"))


@query("A30_score_histogram", with_("fine", rest="h AS (SELECT y, least(floor(p*10),9)::INT AS bin, count(*) n FROM fine WHERE p BETWEEN 0 AND 1 GROUP BY ALL)") + """SELECT g.y, CAST(i AS INT) AS bin, CAST(coalesce(n,0) AS BIGINT) AS n
FROM (SELECT DISTINCT y FROM h) g CROSS JOIN unnest(range(10)) t(i) LEFT JOIN h ON h.y=g.y AND h.bin=i""")
def _(spark, sf):
    hist = calibration.score_histogram(S.fine_predictions(spark, sf), ["y"], "p")
    return hist.withColumn("n", F.col("n").cast("bigint"))


def _sweep(src):
    return with_(src, rest=f"""th AS (SELECT i, CASE WHEN i=98 THEN 0.99 ELSE i*((0.99::DOUBLE-0.01::DOUBLE)/98)+0.01::DOUBLE END AS threshold FROM unnest(range(99)) t(i)),
agg AS (SELECT run, p, count(*) FILTER (y=1) pos, count(*) FILTER (y<>1) neg FROM {src} GROUP BY run, p),
sw AS (SELECT run, i, threshold, coalesce(sum(pos) FILTER (p>=threshold),0) tp, coalesce(sum(neg) FILTER (p>=threshold),0) fp,
 coalesce(sum(neg) FILTER (p<threshold),0) tn, coalesce(sum(pos) FILTER (p<threshold),0) fn FROM agg CROSS JOIN th GROUP BY run, i, threshold),
rt AS (SELECT *, CASE WHEN tp+fn>0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END sens, CASE WHEN tn+fp>0 THEN tn/(tn+fp)::DOUBLE ELSE 0 END spec FROM sw),
ms AS (SELECT run, i, threshold, tp, fp, tn, fn, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE ELSE 0 END AS f1,
 CASE WHEN tp+fn=0 THEN spec WHEN tn+fp=0 THEN sens ELSE (sens+spec)/2 END AS bal,
 CASE WHEN (tp+fn>0 OR fp>0) AND (tn+fp>0 OR fn>0) THEN sens+spec-1.0 END AS youden FROM rt)
""")


SWEEP_OUT = """SELECT run, CAST(i AS INT) AS i, round(threshold,6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
round(f1,6) AS f1, round(bal,6) AS balanced_accuracy, round(youden,6) AS youden FROM ms"""


@query("A31_J10_threshold_sweep", _sweep("preds") + SWEEP_OUT)
def _(spark, sf):
    sweep = thresholds.threshold_sweep(S.predictions(spark, sf), ["run"], "y", "p")
    return rounded(sweep, "threshold", "f1", "balanced_accuracy", "youden")


@query("A32_best_thresholds", _sweep("docs") + ", " + ", ".join(
    f"{a} AS (SELECT run, threshold, {m} AS v, row_number() OVER (PARTITION BY run ORDER BY {m} DESC NULLS LAST, i) rn FROM ms)"
    for a, m in (("f", "f1"), ("b", "bal"), ("j", "youden"))
) + """ SELECT f.run, round(CASE WHEN f.v>0 THEN f.threshold ELSE 0.5 END,6) AS best_f1_threshold, round(CASE WHEN f.v>0 THEN f.v ELSE 0 END,6) AS best_f1_value,
round(CASE WHEN b.v>0 THEN b.threshold ELSE 0.5 END,6) AS best_balanced_accuracy_threshold, round(CASE WHEN b.v>0 THEN b.v ELSE 0 END,6) AS best_balanced_accuracy_value,
round(CASE WHEN j.v>-1 THEN j.threshold ELSE 0.5 END,6) AS best_youden_threshold, round(CASE WHEN j.v>-1 THEN j.v ELSE -1 END,6) AS best_youden_value
FROM f JOIN b USING (run) JOIN j USING (run) WHERE f.rn=1 AND b.rn=1 AND j.rn=1""")
def _(spark, sf):
    sweep = thresholds.threshold_sweep(S.document_predictions(spark, sf), ["run"], "y", "p")
    best = thresholds.best_thresholds(sweep, ["run"])
    return rounded(best, *[c for c in best.columns if c != "run"])


# --- cross-validation -------------------------------------------------------------------------

KFOLD_SQL = """sl AS (SELECT subject, max(y) AS label, min(p) AS p FROM preds GROUP BY subject),
ord AS (SELECT *, row_number() OVER (ORDER BY f, md5('42:' || subject), subject) - 1 AS pos FROM (SELECT *, min(subject) OVER (PARTITION BY label) f FROM sl)),
folded AS (SELECT CAST(pos % 5 AS VARCHAR) AS run, label AS y, p FROM ord)"""
CV_SQL = """, bb AS (SELECT run, y, CASE WHEN p>=0.5 THEN 1 ELSE 0 END pred FROM folded),
cm AS (SELECT run, count(*)::DOUBLE n, count(*) FILTER (y=1 AND pred=1)::DOUBLE tp, count(*) FILTER (y=0 AND pred=0)::DOUBLE tn,
 count(*) FILTER (y=0 AND pred=1)::DOUBLE fp, count(*) FILTER (y=1 AND pred=0)::DOUBLE fn FROM bb GROUP BY run),
pf AS (SELECT cm.run AS "Fold", (tp+tn)/n AS "Accuracy", u/(n_p*n_n) AS "ROC_AUC", ap/n_p AS "PR_AUC",
 (2*tp/(2*tp+fp+fn) + 2*tn/(2*tn+fp+fn))/2 AS "Macro_F1", (tp/(tp+fn)+tn/(tn+fp))/2 AS "Balanced_Accuracy",
 tp/(tp+fn) AS "Sensitivity", tn/(tn+fp) AS "Specificity" FROM cm JOIN a USING (run))
"""
CV_COLS = list(cv.SUMMARY_COLUMNS.values())


def out_of_fold_report(spark: SparkSession, sf: str, folds: int = 5) -> DataFrame:
    """Flagship: subjects -> stratified folds -> seven metrics per fold -> mean and deviation rows."""
    scored = S.predictions(spark, sf)
    edges = value_edges(scored, "p")
    subjects = scored.groupBy("subject").agg(F.max("y").alias("y"), F.min("p").alias("p"))
    folded = stratified_kfold(subjects, "subject", "y", folds, seed=42)
    per_fold = metrics.binary_summary(folded, ["fold"], "y", "p", edges=edges)
    named = {v: k.removeprefix("best_val_") for k, v in cv.SUMMARY_COLUMNS.items()}
    per_fold = per_fold.select(F.col("fold").alias("Fold"), *[F.col(c).alias(n) for n, c in named.items()])
    return rounded(cv.cv_summary(per_fold, CV_COLS), *CV_COLS)


@query("A33_cross_validation_report", with_("preds", rest=KFOLD_SQL) + AUC_SQL.format(src="folded") + CV_SQL + "SELECT \"Fold\", " + ", ".join(f'round("{c}",6) AS "{c}"' for c in CV_COLS) + " FROM pf UNION ALL SELECT 'Mean', " + ", ".join(f'round(avg("{c}"),6)' for c in CV_COLS) + " FROM pf UNION ALL SELECT 'Std', " + ", ".join(f'round(stddev_samp("{c}"),6)' for c in CV_COLS) + " FROM pf")
def _(spark, sf):
    return out_of_fold_report(spark, sf)


@query("S10_fold_prediction_files", with_("preds") + """SELECT (line - 1)::INT AS "Fold", count(*) AS n, count(*) FILTER (y=1) AS asd, CAST(count(*) FILTER ((p>=0.5)=(y=1)) AS BIGINT) AS correct, round(avg(p),6) AS mean_p FROM preds GROUP BY line""")
def _(spark, sf):
    """Predictions of seven folds, each written under its own folder and read back as one table."""
    root, p = fresh_path(spark, "folds"), F.col("p").cast("double")
    side = lambda hit: F.when(hit, "ASD").otherwise("CONTROL")
    rows = S.predictions(spark, sf).select(
        "line", F.col("subject").cast("string").alias("Subject"), side(F.col("y") == 1).alias("True_Label"), side(p >= 0.5).alias("Pred_Label"),
        p.alias("Probability_ASD"), (1 - p).alias("Probability_Control"), p.alias("Logit_ASD"), (-p).alias("Logit_Control"),
        ((p >= 0.5) == (F.col("y") == 1)).alias("Correct"),
    )
    for fold in range(7):
        rows.where(F.col("line") == fold + 1).drop("line").write.csv(f"{root}/fold_{fold}/predictions.csv", header=True)
    back = tables.read_fold_predictions(spark, root, 7)
    return back.groupBy("Fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("True_Label") == "ASD").alias("asd"), F.count_if("Correct").alias("correct"),
        r6(F.avg("Probability_ASD")).alias("mean_p"),
    )


@query("S10_U01_out_of_fold_union", with_("preds") + """SELECT (line - 1)::INT AS "Fold", run, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(p),6) AS mean_p FROM preds GROUP BY line, run""")
def _(spark, sf):
    df = S.predictions(spark, sf)
    folds = {i: df.where(F.col("line") == i + 1).drop("line") for i in range(7)}
    return cv.union_folds(folds).groupBy("Fold", "run").agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), r6(F.avg("p")).alias("mean_p")
    )


# --- class weights ----------------------------------------------------------------------------

@query("A34_class_weights", with_("multi") + """SELECT run, y, round(sum(count(*)) OVER (PARTITION BY run)/(count(*) OVER (PARTITION BY run)*count(*))::DOUBLE,6) AS weight FROM multi GROUP BY run, y""")
def _(spark, sf):
    from cohortlake.operators.balance import class_weights

    return rounded(class_weights(S.multiclass(spark, sf), ["run"], "y"), "weight")


@query("A35_imbalance_ratio", with_("docs", rest="c AS (SELECT run, y, count(*) n FROM docs GROUP BY run, y)") + "SELECT run, round(max(n)/greatest(min(n),1)::DOUBLE,6) AS imbalance FROM c GROUP BY run")
def _(spark, sf):
    from cohortlake.operators.balance import imbalance_ratio

    return rounded(imbalance_ratio(S.document_predictions(spark, sf), ["run"], "y"), "imbalance")


# --- repeated predictions ---------------------------------------------------------------------

@query("A36_tta_mean", with_("tta") + "SELECT subject, cls, round(avg(prob),6) AS prob FROM tta GROUP BY subject, cls")
def _(spark, sf):
    return rounded(tta.aggregate_runs(S.runs_of_predictions(spark, sf), ["subject"], "mean"), "prob")


@query("A37_tta_median", with_("tta") + "SELECT subject, cls, round(quantile_disc(prob,0.5),6) AS prob FROM tta GROUP BY subject, cls")
def _(spark, sf):
    return rounded(tta.aggregate_runs(S.runs_of_predictions(spark, sf), ["subject"], "median"), "prob")


@query("A38_tta_majority", with_("tta", rest="""v AS (SELECT subject, run, cls, row_number() OVER (PARTITION BY subject, run ORDER BY prob DESC, cls) rn FROM tta),
t AS (SELECT subject, cls, count(*) n FROM v WHERE rn=1 GROUP BY subject, cls),
w AS (SELECT subject, cls win FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, cls) rn FROM t) WHERE rn=1)""") + "SELECT subject, c AS cls, CASE WHEN c=win THEN 1.0::DOUBLE ELSE 0 END AS prob FROM w CROSS JOIN unnest([0,1]) t(c)")
def _(spark, sf):
    return tta.aggregate_runs(S.runs_of_predictions(spark, sf), ["subject"], "majority")


@query("A39_mean_logits", with_("tta") + "SELECT subject, cls, round(avg(ln((prob+0.01)/(1.01-prob))),6) AS logit FROM tta GROUP BY subject, cls")
def _(spark, sf):
    logit = F.log((F.col("prob") + 0.01) / (1.01 - F.col("prob")))
    df = S.runs_of_predictions(spark, sf).withColumn("logit", logit)
    return rounded(tta.tta_mean(df, ["subject"], "logit"), "logit")


def _two_modes(spark, sf):
    """Baseline = first line of a subject, augmented = mean over its lines."""
    df = S.predictions(spark, sf)
    base = df.groupBy("run", "subject").agg(F.max("y").alias("y"), F.min_by("p", F.struct("line", "p")).alias("p"))
    aug = df.groupBy("run", "subject").agg(F.max("y").alias("y"), r6(F.avg("p")).alias("p"))
    latency = df.groupBy("run").agg(F.countDistinct("subject").alias("a"), F.count("*").alias("b"))
    edges = value_edges(df, "p")
    one = metrics.binary_summary(base, ["run"], "y", "p", edges=edges).join(latency, "run")
    many = metrics.binary_summary(aug, ["run"], "y", "p", edges=edges).join(latency, "run")
    return tta.tta_comparison(
        one.withColumn("latency", F.col("a") / 1000), many.withColumn("latency", F.col("b") / 1000), ["run"], "latency"
    )


_MODE = """g{k} AS (SELECT run, subject, max(y) AS y, {p} AS p FROM preds GROUP BY run, subject),
t{k} AS (SELECT run, p, count(*) FILTER (y=1)::DOUBLE pos, count(*) FILTER (y<>1)::DOUBLE neg FROM g{k} GROUP BY run, p),
c{k} AS (SELECT *, sum(neg) OVER (PARTITION BY run ORDER BY p) - neg AS below, sum(pos) OVER (PARTITION BY run ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY run ORDER BY p DESC) AS fp FROM t{k}),
a{k} AS (SELECT run, sum(pos*(below+neg/2))/(sum(pos)*sum(neg)) AS auc, sum(pos*tp/(tp+fp))/sum(pos) AS ap FROM c{k} GROUP BY run),
m{k} AS (SELECT run, count(*)::DOUBLE n, count(*) FILTER (y=1 AND p>=0.5)::DOUBLE tp, count(*) FILTER (y=0 AND p<0.5)::DOUBLE tn, count(*) FILTER (y=0 AND p>=0.5)::DOUBLE fp, count(*) FILTER (y=1 AND p<0.5)::DOUBLE fn FROM g{k} GROUP BY run),
o{k} AS (SELECT run, '{mode}' AS "Mode", (tp+tn)/n AS "Accuracy", auc AS "ROC_AUC", ap AS "PR_AUC", (2*tp/(2*tp+fp+fn)+2*tn/(2*tn+fp+fn))/2 AS "Macro_F1", (tp/(tp+fn)+tn/(tn+fp))/2 AS "Balanced_Accuracy",
 tp/(tp+fn) AS "Sensitivity", tn/(tn+fp) AS "Specificity", {lat}/1000.0::DOUBLE AS "Latency_sec" FROM m{k} JOIN a{k} USING (run) JOIN lat USING (run))"""
TTA_SQL = with_("preds", rest="lat AS (SELECT run, count(DISTINCT subject) a, count(*) b FROM preds GROUP BY run),\n" + _MODE.format(k=0, p="arg_min(p, {'l': line, 'p': p})", mode="Baseline", lat="a") + ",\n" + _MODE.format(k=1, p="round(avg(p),6)", mode="TTA", lat="b"))
TTA_COLS = [*tta.MEASURES.values(), "Latency_sec"]


@query("A40_tta_comparison", TTA_SQL + " UNION ALL ".join(
    f'SELECT run, "Mode", ' + ", ".join(f'round("{c}",6) AS "{c}"' for c in TTA_COLS) + f" FROM o{k}" for k in (0, 1)))
def _(spark, sf):
    return rounded(_two_modes(spark, sf), *TTA_COLS)


@query("A40_tta_deltas", TTA_SQL + "SELECT run, " + ", ".join(
    f'round(o1."{n}"-o0."{n}",6) AS {c}_delta' for c, n in ({**tta.MEASURES, "latency": "Latency_sec"}).items()) + " FROM o0 JOIN o1 USING (run)")
def _(spark, sf):
    deltas = tta.tta_deltas(_two_modes(spark, sf), ["run"])
    return rounded(deltas, *[c for c in deltas.columns if c != "run"])


@query("J12_scans_by_runs", "SELECT o_orderkey AS scan_id, CAST(r AS INT) AS run FROM orders CROSS JOIN unnest(range(5)) t(r)")
def _(spark, sf):
    return tta.scans_by_runs(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id")), 5)


# --- row-wise scoring and losses --------------------------------------------------------------

SOFT = with_("logits", rest="mx AS (SELECT vec_id, max(v) m, ln(sum(exp(v))) lse FROM logits GROUP BY vec_id),\nsm AS (SELECT l.vec_id, y, k, v, v-lse AS logp, exp(v-lse) AS pr FROM logits l JOIN mx USING (vec_id))")


@query("P17_softmax", SOFT + "SELECT vec_id, CAST(k AS INT) AS cls, round(pr,6) AS prob FROM sm")
def _(spark, sf):
    df = S.logits(spark, sf).select("vec_id", F.posexplode(scoring.softmax(F.col("logits"))).alias("cls", "prob"))
    return rounded(df, "prob")


@query("P17_decisions", SOFT + """, w AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) rn FROM sm)
SELECT s.vec_id, CAST(w.k AS INT) AS top_class, CASE WHEN exp(s.pr2)>=0.5 THEN 1 ELSE 0 END AS two_class, round(1/(1+exp(-s.v0)),6) AS sigmoid, CASE WHEN s.v0>0 THEN 1 ELSE 0 END AS positive
FROM w JOIN (SELECT vec_id, max(v) FILTER (k=0) v0, max(v) FILTER (k=1) - ln(exp(max(v) FILTER (k=0))+exp(max(v) FILTER (k=1))) AS pr2 FROM sm GROUP BY vec_id) s USING (vec_id) WHERE w.rn=1""")
def _(spark, sf):
    df = S.logits(spark, sf)
    first = F.element_at("logits", 1)
    prob, positive = scoring.single_logit(first)
    two = scoring.softmax(F.slice("logits", 1, 2))
    return df.select(
        "vec_id", scoring.argmax(F.col("logits")).alias("top_class"),
        scoring.threshold_decision(F.element_at(two, 2)).alias("two_class"),
        r6(prob).alias("sigmoid"), positive.alias("positive"),
    )


@query("R07_X06_prediction_record", SOFT + "SELECT CAST(vec_id AS VARCHAR) AS patient_id, 'probe' AS model_name, 'class_' || k AS class_name, round(pr,6) AS probability, round(max(pr) OVER (PARTITION BY vec_id),6) AS confidence FROM sm")
def _(spark, sf):
    names = [f"class_{k}" for k in range(64)]
    rec = scoring.prediction_record(F.col("vec_id").cast("string"), "probe", names, F.col("logits"))
    df = S.logits(spark, sf).select(rec.alias("r")).select(
        "r.patient_id", "r.model_name", F.explode("r.probabilities").alias("c"), "r.metrics"
    )
    return df.select(
        "patient_id", "model_name", "c.class_name", r6("c.probability").alias("probability"),
        r6(F.element_at("metrics", "confidence")).alias("confidence"),
    )


@query("P19_cross_entropy", SOFT + "SELECT vec_id, round(-logp,6) AS loss FROM sm WHERE k=y")
def _(spark, sf):
    df = S.logits(spark, sf)
    return df.select("vec_id", r6(losses.cross_entropy(F.col("logits"), F.col("y"))).alias("loss"))


# weights 1, 1.1, 1.2 ... stand for inverse class frequencies
WEIGHTS = [1 + k / 10 for k in range(64)]


@query("P20_weighted_cross_entropy", SOFT + "SELECT y, round(sum((1+k/10.0::DOUBLE)*-logp)/sum(1+k/10.0::DOUBLE),6) AS loss FROM sm WHERE k=y GROUP BY y UNION ALL SELECT -1, round(sum((1+k/10.0::DOUBLE)*-logp)/sum(1+k/10.0::DOUBLE),6) FROM sm WHERE k=y")
def _(spark, sf):
    df = S.logits(spark, sf)
    loss = losses.batch_loss("weighted_ce", F.col("logits"), F.col("y"), WEIGHTS)
    per = df.groupBy("y").agg(r6(loss).alias("loss"))
    return per.unionByName(df.agg(r6(loss).alias("loss")).withColumn("y", F.lit(-1)))


@query("P21_label_smoothed_cross_entropy", SOFT + "SELECT y, round(avg(l),6) AS loss FROM (SELECT vec_id, y, 0.9*-max(logp) FILTER (k=y) + 0.0015625*sum(-logp) AS l FROM sm GROUP BY vec_id, y) GROUP BY y")
def _(spark, sf):
    loss = losses.batch_loss("ce_ls", F.col("logits"), F.col("y"), smoothing=0.1)
    return S.logits(spark, sf).groupBy("y").agg(r6(loss).alias("loss"))


@query("P22_focal_loss", SOFT + "SELECT vec_id, round((1+k/10.0::DOUBLE)*pow(1-pr,2)*-logp,6) AS loss FROM sm WHERE k=y")
def _(spark, sf):
    loss = losses.focal(F.col("logits"), F.col("y"), WEIGHTS, 2.0)
    return S.logits(spark, sf).select("vec_id", r6(loss).alias("loss"))


@query("P22_focal_reductions", SOFT + "SELECT y, round(avg(pow(1-pr,2)*-logp),6) AS mean_loss, round(sum(pow(1-pr,2)*-logp),6) AS sum_loss FROM sm WHERE k=y GROUP BY y")
def _(spark, sf):
    loss = losses.focal(F.col("logits"), F.col("y"))
    return S.logits(spark, sf).groupBy("y").agg(
        r6(losses.reduced(loss, "mean")).alias("mean_loss"), r6(losses.reduced(loss, "sum")).alias("sum_loss")
    )


@query("P23_focal_label_smoothing", SOFT + "SELECT vec_id, round(sum(pow(1-pr,2)*-logp*(CASE WHEN k=y THEN 0.9015625 ELSE 0.0015625 END)),6) AS loss FROM sm GROUP BY vec_id")
def _(spark, sf):
    loss = losses.focal(F.col("logits"), F.col("y"), smoothing=0.1)
    return S.logits(spark, sf).select("vec_id", r6(loss).alias("loss"))


@query("P24_focal_alpha", "WITH e AS (SELECT vec_id, label % 2 AS y, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b FROM embeddings), s AS (SELECT *, ln(exp(a)+exp(b)) lse FROM e) SELECT vec_id, round(CASE WHEN y=0 THEN 0.25*pow(1-exp(a-lse),2)*(lse-a) ELSE 0.75*pow(1-exp(b-lse),2)*(lse-b) END,6) AS loss FROM s")
def _(spark, sf):
    loss = losses.focal(F.col("logits"), F.col("y"), losses.focal_alpha(0.25))
    return S.logits(spark, sf, 2).select("vec_id", r6(loss).alias("loss"))
