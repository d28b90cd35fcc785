"""Run bookkeeping: metadata documents, comparison tables, trials, epochs, sinks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import metadata as M
from cohortlake.operators import runs
from cohortlake.sources import sinks, tables
from cohortlake.streaming import incremental
from cohortlake.workloads import standins as S
from cohortlake.workloads.standins import table, with_

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


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


# one run document per event, the same text in Spark and DuckDB; some keys absent, null, or the text broken
E = "cast(event_id as string)"
P2 = "lpad(cast(event_id % 97 as string), 2, '0')"
DOC = f"""case when event_id % 31 = 0 then '{{broken' else '{{"best_val_accuracy": 0.' || {P2} || (case when event_id % 3 = 0 then '' else ', "best_val_roc_auc": 0.5' || {P2} end)
 || (case event_id % 4 when 0 then '' when 1 then ', "best_val_macro_f1": null' else ', "best_val_macro_f1": 0.25' || {P2} end) || (case when event_id % 5 = 0 then '' else ', "macro_f1": 0.75' end)
 || (case when event_id % 7 = 0 then '' else ', "best_epoch": ' || cast(event_id % 40 as string) end) || ', "training_time": ' || {E} || '.5, "best_val_loss": 1.' || {P2}
 || (case when event_id % 2 = 0 then ', "optimizer": "adamw", "lr": 0.001, "parameter_count": 11000000' else '' end) || (case when event_id % 6 = 0 then ', "augmentation_profile": "strong"' else '' end) || '}}' end"""
NAME = f"'run_' || {E}"
MOD = "event_id, event_id % 97 / 100.0::DOUBLE AS frac, event_id % 31 <> 0 AS ok FROM events"
META = f"""m AS (SELECT 'run_' || event_id AS run, event_id % 97 / 100.0::DOUBLE AS acc, CASE WHEN event_id%3=0 THEN 0.0 ELSE 0.5::DOUBLE + event_id % 97/1000.0::DOUBLE END AS auc,
 CASE event_id%4 WHEN 1 THEN NULL WHEN 0 THEN CASE WHEN event_id%5=0 THEN 0.0 ELSE 0.75 END ELSE 0.25::DOUBLE + event_id%97/10000.0::DOUBLE END AS f1,
 CASE event_id%4 WHEN 1 THEN NULL WHEN 0 THEN 0.0 ELSE 0.25::DOUBLE + event_id%97/10000.0::DOUBLE END AS own_f1,
 CASE WHEN event_id%7=0 THEN 0 ELSE event_id%40 END AS best_epoch, event_id + 0.5::DOUBLE AS t, 1 + event_id%97/100.0::DOUBLE AS loss,
 CASE WHEN event_id%2=0 THEN 'adamw' ELSE '' END AS opt, CASE WHEN event_id%2=0 THEN 0.001 ELSE 0 END AS lr, CASE WHEN event_id%2=0 THEN 11000000 ELSE 0 END AS params,
 CASE WHEN event_id%6=0 THEN 'strong' ELSE 'none' END AS aug FROM events WHERE event_id%31<>0)"""


def documents(spark, sf):
    return table(spark, sf, "events").select(F.expr(NAME).alias("run"), F.expr(DOC).alias("doc"))


def metadata(spark, sf):
    return runs.parse_metadata(documents(spark, sf))


def _report(spark, sf, title, spec):
    out = runs.run_report(metadata(spark, sf), "run", title, spec)
    return rounded(out, *[c for c, (_, d) in spec.items() if isinstance(d, float)])


def _select(title, spec):
    column = {
        "Val_Loss": "loss", "Val_Accuracy": "acc", "ROC_AUC": "auc", "F1": "f1", "Macro_F1": "own_f1", "Training_Time": "t",
        "Learning_Rate": "lr", "Optimizer": "opt", "Augmentation_Profile": "aug", "Scheduler": "''",
        "Best_Epoch": "best_epoch", "Epoch_to_Best_Validation": "best_epoch", "Parameter_Count": "params",
    }
    cols = []
    for c, (_, d) in spec.items():
        e = column.get(c, "0.0")
        cols.append(f"round({e}::DOUBLE,6) AS {c}" if isinstance(d, float) else f"CAST({e} AS {'VARCHAR' if isinstance(d, str) else 'BIGINT'}) AS {c}")
    return f"WITH {META} SELECT run AS {title}, " + ", ".join(cols) + " FROM m"


for _name, _title, _spec in (
    ("A43_architecture_comparison", "Architecture", runs.ARCHITECTURE_REPORT),
    ("A44_loss_comparison", "Loss_Function", runs.LOSS_REPORT),
    ("A45_augmentation_comparison", "Augmentation_Profile", runs.AUGMENTATION_REPORT),
    ("A46_initialisation_comparison", "Initialization_Type", runs.INITIALISATION_REPORT),
):
    QUERIES[_name] = lambda spark, sf, t=_title, s=_spec: _report(spark, sf, t, s)
    ORACLE[_name] = _select(_title, _spec)


@query("S09_R05_run_metadata", f"WITH {META} SELECT run, round(acc,6) AS acc, round(auc,6) AS auc, round(f1,6) AS f1, opt FROM m")
def _(spark, sf):
    get = runs.meta_get
    return metadata(spark, sf).select(
        "run", r6(get(["best_val_accuracy"], 0.0)).alias("acc"), r6(get(["best_val_roc_auc"], 0.0)).alias("auc"),
        r6(get(["best_val_macro_f1", "macro_f1"], 0.0)).alias("f1"), get(["optimizer"], "").alias("opt"),
    )


@query("S09_run_metadata_files", f"WITH {META} SELECT run, round(acc,6) AS acc, CAST(best_epoch AS BIGINT) AS best_epoch FROM m")
def _(spark, sf):
    path = sinks.write_documents(documents(spark, sf), "run", "doc")
    df = tables.read_run_documents(spark, path)
    return runs.parse_metadata(df).select(
        "run", r6(runs.meta_get(["best_val_accuracy"], 0.0)).alias("acc"), runs.meta_get(["best_epoch"], 0).alias("best_epoch")
    )


_FOLD = "avg(p_retailprice)/2500.0::DOUBLE"


@query("A33_U01_fold_documents_report", f"""WITH f AS (SELECT p_partkey % 5 AS fold, {_FOLD} AS acc, max(p_size)/100.0::DOUBLE AS auc FROM part GROUP BY 1),
r AS (SELECT CAST(fold AS VARCHAR) AS "Fold", acc AS "Accuracy", CASE WHEN fold<>3 THEN auc ELSE 0 END AS "ROC_AUC" FROM f)
SELECT "Fold", round("Accuracy",6) AS "Accuracy", round("ROC_AUC",6) AS "ROC_AUC", 0.0::DOUBLE AS "Macro_F1" FROM r
UNION ALL SELECT 'Mean', round(avg("Accuracy"),6), round(avg("ROC_AUC"),6), 0.0 FROM r UNION ALL SELECT 'Std', round(stddev_samp("Accuracy"),6), round(stddev_samp("ROC_AUC"),6), 0.0 FROM r""")
def _(spark, sf):
    from cohortlake.operators import cv

    part = table(spark, sf, "part").groupBy((F.col("p_partkey") % 5).alias("fold")).agg(
        (F.avg("p_retailprice") / 2500).alias("best_val_accuracy"), (F.max("p_size") / 100).alias("_auc")
    )
    # fold 3 has no ROC AUC; a sixth document is broken
    doc = F.to_json(F.struct("best_val_accuracy", F.when(F.col("fold") != 3, F.col("_auc")).alias("best_val_roc_auc")))
    docs = part.select(F.concat(F.lit("run_fold_"), F.col("fold").cast("string")).alias("run"), doc.alias("doc"))
    docs = docs.unionByName(docs.limit(1).select(F.lit("run_fold_9").alias("run"), F.lit("{broken").alias("doc")))
    path = sinks.write_documents(docs, "run", "doc")
    rep = cv.report_from_documents(tables.read_run_documents(spark, path), 5)
    return rep.select("Fold", *[r6(F.col(c)).alias(c) for c in ("Accuracy", "ROC_AUC", "Macro_F1")])


@query("R05_event_properties", "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k, 'none' AS other FROM events")
def _(spark, sf):
    meta = table(spark, sf, "events").withColumn("meta", F.from_json("props", "map<string,string>"))
    return meta.select("event_id", runs.meta_get(["k"], 0).alias("k"), runs.meta_get(["other"], "none").alias("other"))


# --- comparison tables ------------------------------------------------------------------------

def experiments(spark, sf):
    """Old and new comparison rows; sizes 20..30 appear in both."""
    p = table(spark, sf, "part")
    base = [F.concat(F.lit("exp_"), F.col("p_partkey").cast("string")).alias("Experiment"), F.col("p_brand").alias("Architecture")]
    old = p.where("p_size <= 30").select(*base, M.fixed(F.col("p_retailprice") / 1000).alias("Val_Loss"))
    new = p.where("p_size >= 20").select(
        *base, F.col("p_type").alias("Loss_Function"),
        M.fixed(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 500), 2).alias("Val_Loss"),
    )
    return old, new


@query("S14_comparison_upsert", """WITH n AS (SELECT 'exp_' || p_partkey AS e, p_brand AS a, p_type AS l, CASE WHEN p_size%2=0 THEN printf('%.2f', p_retailprice/500) ELSE 'N/A' END AS v FROM part WHERE p_size>=20),
o AS (SELECT 'exp_' || p_partkey AS e, p_brand AS a, 'N/A' AS l, printf('%.4f', p_retailprice/1000) AS v FROM part WHERE p_size<=30)
SELECT e AS Experiment, a AS Architecture, l AS Loss_Function, v AS Val_Loss, """ + ", ".join(f"'N/A' AS {c}" for c in runs.COMPARISON_COLUMNS[4:]) + """ FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE e NOT IN (SELECT e FROM n))""")
def _(spark, sf):
    old, new = experiments(spark, sf)
    path = sinks.fresh_path(spark, "comparison")
    sinks.ComparisonTable(spark, path).upsert(old)
    sinks.ComparisonTable(spark, path).upsert(new)  # opened again
    return sinks.ComparisonTable(spark, path).read()


@query("K04_ranked_comparison", """SELECT p_brand AS grp, name, round(score,6) AS score, CAST(size AS BIGINT) AS size FROM (SELECT p_brand, 'exp_' || p_partkey AS name, p_retailprice AS score, p_size AS size,
row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, 'exp_' || p_partkey) rn FROM part) WHERE rn=1""")
def _(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_brand").alias("grp"), F.concat(F.lit("exp_"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_retailprice").alias("score"), F.col("p_size").cast("bigint").alias("size"),
    )
    return rounded(runs.ranked_comparison(df, ["grp"], ["score", "size"], "name"), "score")


@query("P33_metric_formatting", "SELECT s_suppkey, CASE WHEN s_acctbal>0 THEN printf('%.4f', s_acctbal/8) ELSE 'N/A' END AS four, CASE WHEN s_acctbal>0 THEN printf('%.2f', s_acctbal) ELSE 'N/A' END AS two FROM supplier")
def _(spark, sf):
    v = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    return table(spark, sf, "supplier").select("s_suppkey", M.fixed(v / 8).alias("four"), M.fixed(v, 2).alias("two"))


@query("A51_numeric_coercion", "SELECT s_suppkey, round(CASE WHEN s_acctbal>0 THEN s_acctbal ELSE 0 END,2) AS number FROM supplier")
def _(spark, sf):
    text = M.fixed(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")), 2)
    return table(spark, sf, "supplier").select("s_suppkey", M.metric_number(text).alias("number"))


# --- trials -----------------------------------------------------------------------------------

TRIALS = """tr AS (SELECT user_id AS study, event_id AS trial_number, CASE WHEN event_type='error' THEN 'FAIL' ELSE 'COMPLETE' END AS state, CASE WHEN event_type<>'error' THEN value END AS value FROM events)"""


def trials(spark, sf):
    err = F.col("event_type") == "error"
    k = F.col("event_id")
    params = F.map_filter(
        F.create_map(
            F.lit("lr"), F.concat(F.lit("0.00"), (k % 9 + 1).cast("string")),
            F.lit("batch_size"), F.when(k % 2 == 0, (k % 4 * 8 + 8).cast("string")),
            F.lit("dropout_prob"), F.when(k % 3 == 0, F.concat(F.lit("0."), (k % 5).cast("string"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("study"), k.alias("trial_number"), F.when(err, "FAIL").otherwise("COMPLETE").alias("state"),
        F.when(~err, F.col("value")).alias("value"), params.alias("params"),
    )


@query("S16_trial_log", f"WITH {TRIALS} SELECT trial_number, state, CASE WHEN value IS NULL THEN 'N/A' ELSE printf('%.4f', value) END AS value, CASE WHEN trial_number%2=0 THEN CAST(trial_number%4*8+8 AS VARCHAR) ELSE 'N/A' END AS batch_size, CASE WHEN trial_number%3=0 THEN '0.' || (trial_number%5) ELSE 'N/A' END AS dropout_prob, '0.00' || (trial_number%9+1) AS lr FROM tr")
def _(spark, sf):
    path = sinks.write_csv(runs.trial_log(trials(spark, sf)), "trials")
    cols = ["trial_number bigint", "state string", "value string", "batch_size string", "dropout_prob string", "lr string"]
    return spark.read.csv(path, header=True, schema=", ".join(cols))


@query("R06_parameter_names", "SELECT unnest(['batch_size','dropout_prob','lr']) AS param")
def _(spark, sf):
    return runs.param_keys(trials(spark, sf))


@query("R04_params_text", "SELECT event_id AS trial_number, '{' || CASE WHEN event_id%2=0 THEN '\"batch_size\":\"' || (event_id%4*8+8) || '\",' ELSE '' END || CASE WHEN event_id%3=0 THEN '\"dropout_prob\":\"0.' || (event_id%5) || '\",' ELSE '' END || '\"lr\":\"0.00' || (event_id%9+1) || '\"}' AS text, '0.00' || (event_id%9+1) AS lr FROM events")
def _(spark, sf):
    ordered = F.map_from_entries(F.array_sort(F.map_entries("params")))
    df = trials(spark, sf).select("trial_number", F.to_json(ordered).alias("text"))
    return df.select("trial_number", "text", F.from_json("text", "map<string,string>")["lr"].alias("lr"))


@query("W13_running_best", f"WITH {TRIALS} SELECT study, trial_number, value, max(value) OVER (PARTITION BY study ORDER BY trial_number) AS best_so_far FROM tr WHERE state='COMPLETE'")
def _(spark, sf):
    return runs.running_best(trials(spark, sf).drop("params"), ["study"]).drop("state")


@query("K03_best_trial", f"WITH {TRIALS} SELECT study, arg_max(trial_number, {{'v': value, 't': -trial_number}}) AS best_trial_number, max(value) AS best_value FROM tr WHERE state='COMPLETE' GROUP BY study")
def _(spark, sf):
    return runs.best_trial(trials(spark, sf), ["study"])


# --- epochs -----------------------------------------------------------------------------------

EPOCHS = "ep AS (SELECT user_id AS run, event_id AS epoch, CASE WHEN event_id%19<>0 THEN value END AS val_loss FROM events)"


def epochs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        F.when(F.col("event_id") % 19 != 0, F.col("value")).alias("val_loss"),
    )


@query("W14_best_checkpoint", f"WITH {EPOCHS} SELECT run, epoch AS best_epoch, val_loss AS best_metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) rn FROM ep WHERE val_loss IS NOT NULL) WHERE rn=1")
def _(spark, sf):
    return runs.best_checkpoint(epochs(spark, sf), ["run"], "epoch", "val_loss")


@query("W14_improvement_flags", f"WITH {EPOCHS} SELECT run, epoch, val_loss, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM ep WHERE val_loss IS NOT NULL")
def _(spark, sf):
    return runs.improvements(epochs(spark, sf), ["run"], "epoch", "val_loss")


@query("W15_latest_checkpoint", f"WITH {EPOCHS} SELECT run, max(epoch) AS latest_epoch, (SELECT val_loss FROM ep b WHERE b.epoch=max(a.epoch)) AS latest_metric FROM ep a GROUP BY run")
def _(spark, sf):
    return runs.latest_checkpoint(epochs(spark, sf), ["run"], "epoch", "val_loss")


@query("K05_top_checkpoints", f"WITH {EPOCHS} SELECT run, epoch, val_loss, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) place FROM ep WHERE val_loss IS NOT NULL) WHERE place<=3")
def _(spark, sf):
    return runs.top_checkpoints(epochs(spark, sf), ["run"], "epoch", "val_loss")


def _early(delta, patience):
    return f"""WITH RECURSIVE {EPOCHS}, s AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY epoch) n FROM ep WHERE val_loss IS NOT NULL),
walk AS (SELECT run, epoch, n, val_loss AS best, 0 AS wait FROM s WHERE n=1
 UNION ALL SELECT s.run, s.epoch, s.n, CASE WHEN s.val_loss < w.best - {delta} THEN s.val_loss ELSE w.best END, CASE WHEN s.val_loss < w.best - {delta} THEN 0 ELSE w.wait+1 END FROM walk w JOIN s ON s.run=w.run AND s.n=w.n+1)
SELECT run, min(epoch) FILTER (wait>={patience}) AS stop_epoch FROM walk GROUP BY run"""


@query("W16_early_stop", _early("0.0", 5))
def _(spark, sf):
    return runs.early_stop(epochs(spark, sf), "run", "epoch", "val_loss", patience=5)


@query("W16_early_stop_min_delta", _early("2.5", 8))
def _(spark, sf):
    return runs.early_stop(epochs(spark, sf), "run", "epoch", "val_loss", patience=8, min_delta=2.5)


# restarts: the event type stands for the session, in the order of its name
HIST = "wr AS (SELECT user_id AS run, event_type AS session, event_id % 200 AS epoch, max(event_id) AS write_no FROM events GROUP BY ALL)"


@query("W17_resumed_history", f"WITH {HIST}, st AS (SELECT run, session, min(epoch) f FROM wr GROUP BY run, session), cut AS (SELECT run, session, min(f) OVER (PARTITION BY run ORDER BY session ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) c FROM st) SELECT run, session, epoch, write_no FROM wr JOIN cut USING (run, session) WHERE c IS NULL OR epoch < c")
def _(spark, sf):
    writes = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("run"), F.col("event_type").alias("session"), (F.col("event_id") % 200).alias("epoch")
    ).agg(F.max("event_id").alias("write_no"))
    return runs.resumed_history(writes, "run", "session", "epoch")


@query("A42_epoch_loss", "SELECT user_id AS run, round(sum(value*(event_id%16+1))/(count(*)*17),6) AS epoch_loss FROM events GROUP BY user_id")
def _(spark, sf):
    batches = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), "value", (F.col("event_id") % 16 + 1).alias("n")
    )
    return rounded(runs.epoch_loss(batches, ["run"], "value", "n", F.count("*") * 17), "epoch_loss")


@query("A49_step_timings", "SELECT event_type AS step, count(*) AS n, round(avg(value),6) AS avg_seconds, max(value) AS max_seconds FROM events GROUP BY event_type")
def _(spark, sf):
    history = table(spark, sf, "events").select(F.col("event_type").alias("step"), F.col("value").alias("seconds"))
    return rounded(runs.step_timings(history), "avg_seconds")


TASKS = "t AS (SELECT user_id % 10 AS grp, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'done' ELSE 'todo' END AS state, CAST(round(value*100) AS BIGINT) AS cents FROM events)"


@query("A50_progress", f"""WITH {TASKS}, s AS (SELECT grp, count(*) total, count(*) FILTER (state='skipped') skipped, count(*) FILTER (state='done') processed, count(*) FILTER (state='failed') failed, count(*) FILTER (state='todo') remaining, coalesce(sum(cents) FILTER (state IN ('done','failed')),0)/100.0::DOUBLE e FROM t GROUP BY grp),
a AS (SELECT *, CASE WHEN processed+failed>0 THEN e/4/(processed+failed) ELSE 0 END AS av FROM s), b AS (SELECT *, CAST(floor(remaining*av) AS BIGINT) x FROM a)
SELECT grp, total, skipped+processed AS completed, skipped, processed, failed, round(av,6) AS avg_seconds, CASE WHEN x//3600>0 THEN (x//3600) || 'h ' || (x%3600//60) || 'm' WHEN x//60>0 THEN (x%3600//60) || 'm ' || (x%60) || 's' ELSE (x%60) || 's' END AS eta FROM b""")
def _(spark, sf):
    kind = F.col("event_type")
    state = (
        F.when(kind == "error", "failed").when(kind == "view", "skipped").when(kind.isin("click", "purchase"), "done").otherwise("todo")
    )
    cents = F.round(F.col("value") * 100).cast("decimal(18,0)")
    tasks = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("grp"), state.alias("state"), (cents / 100).alias("seconds")
    )
    out = runs.progress(tasks, ["grp"], workers=4)
    return rounded(out, "avg_seconds")


@query("C06_cache_report", "SELECT 'h2' AS expected_hash, 'h1' AS actual_hash, false AS hash_match, (SELECT count(*) FROM customer) AS subjects_checked, (SELECT count(*) FROM customer WHERE c_custkey%9=0) AS missing, (SELECT count(*) FROM customer WHERE c_custkey%9<>0 AND c_custkey%13=0) AS corrupt, (SELECT count(*) FROM customer WHERE c_custkey%9<>0 AND c_custkey%13<>0 AND c_nationkey=3) AS bad_shape, (SELECT count(*) FROM customer WHERE c_custkey%9<>0 AND c_custkey%13<>0 AND c_nationkey=4) AS bad_dtype, false AS valid")
def _(spark, sf):
    c = table(spark, sf, "customer")
    cached = c.where("c_custkey % 9 <> 0").select(
        F.col("c_custkey").alias("subject_id"),
        F.array(F.lit(1), F.lit(4), F.lit(4), F.when(F.col("c_nationkey") == 3, 5).otherwise(4)).alias("shape"),
        F.when(F.col("c_nationkey") == 4, "torch.float64").otherwise("torch.float32").alias("dtype"),
        (F.col("c_custkey") % 13 != 0).alias("readable"),
    )
    return runs.cache_report(c.select(F.col("c_custkey").alias("subject_id")), cached, "h1", "h2", (1, 4, 4, 4))


# --- sinks ------------------------------------------------------------------------------------

@query("S12_prediction_sink", with_("preds") + """SELECT subject || '-' || line AS Subject, CASE y WHEN 1 THEN 'Autism' ELSE 'Control' END AS True_Label, CASE WHEN p>=0.5 THEN 'Autism' ELSE 'Control' END AS Pred_Label, printf('%.4f', p) AS Probability_ASD, printf('%.4f', 1-p) AS Probability_Control,
printf('%.4f', p*3) AS Logit_ASD, printf('%.4f', (1-p)*3) AS Logit_Control, CASE WHEN (p>=0.5)=(y=1) THEN 'True' ELSE 'False' END AS Correct FROM preds""")
def _(spark, sf):
    p = F.col("p")
    scored = S.predictions(spark, sf).select(
        F.concat_ws("-", "subject", "line").alias("subject"), "y", F.when(p >= 0.5, 1).otherwise(0).alias("pred"),
        F.array(1 - p, p).alias("probs"), F.array((1 - p) * 3, p * 3).alias("logits"),
    )
    path = sinks.write_predictions(scored)
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in sinks.PREDICTION_COLUMNS))


@query("S13_curve_sinks", with_("preds", rest="t AS (SELECT run, p, count(*) FILTER (y=1)::DOUBLE pos, count(*)::DOUBLE n FROM preds GROUP BY run, p), c AS (SELECT run, p, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(pos) OVER (PARTITION BY run) AS tot FROM t WINDOW w AS (PARTITION BY run ORDER BY p DESC))") + "SELECT run, printf('%.4f', p) AS threshold, printf('%.4f', tp/al) AS precision, printf('%.4f', tp/tot) AS recall FROM c")
def _(spark, sf):
    from cohortlake.operators.curves import pr_points

    path = sinks.write_curve(pr_points(S.predictions(spark, sf), ["run"], "y", "p"), ["run"], ["threshold", "precision", "recall"])
    return spark.read.csv(path, header=True, schema="run string, threshold string, precision string, recall string")


@query("S11_compiled_cohort_sink", "WITH o AS (SELECT c_custkey AS subject_id, c_mktsegment AS label FROM customer) SELECT subject_id, label FROM o")
def _(spark, sf):
    from cohortlake.plans.compile import compile_cohort
    from cohortlake.workloads.cohort import subjects

    index = subjects(spark, sf).select("subject_id", F.col("subject_id").cast("string").alias("path"), "label",
                                       F.lit(None).cast("string").alias("sex"), F.lit(None).cast("double").alias("age"), "site")
    out = compile_cohort(index, sinks.fresh_path(spark, "cohort"))
    splits = spark.read.parquet(out["splits"])
    return spark.read.parquet(out["index"]).join(splits, "subject_id", "left_semi").select("subject_id", "label")


# --- streams ----------------------------------------------------------------------------------

def _in_two_parts(spark, sf, key, run):
    """Call ``run(folder)`` on half of the events, and again when the other half has arrived."""
    events, folder = S.table(spark, sf, "events"), sinks.fresh_path(spark, "arrivals")
    for half in (0, 1):
        events.where(F.pmod(F.xxhash64(key), F.lit(2)) == half).write.mode("append").parquet(folder)
        out = run(incremental.stream_table(spark, folder))
    return out


@query("T01_incremental_ingest", "SELECT DISTINCT sha256(user_id || '_' || event_type || '_' || props) AS fingerprint FROM events")
def _(spark, sf):
    path = sinks.fresh_path(spark, "ingest")
    content = F.concat_ws("_", F.col("user_id").cast("string"), "event_type", "props")
    return _in_two_parts(spark, sf, "event_id", lambda rows: incremental.ingest_new(rows, content, path))


@query("T02_running_balance", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path = sinks.fresh_path(spark, "balance")
    labels = lambda rows: rows.select(F.col("event_type").alias("label"))
    return _in_two_parts(spark, sf, "event_id", lambda rows: incremental.running_balance(labels(rows), "label", path))


@query("T03_early_stop_monitor", _early("2.5", 8))
def _(spark, sf):
    path = sinks.fresh_path(spark, "monitor")
    epochs = lambda rows: rows.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        F.when(F.col("event_id") % 19 != 0, F.col("value")).alias("metric"),
    )
    return _in_two_parts(
        spark, sf, "event_id", lambda rows: incremental.early_stop_monitor(epochs(rows), patience=8, min_delta=2.5, path=path)
    )
