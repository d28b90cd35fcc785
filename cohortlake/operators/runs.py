"""Training-run bookkeeping: metadata documents, comparison tables, trial logs, epoch histories.

Epoch and trial numbers are integers, so their order is bucketed by value: a run that
holds a third of all epochs is windowed in slices of ``SLICE`` numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.metadata import fixed
from cohortlake.operators.ordered import running, value_edges, with_value_bucket
from cohortlake.session import materialised

SLICE = 4096

# fixed values: columns of the experiment comparison table, in order
COMPARISON_COLUMNS = [
    "Experiment", "Architecture", "Loss_Function", "Val_Loss", "Val_Accuracy", "ROC_AUC", "PR_AUC", "F1",
    "Balanced_Accuracy", "Sensitivity", "Specificity", "Training_Time", "Epoch_Time", "Parameter_Count",
    "Model_Size", "Best_Epoch", "Optimizer", "Learning_Rate", "Weight_Decay", "Dropout_Prob",
    "Label_Smoothing", "Class_Weights", "Augmentation", "Augmentation_Profile", "Initialization_Type",
]
# fixed values: report column -> (metadata keys in fallback order, default); a text default keeps text
_SCORES = {
    "Val_Accuracy": (["best_val_accuracy"], 0.0),
    "ROC_AUC": (["best_val_roc_auc"], 0.0),
    "PR_AUC": (["best_val_pr_auc"], 0.0),
}
_F1 = {"F1": (["best_val_macro_f1", "macro_f1"], 0.0)}
_BALANCED = {"Balanced_Accuracy": (["best_val_balanced_accuracy"], 0.0)}
_RATES = {"Sensitivity": (["best_val_sensitivity"], 0.0), "Specificity": (["best_val_specificity"], 0.0)}
_BEST = {"Best_Epoch": (["best_epoch"], 0)}
_TIME = {"Training_Time": (["training_time"], 0.0)}
ARCHITECTURE_REPORT = {
    "Val_Loss": (["best_val_loss"], 0.0), **_SCORES, **_F1, **_BALANCED, **_TIME,
    "Epoch_Time": (["epoch_time"], 0.0), "Parameter_Count": (["parameter_count"], 0),
    "Model_Size": (["model_size_mb"], 0.0), **_BEST, "Learning_Rate": (["lr"], 0.0),
    "Optimizer": (["optimizer"], ""), "Scheduler": (["scheduler"], ""),
    "Augmentation_Profile": (["augmentation_profile"], "none"),
}
LOSS_REPORT = {**_SCORES, **_F1, **_BALANCED, **_RATES, **_BEST, **_TIME}
AUGMENTATION_REPORT = LOSS_REPORT
INITIALISATION_REPORT = {
    **_SCORES, "Macro_F1": (["best_val_macro_f1"], 0.0), **_BALANCED,
    "Epoch_to_Best_Validation": (["best_epoch"], 0), **_TIME, "Parameter_Count": (["parameter_count"], 0),
}


def parse_metadata(docs: DataFrame, text: str = "doc") -> DataFrame:
    """JSON documents -> ``meta`` map; documents that do not parse are skipped."""
    return docs.withColumn("meta", F.from_json(text, "map<string,string>")).where("meta IS NOT NULL").drop(text)


def meta_get(keys: Sequence[str], default) -> Column:
    """First present key of ``meta``.  An explicit null stays null; only an absent key takes the default."""
    kind = {float: "double", int: "bigint", str: "string"}[type(default)]
    out = F.lit(default).cast(kind)
    for k in reversed(keys):
        out = F.when(F.map_contains_key("meta", k), F.try_element_at("meta", F.lit(k)).try_cast(kind)).otherwise(out)
    return out


def run_report(runs: DataFrame, name: str, title: str, spec: dict) -> DataFrame:
    """Comparison rows of parsed runs: the name column, then the columns of ``spec``."""
    return runs.select(F.col(name).alias(title), *[meta_get(k, d).alias(c) for c, (k, d) in spec.items()])


def upsert_comparison(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace or append by Experiment; fixed column order, absent cells N/A."""
    def shaped(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[
                (F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in have else F.lit("N/A")).alias(c)
                for c in COMPARISON_COLUMNS
            ]
        )

    kept = old.join(new.select("Experiment"), "Experiment", "left_anti")
    return shaped(kept).unionByName(shaped(new))


def ranked_comparison(df: DataFrame, by: Sequence[str], metrics: Sequence[str], name: str) -> DataFrame:
    """Best run per group by the metrics in turn; the name breaks ties."""
    keys = F.struct(*[F.col(m) for m in metrics])
    lowest_name = df.groupBy(*by, *metrics).agg(F.min(name).alias(name))
    return lowest_name.groupBy(*by).agg(F.max_by(F.struct(name, *metrics), keys).alias("_w")).select(*by, "_w.*")


def param_keys(trials: DataFrame, params: str = "params") -> DataFrame:
    """Distinct parameter names over all trials."""
    return trials.select(F.explode(F.map_keys(params)).alias("param")).distinct()


def trial_log(trials: DataFrame) -> DataFrame:
    """trial_number, state, value and one column per parameter name in sorted order; absent cells N/A.

    Parameter names become columns, so the (few) distinct names are read first.
    """
    names = sorted(r[0] for r in param_keys(trials).collect())
    return trials.select(
        "trial_number", "state", fixed(F.col("value")).alias("value"),
        *[F.coalesce(F.try_element_at("params", F.lit(n)), F.lit("N/A")).alias(n) for n in names],
    )


def complete_trials(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("state") == "COMPLETE")


def best_trial(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest value among complete trials; the first trial wins a tie."""
    pick = F.max_by("trial_number", F.struct(F.col("value"), -F.col("trial_number")))
    return complete_trials(trials).groupBy(*by).agg(pick.alias("best_trial_number"), F.max("value").alias("best_value"))


def _sliced(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / SLICE))


def running_best(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Complete trials with the best value so far, in trial order."""
    done = _sliced(complete_trials(trials), "trial_number")
    return running(done, by, "_slice", ["trial_number"], {"best_so_far": (F.max, F.col("value"))}).drop("_slice")


def improvements(epochs: DataFrame, by: Sequence[str], epoch: str, metric: str, mode: str = "min") -> DataFrame:
    """Rows with a metric plus ``improved``: strictly better than every earlier epoch."""
    fn = {"min": F.min, "max": F.max}[mode]
    rows = _sliced(epochs.where(F.col(metric).isNotNull()), epoch)
    seen = running(rows, by, "_slice", [epoch], {"_best": (fn, F.col(metric))}, inclusive=False).drop("_slice")
    better = F.col(metric) < F.col("_best") if mode == "min" else F.col(metric) > F.col("_best")
    return seen.withColumn("improved", F.col("_best").isNull() | better).drop("_best")


def best_checkpoint(epochs: DataFrame, by: Sequence[str], epoch: str, metric: str, mode: str = "min") -> DataFrame:
    """First epoch of the optimum per run; epochs without the metric are skipped."""
    rows = epochs.where(F.col(metric).isNotNull())
    if mode == "min":
        pick, best = F.min_by(epoch, F.struct(F.col(metric), F.col(epoch))), F.min(metric)
    elif mode == "max":
        pick, best = F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))), F.max(metric)
    else:
        raise ValueError(f"mode must be min or max, got {mode}")
    return rows.groupBy(*by).agg(pick.alias("best_epoch"), best.alias("best_metric"))


def latest_checkpoint(epochs: DataFrame, by: Sequence[str], epoch: str, metric: str) -> DataFrame:
    return epochs.groupBy(*by).agg(
        F.max(epoch).alias("latest_epoch"), F.max_by(metric, F.col(epoch)).alias("latest_metric")
    )


def top_checkpoints(epochs: DataFrame, by: Sequence[str], epoch: str, metric: str, k: int = 3) -> DataFrame:
    """The k lowest-metric epochs per run.  Rows beyond k are cut in every input partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.asc(metric), F.asc(epoch))
    return epochs.where(F.col(metric).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _accepted(records: DataFrame, run: str, min_delta: float) -> DataFrame:
    """(run, _pos) of the accepted ones of the records (run, _best, _pos), each below the ones before.

    From the first on, each accepted record leads to the next: the highest below it by more than the margin.  Where every
    record would lead is a running maximum over the sorted scores, cut into buckets.  Steps are then doubled,
    1, 2, 4, ... records at once, and the chain from the first record is filled in from the widest steps down, so
    a run of any length takes a number of joins that grows with the logarithm of its records, none of which
    holds a run in one task.
    """
    known = materialised(records.select(run, F.col("_best").alias("_s"), "_pos"), "records")
    marks = known.select(run, F.col("_s").alias("_key"), F.lit(1).alias("_kind"), F.col("_s").alias("_own")).unionByName(
        known.select(run, (F.col("_s") - F.lit(float(min_delta))).alias("_key"), F.lit(0).alias("_kind"), F.col("_s").alias("_own"))
    )
    # a limit stands before a record of the same score: only what is lower counts
    cut = with_value_bucket(marks, "_key", value_edges(known, "_s"))
    below = running(cut, [run], "_bucket", ["_key", "_kind"], {"_next": (F.max, F.when(F.col("_kind") == 1, F.col("_key")))})
    step = below.where("_kind = 0 and _next is not null").select(run, F.col("_own").alias("_a"), F.col("_next").alias("_b"))
    steps, width = [materialised(step, "steps")], 1
    longest = known.groupBy(run).count().agg(F.max("count")).first()[0] or 0  # one row
    while 2 * width < longest:
        once = steps[-1]
        again = once.select(run, F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        steps.append(materialised(once.join(again, [run, "_b"]).select(run, "_a", F.col("_c").alias("_b")), "steps"))
        width *= 2
    reached = known.groupBy(run).agg(F.max("_s").alias("_s"))
    for wide in reversed(steps):
        further = reached.join(wide, (reached[run] == wide[run]) & (F.col("_s") == F.col("_a"))).select(reached[run], F.col("_b").alias("_s"))
        reached = materialised(reached.unionByName(further), "reached")
    return known.join(reached, [run, "_s"]).select(run, "_pos")


def early_stop(
    epochs: DataFrame, run: str, epoch: str, metric: str, patience: int, min_delta: float = 0.0, mode: str = "min"
) -> DataFrame:
    """(run, stop_epoch): the epoch at which training would stop; null if it never does.

    A score counts only if it beats the last accepted one by more than ``min_delta``.  Accepted
    scores are always strict records, so windows first reduce each run to its records.  Without a margin
    those are the accepted scores; with one :func:`_accepted` follows them.  The stop is ``patience`` scored
    epochs after the last accepted score whose successor comes later than that.
    """
    sign = 1.0 if mode == "min" else -1.0
    rows = epochs.where(F.col(metric).isNotNull()).select(
        run, F.col(epoch).alias("_e"), (F.col(metric) * sign).alias("_m")
    )
    scored = running(
        _sliced(rows, "_e"), [run], "_slice", ["_e"],
        {"_pos": (F.sum, F.lit(1).cast("bigint")), "_best": (F.min, F.col("_m"))},
    )
    records = scored.groupBy(run, "_best").agg(F.min("_pos").alias("_pos"))

    # without a margin every record is accepted
    taken = records.select(run, "_pos") if min_delta == 0 else _accepted(records, run, min_delta)
    n = scored.groupBy(run).agg(F.max("_pos").alias("_n"))
    # the gap after each accepted score: up to the next accepted one, or to the end of the run
    nxt = F.lead("_pos").over(Window.partitionBy(run).orderBy("_pos"))
    gaps = taken.withColumn("_next", nxt).join(n, run)
    waited = F.coalesce(F.col("_next") - 1, F.col("_n")) - F.col("_pos")
    stops = gaps.where(waited >= patience).groupBy(run).agg((F.min("_pos") + patience).alias("_pos"))
    at = stops.join(scored.select(run, "_pos", F.col("_e").alias("stop_epoch")), [run, "_pos"])
    return n.select(run).join(at.select(run, "stop_epoch"), run, "left")


def resumed_history(writes: DataFrame, run: str, session: str, epoch: str) -> DataFrame:
    """History after restarts: a session that starts at epoch e drops earlier sessions' epochs >= e."""
    starts = writes.groupBy(run, session).agg(F.min(epoch).alias("_first"))
    later = Window.partitionBy(run).orderBy(session).rowsBetween(1, Window.unboundedFollowing)
    cuts = starts.select(run, session, F.min("_first").over(later).alias("_cut"))
    kept = writes.join(cuts, [run, session])
    return kept.where(F.col("_cut").isNull() | (F.col(epoch) < F.col("_cut"))).drop("_cut")


def epoch_loss(batches: DataFrame, by: Sequence[str], loss: str, size: str, dataset_size: Column) -> DataFrame:
    """sum(loss * batch size) over the whole dataset size, even where a short last batch was dropped."""
    return batches.groupBy(*by).agg(F.try_divide(F.sum(F.col(loss) * F.col(size)), dataset_size).alias("epoch_loss"))


def step_timings(history: DataFrame, step: str = "step", seconds: str = "seconds") -> DataFrame:
    return history.groupBy(step).agg(
        F.count("*").alias("n"), F.avg(seconds).alias("avg_seconds"), F.max(seconds).alias("max_seconds")
    )


def eta_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm", h, m))
        .when(m > 0, F.format_string("%dm %ds", m, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def progress(tasks: DataFrame, by: Sequence[str], workers: int = 1) -> DataFrame:
    """Counters per group from task rows (state skipped | done | failed | todo, seconds), with the ETA."""
    n = lambda s: F.count_if(F.col("state") == s)
    sums = tasks.groupBy(*by).agg(
        F.count("*").alias("total"), n("skipped").alias("skipped"), n("done").alias("processed"),
        n("failed").alias("failed"), n("todo").alias("remaining"),
        F.sum(F.when(F.col("state").isin("done", "failed"), F.col("seconds"))).alias("_elapsed"),
    )
    avg = F.coalesce(F.try_divide(F.col("_elapsed") / workers, F.col("processed") + F.col("failed")), F.lit(0.0))
    return sums.select(
        *by, "total", (F.col("skipped") + F.col("processed")).alias("completed"), "skipped", "processed", "failed",
        avg.alias("avg_seconds"), eta_text(F.col("remaining") * avg).alias("eta"),
    )


def cache_report(
    expected: DataFrame, cached: DataFrame, stored_hash: str | None, wanted_hash: str,
    shape: Sequence[int], dtype: str = "float32",
) -> DataFrame:
    """One row on the preprocessed cache: counts per problem, and the overall verdict.

    ``expected`` holds subject_id; ``cached`` holds subject_id, shape array<int>, dtype, readable.
    """
    want = F.array(*[F.lit(int(s)) for s in shape])
    subs = expected.select("subject_id").distinct()
    rows = subs.join(cached.withColumn("_have", F.lit(True)), "subject_id", "left").select(
        F.col("_have").isNull().alias("missing"),
        (F.col("_have") & ~F.col("readable")).alias("corrupt"),
        (F.col("_have") & F.col("readable") & (F.col("shape") != want)).alias("bad_shape"),
        (F.col("_have") & F.col("readable") & ~F.contains(F.col("dtype"), F.lit(dtype))).alias("bad_dtype"),
    )
    out = rows.agg(
        F.count("*").alias("subjects_checked"),
        *[F.count_if(F.col(c)).alias(c) for c in ("missing", "corrupt", "bad_shape", "bad_dtype")],
    )
    match = F.lit(stored_hash == wanted_hash)
    clean = (F.col("missing") + F.col("corrupt") + F.col("bad_shape") + F.col("bad_dtype")) == 0
    return out.select(
        F.lit(wanted_hash).alias("expected_hash"), F.lit(stored_hash or "missing_hash").alias("actual_hash"),
        match.alias("hash_match"), "*", (match & clean).alias("valid"),
    )
