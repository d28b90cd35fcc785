"""Subject-level splits and folds with exact sizes and quotas.

Shuffles are an order by ``md5(seed:id)``: the same seed gives the same split on any
cluster and partitioning.  Ranks come from hash-prefix buckets, never from one global sort task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.ordered import hash_rank, sorted_rank


def _distinct(df: DataFrame, subject: str) -> DataFrame:
    return df.select(subject).distinct().withColumn("_all", F.lit(0))


def _class_key(label: str) -> Column:
    """Non-null text key of a class, so that unlabelled subjects form a class of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-"))


def check_ratios(train: float, val: float, test: float) -> None:
    if not all(0.0 <= r <= 1.0 for r in (train, val, test)):
        raise ValueError("split ratios must lie between 0 and 1")
    if abs(train + val + test - 1.0) > 1e-5:
        raise ValueError(f"split ratios must sum to 1, got {train + val + test:.4f}")


def random_split(
    df: DataFrame, subject: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42
) -> DataFrame:
    """(subject, split): int(train * n) and int(val * n) subjects, the rest in test."""
    check_ratios(train, val, test)
    ranked = hash_rank(_distinct(df, subject), ["_all"], subject, seed, total="_n")
    n_train, n_val = F.floor(F.lit(train) * F.col("_n")), F.floor(F.lit(val) * F.col("_n"))
    split = F.when(F.col("rn") <= n_train, "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return ranked.select(subject, split.alias("split"))


def kfold(df: DataFrame, subject: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(subject, fold): folds of n // k subjects, the last one takes the remainder."""
    ranked = hash_rank(_distinct(df, subject), ["_all"], subject, seed, total="_n")
    size = F.floor(F.col("_n") / k)
    fold = F.when(size == 0, k - 1).otherwise(
        F.least(F.floor(F.try_divide(F.col("rn") - 1, size)), F.lit(k - 1))
    )
    return ranked.select(subject, fold.cast("int").alias("fold"))


def round_robin_kfold(df: DataFrame, subject: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(subject, label, fold): the i-th member of every class goes to fold i mod k."""
    ranked = hash_rank(df.select(subject, label, _class_key(label).alias("_cls")), ["_cls"], subject, seed)
    return ranked.select(subject, label, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def group_kfold(df: DataFrame, subject: str, group: str, k: int = 5) -> DataFrame:
    """(subject, group, fold): the i-th group in sorted order goes to fold i mod k, whole."""
    groups = sorted_rank(df.select(group).distinct(), [group])
    fold = ((F.col("rn") - 1) % k).cast("int")
    return df.select(subject, group).join(groups, group).select(subject, group, fold.alias("fold"))


def expand_folds(assigned: DataFrame, subject: str, k: int) -> DataFrame:
    """(subject, fold, role): validation in its own fold, training in the k - 1 others."""
    rows = assigned.select(subject, F.col("fold").alias("_own")).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    return rows.select(subject, "fold", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train").alias("role"))


def _subject_labels(df: DataFrame, subject: str, label: str, keep: Sequence[str]) -> DataFrame:
    return df.groupBy(subject).agg(F.max(label).alias(label), *[F.max(c).alias(c) for c in keep])


def _allocate(counts: DataFrame, part: str, share: Column, total: str) -> DataFrame:
    """Integer class quotas of ``part`` rows in all by largest remainder (ties: larger label first)."""
    exact = F.col(total) * share
    w = Window.partitionBy("_all").orderBy(F.desc(exact - F.floor(exact)), F.desc("_label"))
    short = F.col(part) - F.sum(F.floor(exact)).over(Window.partitionBy("_all"))
    return counts.withColumn(
        f"_q_{part}", (F.floor(exact) + F.when(F.row_number().over(w) <= short, 1).otherwise(0)).cast("bigint")
    )


def stratified_split(
    df: DataFrame, subject: str, label: str,
    train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42,
) -> DataFrame:
    """(subject, label, split) with class quotas by largest remainder.

    ``ceil((val + test) * n)`` subjects leave train, ``ceil(test / (val + test))`` of those
    form the test part; with no held-out share all are in train.  With fewer than two classes, or a class of one, classes are ignored.
    """
    check_ratios(train, val, test)
    held = val + test
    labelled = _subject_labels(df, subject, label, []).withColumns({"_all": F.lit(0), "_cls": _class_key(label)})
    counts = labelled.groupBy("_all", "_cls").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_all")
    stratify = (F.count("*").over(whole) >= 2) & (F.min("_c").over(whole) >= 2)
    # a cohort too small to stratify becomes a single stratum
    classes = counts.select("_all", "_cls", "_c", F.when(stratify, F.col("_cls")).otherwise("").alias("_label"))
    strata = classes.groupBy("_all", "_label").agg(F.sum("_c").alias("_c"))
    sized = strata.withColumn("_n", F.sum("_c").over(whole)).withColumn("_held", F.ceil(F.lit(held) * F.col("_n")))
    sized = sized.withColumn("_test", F.ceil(F.lit(test / held if held else 0.0) * F.col("_held")))
    sized = _allocate(sized, "_held", F.col("_c") / F.col("_n"), "_held")
    sized = _allocate(sized, "_test", F.coalesce(F.try_divide(F.col("_q__held"), F.col("_held")), F.lit(0.0)), "_test")
    quotas = sized.select(F.col("_label").alias("_stratum"), "_q__held", "_q__test")
    members = labelled.join(classes.select("_cls", F.col("_label").alias("_stratum")), "_cls")
    ranked = hash_rank(members.select(subject, label, "_stratum"), ["_stratum"], subject, seed)
    split = (
        F.when(F.col("rn") <= F.col("_q__test"), "test")
        .when(F.col("rn") <= F.col("_q__held"), "val")
        .otherwise("train")
    )
    return ranked.join(quotas, "_stratum").select(subject, label, split.alias("split"))


def stratified_kfold(
    df: DataFrame, subject: str, label: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Input rows plus ``fold``: position in (class, hash) order mod k, so fold sizes and class quotas balance.

    Classes come in the order of their smallest subject.  With fewer than two classes, or a class
    smaller than k, plain folds: the first n % k are one larger.
    """
    keep = [c for c in df.columns if c not in (subject, label)]
    labelled = _subject_labels(df, subject, label, keep).withColumns({"_all": F.lit(0), "_cls": _class_key(label)})
    counts = labelled.groupBy("_all", "_cls").agg(F.count("*").alias("_c"), F.min(subject).alias("_first"))
    whole = Window.partitionBy("_all")
    before = Window.partitionBy("_all").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_cls",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("_n"),
        ((F.count("*").over(whole) >= 2) & (F.min("_c").over(whole) >= k)).alias("_stratify"),
    )
    ranked = hash_rank(labelled, ["_cls"], subject, seed).join(counts, "_cls")
    balanced = (F.col("_before") + F.col("rn") - 1) % k
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    pos = F.col("_before") + F.col("rn") - 1
    plain = F.when(pos < (small + 1) * extra, F.floor(pos / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(pos - (small + 1) * extra, small))
    )
    fold = F.when(F.col("_stratify"), balanced).otherwise(plain)
    return ranked.select(subject, label, *keep, fold.cast("int").alias("fold"))
