"""Cohort index: scans joined to phenotype rows, integrity checks, layout builders, membership filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import metadata as M
from cohortlake.functions import paths as P

# fixed values
REQUIRED_PHENOTYPE = ["SUB_ID", "DX_GROUP", "SEX", "AGE_AT_SCAN", "SITE_ID"]
OPTIONAL_PHENOTYPE = ["FIQ", "VIQ", "PIQ"]
REQUIRED_INDEX = ["subject_id", "path", "label"]


class ValidationFailed(ValueError):
    """A cohort breaks one of its integrity rules."""


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key.  An aggregate, so copies of a hot key already collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, *[F.col("_r")[c].alias(c) for c in rest]
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, *[F.col("_r")[c].alias(c) for c in rest]
    )


def check_phenotype_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_PHENOTYPE if c not in df.columns]
    if missing:
        raise ValidationFailed(f"phenotype table lacks required columns: {missing}")
    return df


def clean_phenotype(raw: DataFrame, order: str) -> DataFrame:
    """One cleaned row per integer SUB_ID, the last in ``order``."""
    check_phenotype_columns(raw)
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    site = F.trim(F.col("SITE_ID").cast("string"))
    rows = raw.select(
        F.col("SUB_ID").cast("string").try_cast("double").cast("bigint").alias("sub_key"),
        F.col(order).alias("_order"),
        site.alias("site"),
        M.decode(F.col("DX_GROUP"), M.DIAGNOSIS_CODES).alias("label"),
        M.clean_number(F.col("AGE_AT_SCAN")).alias("age"),
        M.decode(F.col("SEX"), M.SEX_CODES).alias("sex"),
        *[M.clean_number(has(c)).alias(c.lower()) for c in OPTIONAL_PHENOTYPE],
        site.alias("scanner_site"),
    ).where("sub_key IS NOT NULL")
    return last_write_wins(rows, ["sub_key"], ["_order"]).drop("_order")


def build_index(files: DataFrame, phenotype: DataFrame, dataset: str = "ABIDE_I") -> DataFrame:
    """T1w files left-joined to cleaned phenotype rows; unmatched scans keep null labels and site Unknown.

    No broadcast hint: the phenotype side is broadcast only if its measured size allows.
    """
    scans = (
        files.where(P.is_t1w(F.col("path")))
        .withColumn("_digits", P.subject_digits(F.col("path")))
        .where("_digits IS NOT NULL")
        .select(
            F.concat(F.lit("sub-"), "_digits").alias("subject_id"),
            F.col("_digits").cast("bigint").alias("sub_key"),
            "path",
        )
    )
    unknown = lambda c: F.coalesce(F.col(c), F.lit("Unknown")).alias(c)
    return scans.join(phenotype.withColumn("_hit", F.lit(True)), "sub_key", "left").select(
        "subject_id", unknown("site"), "path", "label", "age", "sex", "fiq", "viq", "piq",
        F.lit(dataset).alias("dataset"), F.lit("T1w").alias("modality"), unknown("scanner_site"),
        F.coalesce("_hit", F.lit(False)).alias("has_phenotype"),
    )


def orphan_scans(index: DataFrame) -> DataFrame:
    """Violations of the scan-phenotype join: no phenotype row, or no valid diagnosis."""
    rule = F.when(~F.col("has_phenotype"), "no phenotype row").when(F.col("label").isNull(), "no diagnosis label")
    return index.select("subject_id", "path", rule.alias("rule")).where("rule IS NOT NULL")


def missing_catalog(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected entries that were not found."""
    return expected.join(found, key, "left_anti")


def members_of(df: DataFrame, members: DataFrame, subject: str) -> DataFrame:
    return df.join(members, subject, "left_semi")


def in_split(df: DataFrame, splits: DataFrame, split: str, subject: str = "subject_id") -> DataFrame:
    """Rows whose subject is in the named split; an unknown name gives no rows."""
    return members_of(df, splits.where(F.col("split") == split).select(subject), subject)


def in_fold(
    df: DataFrame, folds: DataFrame, fold: int, role: str, subject: str = "subject_id", k: int | None = None
) -> DataFrame:
    """Rows in one role of one fold; the fold must exist.  With the number of folds ``k`` no job is needed to check that."""
    top = k - 1 if k is not None else folds.agg(F.max("fold")).first()[0]
    if top is None or not 0 <= fold <= top:
        raise ValueError(f"fold {fold} is outside 0..{top}")
    return members_of(df, folds.where((F.col("fold") == fold) & (F.col("role") == role)).select(subject), subject)


def pending(df: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows not yet materialised, optionally the first ``limit`` by key."""
    todo = df.join(done, key, "left_anti")
    return todo.orderBy(key).limit(limit) if limit is not None else todo


def subject_label(df: DataFrame, cohort: DataFrame, subject: str, label: str) -> DataFrame:
    joined = df.join(cohort.select(subject, label), subject, "left")
    return joined.withColumn(label, F.coalesce(label, F.lit("Unknown")))


def class_folder_index(files: DataFrame, label: Column, formats: Sequence[tuple[str, Column]]) -> DataFrame:
    """One scan per (class folder, subject): best format first, then the smallest path.

    ``files`` holds class_dir, subject_id and path; ``formats`` lists (name, condition) in preference order.
    """
    rank, fmt = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in range(len(formats) - 1, -1, -1):
        name, cond = formats[i]
        rank, fmt = F.when(cond, i).otherwise(rank), F.when(cond, name).otherwise(fmt)
    rows = files.select("class_dir", "subject_id", label.alias("label"), rank.alias("_rank"), fmt.alias("format"), "path")
    rows = rows.where(F.col("label").isNotNull() & F.col("_rank").isNotNull())
    return first_per_key(rows, ["class_dir", "subject_id"], ["_rank", "path"]).select(
        "subject_id", "path", "label", "format", "class_dir"
    )


def modality_index(subjects: DataFrame, files: DataFrame) -> DataFrame:
    """One row per subject folder: channel map, mask path, available channels; empty folders stay.

    Per subject at most one path per modality survives the first aggregation.
    """
    marked = files.select("subject_id", P.modality(P.basename(F.col("path"))).alias("m"), "path").where("m IS NOT NULL")
    one = marked.groupBy("subject_id", "m").agg(F.max("path").alias("path"))
    packed = one.groupBy("subject_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("m") != "mask", F.struct("m", "path"))))
        ).alias("channels"),
        F.max(F.when(F.col("m") == "mask", F.col("path"))).alias("mask"),
    )
    empty = F.create_map().cast("map<string,string>")
    return subjects.select("subject_id").distinct().join(packed, "subject_id", "left").select(
        "subject_id",
        F.coalesce("channels", empty).alias("channels"),
        "mask",
        F.array_sort(F.map_keys(F.coalesce("channels", empty))).alias("available_channels"),
        F.col("mask").isNotNull().alias("has_mask"),
    )


def missing_modalities(index: DataFrame) -> DataFrame:
    """(modality, missing) over the expected channels, plus a total row."""
    expected = F.explode(F.array(*[F.lit(m) for m in P.MODALITIES])).alias("modality")
    gaps = index.select("channels", expected).where(~F.map_contains_key("channels", F.col("modality")))
    per = gaps.groupBy("modality").agg(F.count("*").alias("missing"))
    total = gaps.agg(F.count("*").alias("missing")).select(F.lit("total_missing_channels").alias("modality"), "missing")
    return per.unionByName(total)


def index_violations(index: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(rule_no, rule, entry) rows for every broken index rule.

    Rules: required fields present, path found, subject unique, path unique.  Every row lists what it breaks
    and what it claims to be unique; one grouped count then settles all rules.
    """
    key = F.coalesce(F.col("subject_id").cast("string"), F.col("path"), F.lit("?"))
    entry = lambda no, rule, value: F.struct(
        F.lit(no).alias("rule_no"), F.lit(rule).alias("rule"), value.cast("string").alias("entry")
    )
    rows = index
    if found is not None:
        there = found.select(F.col("path").alias("_there")).distinct()
        rows = index.join(there, F.col("path") == F.col("_there"), "left")
    listed = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", entry(1, f"missing field {f}", key)) for f in REQUIRED_INDEX]
    if found is not None:
        listed.append(F.when(F.col("_there").isNull(), entry(2, "path does not exist", F.col("path"))))
    for no, c, rule in ((3, "subject_id", "duplicate subject"), (4, "path", "duplicate path")):
        listed.append(F.when(F.col(c).isNotNull(), entry(no, rule, F.col(c))))
    every = rows.select(F.explode(F.filter(F.array(*listed), lambda e: e.isNotNull())).alias("e")).select("e.*")
    counted = every.groupBy("rule_no", "rule", "entry").agg(F.count("*").cast("int").alias("_n"))
    # a broken row counts each time, a value that should be unique once
    times = F.when(F.col("rule_no") <= 2, F.col("_n")).otherwise(F.when(F.col("_n") > 1, 1).otherwise(0))
    return counted.select("rule_no", "rule", "entry", F.explode(F.array_repeat(F.lit(1), times)).alias("_t")).drop("_t")


def validate_index(index: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The index itself, or an error naming the first broken rule."""
    if index.isEmpty():
        raise ValidationFailed("index is empty")
    first = index_violations(index, found).orderBy("rule_no", "rule", "entry").first()
    if first is not None:
        raise ValidationFailed(f"{first['rule']}: {first['entry']}")
    return index


def split_overlaps(splits: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subjects found in more than one split (empty for a proper partition)."""
    return splits.groupBy(subject).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def split_coverage(splits: DataFrame, subjects: DataFrame, subject: str = "subject_id") -> DataFrame:
    """One row: subjects, members, uncovered subjects, unknown members, members of several splits."""
    left = subjects.select(subject).distinct().withColumn("_s", F.lit(1))
    right = splits.groupBy(subject).agg(F.countDistinct("split").alias("_m"))
    return left.join(right, subject, "full_outer").agg(
        F.count("_s").alias("subjects"), F.count("_m").alias("members"),
        F.count_if(F.col("_m").isNull()).alias("uncovered"), F.count_if(F.col("_s").isNull()).alias("unknown"),
        F.count_if(F.col("_m") > 1).alias("overlaps"),
    )


def ragged_modalities(index: DataFrame) -> DataFrame:
    """Subjects that cannot be stacked, with the first absent channel in stacking order."""
    need = F.array(*[F.lit(m) for m in P.MODALITIES])
    gap = F.filter(need, lambda m: ~F.map_contains_key(F.col("channels"), m))
    return index.where(F.size(gap) > 0).select(
        "subject_id", F.element_at(gap, 1).alias("modality")
    )


def batches(df: DataFrame, order: Sequence[str], size: int, values: Sequence[str], drop_last: bool = False) -> DataFrame:
    """Consecutive rows packed into arrays of ``size``; null labels become -1.

    The row number is a distributed rank, so no task sees more than its own range of rows.
    """
    from cohortlake.operators.ordered import sorted_rank

    ranked = sorted_rank(df, order).withColumn("batch", F.floor((F.col("rn") - 1) / size))
    item = F.struct("rn", *values)
    packed = ranked.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    if drop_last:
        packed = packed.where(F.size("items") == size)
    out = packed.select("batch", *[F.col("items")[c].alias(c) for c in values])
    if "label" in values:
        out = out.withColumn("label", F.transform("label", lambda v: F.coalesce(v, F.lit(-1))))
    return out
