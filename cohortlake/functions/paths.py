"""Path expressions: subjects, classes and modalities read off file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: directory names that mark a class, in matching order
CLASS_DIRS = ["AD", "CN", "CONTROL", "TUMOR", "AUTISM", "NORMAL"]
# fixed values: file-name marks of the multimodal layout, in matching order
MODALITY_MARKS = [("_seg", "mask"), ("_t1ce", "t1ce"), ("_t1", "t1"), ("_t2", "t2"), ("_flair", "flair")]
MODALITIES = ["t1", "t1ce", "t2", "flair"]
# fixed values: extensions of scan files
SCAN_EXTENSIONS = [".nii", ".nii.gz", ".dcm", ".png", ".jpg", ".jpeg"]


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def is_scan(path: Column) -> Column:
    name = F.lower(basename(path))
    hit = F.lit(False)
    for ext in SCAN_EXTENSIONS:
        hit = hit | name.endswith(ext)
    return hit


def reroot(path: Column, new_root: str | None) -> Column:
    """Move a path below ``new_root``, keeping the folder above the first ``sub-`` component onward.

    Without such a component only the file name is kept; without a new root the path is unchanged.
    """
    if new_root is None:
        return path
    p = parts(path)
    hits = F.filter(p, lambda s: s.startswith("sub-"))
    first = F.array_position(p, F.try_element_at(hits, F.lit(1)))
    start = F.greatest(first - 1, F.lit(1)).cast("int")
    tail = F.when(F.size(hits) > 0, F.slice(p, start, F.size(p))).otherwise(F.array(F.element_at(p, -1)))
    return F.concat_ws("/", F.lit(new_root.rstrip("/")), F.concat_ws("/", tail))


def subject_digits(path: Column) -> Column:
    """Digits after ``sub-`` in the file name, else its folder, else the folder above; null if none."""
    comps = F.reverse(F.split(path, "/"))
    found = [
        F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(comps, F.lit(i)), F.lit("")), r"sub-(\d+)", 1), F.lit(""))
        for i in (1, 2, 3)
    ]
    return F.coalesce(*found)


def subject_key(path: Column) -> Column:
    """Integer join key of a subject, leading zeros stripped."""
    return subject_digits(path).cast("bigint")


def is_t1w(path: Column) -> Column:
    return basename(path).rlike(r"_T1w\.nii")


def folder_subject(rel_path: Column) -> Column:
    """Subject of a path relative to the root: its first folder, or the second below a class folder."""
    p = parts(rel_path)
    first = F.element_at(p, 1)
    nested = F.upper(first).isin(CLASS_DIRS) & (F.size(p) > 1)
    return F.when(nested, F.try_element_at(p, F.lit(2))).otherwise(first)


def path_class(rel_path: Column) -> Column:
    """Class of a relative path: nearest class folder, else the first class name inside the file stem, else Unknown."""
    folders = F.reverse(F.slice(parts(rel_path), 1, F.size(parts(rel_path)) - 1))
    known = F.filter(F.transform(folders, F.upper), lambda p: p.isin(CLASS_DIRS))
    by_stem = F.lit("Unknown")
    for name in reversed(CLASS_DIRS):
        by_stem = F.when(F.contains(F.upper(stem(rel_path)), F.lit(name)), name).otherwise(by_stem)
    return F.coalesce(F.try_element_at(known, F.lit(1)), by_stem)


def _ordered(name: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose text occurs in ``name``; null if none does."""
    out = F.lit(None).cast("string")
    for text, value in reversed(rules):
        out = F.when(F.contains(name, F.lit(text)), value).otherwise(out)
    return out


def two_class_label(folder: Column) -> Column:
    """CONTROL or ASD from a class folder; null means the folder is skipped."""
    name = F.upper(folder)
    rules = [("CONTROL", "CONTROL"), ("ASD", "ASD"), ("AUTISM", "ASD")]
    return F.when(name.isin("CONTROL", "ASD"), name).otherwise(_ordered(name, rules))


def three_class_label(folder: Column) -> Column:
    """CN, AD or MCI from a class folder; null means the folder is skipped."""
    name = F.upper(folder)
    rules = [
        ("CN", "CN"), ("NORMAL", "CN"), ("CONTROL", "CN"),
        ("AD", "AD"), ("ALZHEIMER", "AD"), ("MCI", "MCI"),
    ]
    return F.when(name.isin("CN", "AD", "MCI"), name).otherwise(_ordered(name, rules))


def modality(file_name: Column) -> Column:
    """mask, t1ce, t1, t2 or flair from a file name; null for other files."""
    return _ordered(F.lower(file_name), MODALITY_MARKS)
