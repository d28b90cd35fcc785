"""Header and phenotype clean-up: sentinels, codes, spacing, scanner and patient tags, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlake.functions.scoring import once

# fixed values
SENTINELS = ["-9999", "-9999.0", "NaN", "nan", ""]
DIAGNOSIS_CODES = {1: "ASD", 2: "CONTROL"}
SEX_CODES = {1: "Male", 2: "Female"}
LABEL_CODES = {"CONTROL": 0, "ASD": 1, "CN": 0, "AD": 1}
LABEL_NAMES = {0: "Control", 1: "Autism"}
TAGS = {
    "manufacturer": "0008|0070", "model": "0008|1090", "field_strength": "0018|0087", "scan_date": "0008|0020",
    "patient_id": "0010|0020", "age": "0010|1010", "gender": "0010|0040",
}


def clean_number(raw: Column) -> Column:
    """Number behind a text cell; null for sentinels and for text."""
    text = F.trim(raw.cast("string"))
    return F.when(~text.isin(SENTINELS), text.try_cast("double"))


def clean_text(raw: Column) -> Column:
    """Cell with sentinels nulled: whole numbers without a fraction part, other text trimmed."""
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & (F.abs(number) < 9e15) & (number == F.floor(number))
    return F.when(text.isin(SENTINELS), None).when(whole, number.cast("bigint").cast("string")).otherwise(text)


def decode(code: Column, names: dict[int, str]) -> Column:
    """Code -> name; null for unknown codes."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def encode_label(label: Column, codes: dict[str, int] | None = None) -> Column:
    """Name -> code; -1 for unknown names."""
    out = F.lit(-1)
    for k, v in (codes or LABEL_CODES).items():
        out = F.when(label == k, v).otherwise(out)
    return out


def decode_label(code: Column, names: dict[int, str] | None = None) -> Column:
    """Code -> name; an unknown code becomes its own text."""
    return F.coalesce(decode(code, names or LABEL_NAMES), code.cast("string"))


def voxel_spacing(affine: Column, fmt: Column) -> Column:
    """Lengths of the first three affine columns (0 becomes 1); 2-D images have unit spacing."""
    def length(c: Column) -> Column:
        total = F.aggregate(F.slice(affine, 1, 3), F.lit(0.0), lambda acc, row: acc + F.get(row, c) * F.get(row, c))
        return F.coalesce(F.nullif(F.sqrt(total), F.lit(0.0)), F.lit(1.0))

    lengths = F.transform(F.sequence(F.lit(0), F.lit(2)), length)
    return F.when(fmt == "image", F.array_repeat(F.lit(1.0), F.lit(3))).otherwise(lengths)


def tag(header: Column, name: str) -> Column:
    return F.try_element_at(header, F.lit(TAGS[name]))


def parse_float(raw: Column) -> Column:
    return F.trim(raw).try_cast("double")


def parse_age(raw: Column) -> Column:
    """``030Y`` or a plain number -> years; null otherwise."""
    text = F.trim(raw)
    return F.when(text.rlike("^[0-9]+Y$"), F.regexp_replace(text, "Y$", "").try_cast("double")).otherwise(
        text.try_cast("double")
    )


def scanner(fmt: Column, header: Column) -> Column:
    """Struct of scanner fields; only the tagged format carries them."""
    only = lambda c: F.when(fmt == "dicom", c)
    return F.struct(
        only(F.trim(F.coalesce(tag(header, "manufacturer"), F.lit("Unknown")))).alias("manufacturer"),
        only(F.trim(F.coalesce(tag(header, "model"), F.lit("Unknown")))).alias("model"),
        only(parse_float(tag(header, "field_strength"))).alias("magnetic_field_strength"),
        only(tag(header, "scan_date")).alias("scan_date"),
    )


def patient(fmt: Column, header: Column) -> Column:
    tagged = fmt == "dicom"
    return F.struct(
        F.when(tagged, F.trim(F.coalesce(tag(header, "patient_id"), F.lit("Anonymous"))))
        .otherwise("Anonymous_Patient").alias("patient_id"),
        F.when(tagged, parse_age(tag(header, "age"))).alias("age"),
        F.when(tagged, F.trim(F.coalesce(tag(header, "gender"), F.lit("Unknown")))).alias("gender"),
    )


def image_info(fmt: Column, affine: Column, shape: Column) -> Column:
    flat = fmt == "image"
    return F.struct(
        voxel_spacing(affine, fmt).alias("voxel_dims"),
        shape.alias("dimensions"),
        F.when(flat, "2D").otherwise("RAS").alias("orientation"),
        F.when(flat, "Standard 2D").otherwise("T1w").alias("modality"),
    )


def fixed_text(value: Column, digits: int) -> Column:
    """``%.<digits>f`` of the exact binary value, ties to even, as most languages print it.

    The built-in formatter rounds the shortest decimal form half up, which differs when that
    form ends in 5.  The comparison with the midpoint stays exact because the value is split
    into a 24-bit head and the remainder before it is scaled.  Null stays null.

    Each step's figure is handed on once: written out, the steps repeat each other until the code
    that Spark makes of them is too long to be compiled.
    """
    scale = 10**digits

    def rounded(x: Column, k: Column) -> Column:
        head = x.cast("float").cast("double")
        off = (head * (2 * scale) - (2 * k + 1)) + (x - head) * (2 * scale)
        return k + once(off, lambda o: F.when(o > 0, 1).when(o < 0, 0).otherwise(k % 2))

    def spelled(n: Column) -> Column:
        if not digits:
            return n.cast("string")
        whole = ((n - n % scale) / scale).cast("bigint").cast("string")
        return F.concat(whole, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))

    def text(x: Column) -> Column:
        near = once(once(F.floor(x * scale), lambda k: rounded(x, k)), spelled)
        far = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").otherwise(F.format_string(f"%.{digits}f", x))
        return F.when(x < 2.0**52 / (4 * scale), near).otherwise(far)

    signed = lambda v: F.concat(F.when(v < 0, "-").otherwise(""), once(F.abs(v), text))
    return once(value.cast("double"), lambda v: F.when(v.isNotNull(), signed(v)))


def fixed(value: Column, digits: int = 4) -> Column:
    """Metric as fixed-width text; null becomes N/A."""
    return F.coalesce(fixed_text(value, digits), F.lit("N/A"))


def metric_number(text: Column) -> Column:
    """Metric text back to a number; anything else (N/A) becomes 0."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def record_id(prefix: str, key: Column) -> Column:
    """``prefix_`` and eight hex digits, stable for the key."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(key.cast("string")), 1, 8))


def report_id(patient_id: Column, epoch_seconds: Column) -> Column:
    return F.concat(F.lit("rep_"), patient_id, F.lit("_"), epoch_seconds.cast("bigint").cast("string"))


def report_summary(patient_id: Column, model: Column) -> Column:
    return F.concat(
        F.lit("Analysis report generated for patient "), patient_id, F.lit(" using model "), model, F.lit(".")
    )


def stable_params(params: Column) -> Column:
    """Map as text in key order."""
    pairs = F.transform(
        F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.concat_ws(",", pairs)


def content_fingerprint(length: Column, modified: Column, content: Column, head: int | None = None) -> Column:
    """sha256 over ``size_mtime`` and the content; '' without a file.

    ``head`` limits the content to its first bytes (1048576 gives the usual quick hash).
    """
    stamp = F.concat(length.cast("string"), F.lit("_"), modified.cast("string"))
    body = content if head is None else F.substring(content, 1, head)
    return F.when(length.isNull(), "").otherwise(F.sha2(F.concat(stamp.cast("binary"), body), 256))


def state_hash(shape: Column, spacing: Column, affine: Column, mean: Column, std: Column, mask_mean: Column | None = None) -> Column:
    """sha256 of a volume's layout and rounded moments."""
    bits = [shape, spacing, affine, fixed_text(mean, 6), fixed_text(std, 6)]
    if mask_mean is not None:
        bits.append(F.concat(F.lit("mask_"), fixed_text(mask_mean, 6)))  # nulls are skipped by concat_ws
    return F.sha2(F.concat_ws("_", *bits), 256)


def step_cache_key(input_hash: Column, step: Column, params: Column, version: str = "1.0.0") -> Column:
    return F.sha2(F.concat_ws("_", input_hash, step, stable_params(params), F.lit(version)), 256)
