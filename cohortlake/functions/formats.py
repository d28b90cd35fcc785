"""File format from leading bytes and name, as expressions over a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: signatures (hex) with their 1-based positions, in testing order
SIGNATURES = [
    ("image", 1, "89504E470D0A1A0A", 8), ("image", 1, "FFD8FF", 3), ("dicom", 129, "4449434D", 132),
    ("nifti", 345, "6E2B31", 348), ("nifti", 345, "6E6931", 348), ("nifti", 5, "6E2B32", 8), ("nifti", 5, "6E6932", 8),
]
# fixed values: extensions used when no signature matches
EXTENSIONS = [(".nii", "nifti"), (".nii.gz", "nifti"), (".dcm", "dicom"), (".png", "image"), (".jpg", "image"), (".jpeg", "image")]


def detect_format(content: Column, name: Column) -> Column:
    """nifti, dicom or image; null when neither bytes nor extension are known.  Bytes win over the extension."""
    out = F.lit(None).cast("string")
    lower = F.lower(name)
    for ext, fmt in reversed(EXTENSIONS):
        out = F.when(lower.endswith(ext), fmt).otherwise(out)
    for fmt, at, magic, need in reversed(SIGNATURES):
        hit = (F.octet_length(content) >= need) & (F.hex(F.substring(content, at, len(magic) // 2)) == magic)
        out = F.when(hit, fmt).otherwise(out)
    return out


def format_error(fmt: Column, name: Column) -> Column:
    return F.when(fmt.isNull(), F.concat(F.lit("unsupported format or unknown magic bytes: "), name))
