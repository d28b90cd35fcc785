"""Scan files: discovery, header catalogue, slab extraction, 2-D images."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import paths as P
from cohortlake.functions.formats import detect_format, format_error

# fixed values: NIfTI data type codes
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
# fixed values: header field offsets (dims, type, spacing, data start, slope, sform code, sform rows, endianness probe)
NIFTI1 = {"dim": (40, "i2"), "type": 70, "pix": (76, "f4"), "vox": (108, "f4"), "slope": (112, "f4"), "qcode": 252,
          "scode": (254, "i2"), "quat": (256, "f4"), "srow": (280, "f4"), "size": 348}
NIFTI2 = {"dim": (16, "i8"), "type": 12, "pix": (104, "f8"), "vox": (168, "i8"), "slope": (176, "f8"), "qcode": 344,
          "scode": (348, "i4"), "quat": (352, "f8"), "srow": (400, "f8"), "size": 540}
CATALOG_SCHEMA = (
    "path string, shape array<int>, dtype string, spacing array<double>, affine array<array<double>>, "
    "header map<string,string>, error string"
)
# fixed value: how a gzip member begins
GZIP = b"\x1f\x8b"
# bytes of a file that are unpacked at a time
STEP = 1 << 20
# slices leave a task in batches of about this many pixels
PIXELS_PER_BATCH = 1 << 22
JUDGED_SCHEMA = "path string, shape array<int>, spacing array<double>, intensity_valid boolean, empty_slices_detected boolean, error string"
SLAB_SCHEMA = "scan_id string, c int, z int, nx int, ny int, nz int, px array<float>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def discover_scans(files: DataFrame) -> DataFrame:
    """(path, kind) of scans: a folder holding .dcm files is one scan, other scan files stand alone."""
    known = files.where(P.is_scan(F.col("path")))
    dcm = F.col("path").endswith(".dcm")
    series = known.where(dcm).select(P.parent(F.col("path")).alias("path")).distinct().withColumn("kind", F.lit("series"))
    upper = F.lower(F.col("path")).endswith(".dcm") & ~dcm
    # a .DCM file (any other case) next to .dcm slices belongs to their series
    single = known.where(~dcm).select("path", P.parent(F.col("path")).alias("_p"), upper.alias("_u"))
    inside = series.select(F.col("path").alias("_p"), F.lit(True).alias("_s"))
    single = single.join(inside, "_p", "left").where(~(F.col("_u") & F.coalesce("_s", F.lit(False))))
    return series.unionByName(single.select("path", F.lit("file").alias("kind"))).distinct()


def detected(files: DataFrame) -> DataFrame:
    """Add format and format_error to (path, content)."""
    name = P.basename(F.col("path"))
    out = files.withColumn("format", detect_format(F.col("content"), name))
    return out.withColumn("format_error", format_error(F.col("format"), name))


def unpacked(content: bytes | memoryview, step: int = STEP) -> Iterator[bytes]:
    """The unpacked content of a file in parts of at most ``step`` bytes; of one that is not compressed, as it is.

    All members of a gzip file are read to the end of the last, whatever lengths its trailers give.  A stream that ends early
    raises EOFError, a damaged one zlib.error, both after the parts before.  Zero bytes may follow the last member.
    """
    view = memoryview(content)
    if bytes(view[:2]) != GZIP:
        for at in range(0, len(view), step):
            yield bytes(view[at : at + step])
        return
    at = 0
    while bytes(view[at : at + 2]) == GZIP:
        member = zlib.decompressobj(31)
        while not member.eof:
            if not member.unconsumed_tail and at >= len(view):
                raise EOFError("compressed data ends early")
            given = member.unconsumed_tail or bytes(view[at : at + step])
            at += 0 if member.unconsumed_tail else len(given)
            part = member.decompress(given, step)
            if part:
                yield part
        at -= len(member.unused_data)
    if any(view[at:]):
        raise zlib.error("other data after the last member")


def _header(raw: bytes) -> dict:
    """Parsed fields from the first bytes of an unpacked file."""
    two = raw[4:7] in (b"n+2", b"ni2")
    f = NIFTI2 if two else NIFTI1
    if len(raw) < f["size"]:
        raise ValueError("file is shorter than its header")
    size = {e: int(np.frombuffer(raw, e + "i4", 1)[0]) for e in "<>"}
    end = next((e for e, v in size.items() if v == f["size"]), None)
    if end is None:
        raise ValueError("header size field is wrong")
    take = lambda spec, n: np.frombuffer(raw, end + spec[1], n, spec[0])
    code = int(np.frombuffer(raw, end + "i2", 1, f["type"])[0])
    dims = take(f["dim"], 8)
    if code not in DTYPES or not 1 <= dims[0] <= 7:
        raise ValueError(f"unsupported data type {code} or rank {dims[0]}")
    shape = [int(d) for d in dims[1 : dims[0] + 1]]
    pix = take(f["pix"], 8).astype(float)
    slope, inter = (float(v) for v in take(f["slope"], 2))
    kind = "i4" if two else "i2"
    codes = {k: int(np.frombuffer(raw, end + kind, 1, at)[0]) for k, at in (("sform", f["scode"][0]), ("qform", f["qcode"]))}
    if codes["sform"] > 0:
        affine = np.vstack([take(f["srow"], 12).reshape(3, 4).astype(float), [0, 0, 0, 1]])
    elif codes["qform"] > 0:
        affine = _quaternion(take(f["quat"], 6).astype(float), pix)
    else:
        affine = np.diag([-pix[1], pix[2], pix[3], 1.0])
        affine[:3, 3] = -np.diag(affine)[:3] * (np.array((shape + [1, 1])[:3]) - 1) / 2
    info = {
        "shape": shape, "dtype": np.dtype(DTYPES[code]).name, "affine": affine, "spacing": pix[1 : len(shape) + 1],
        "start": int(take(f["vox"], 1)[0]), "raw_dtype": end + DTYPES[code],
        "slope": slope if np.isfinite(slope) else 0.0, "inter": inter if np.isfinite(inter) else 0.0,
        "fields": {"version": "2" if two else "1", "datatype": str(code), "sform_code": str(codes["sform"]),
                   "qform_code": str(codes["qform"]), "scl_slope": str(slope), "scl_inter": str(inter)},
    }
    return info


def _voxel_end(info: dict) -> int:
    return info["start"] + int(np.prod(info["shape"])) * np.dtype(info["raw_dtype"]).itemsize


def _quaternion(q: np.ndarray, pix: np.ndarray) -> np.ndarray:
    """Affine from quaternion parameters, offsets and spacing."""
    b, c, d = q[:3]
    a = np.sqrt(max(0.0, 1.0 - (b * b + c * c + d * d)))
    rot = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    out = np.eye(4)
    out[:3, :3] = rot * (pix[1:4] * [1, 1, -1 if pix[0] < 0 else 1])
    out[:3, 3] = q[3:6]
    return out


# bytes of a file that is not compressed that the catalogue looks at: more than a header
HEAD = 1 << 10


def catalog(files: DataFrame) -> DataFrame:
    """One header row per (path, content); ``error`` says what is wrong with a file instead of failing the job.

    Of a file that is not compressed only the first bytes leave the JVM, with its length.  A compressed one is walked
    to its end in parts, as only that tells how long it is and whether it is whole.  A file whose voxels
    are cut short, or whose stream is, keeps its header and has an error.
    """
    gz = F.substring("content", 1, 2) == F.lit(GZIP)
    body = F.when(gz, F.col("content")).otherwise(F.substring("content", 1, HEAD))
    rows = files.select("path", body.alias("body"), F.octet_length("content").cast("long").alias("length"), gz.alias("gz"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, body, length, packed in zip(pdf["path"], pdf["body"], pdf["length"], pdf["gz"]):
                head, size, error, info = b"", 0, None, None
                try:
                    for part in unpacked(body):
                        head += part[: max(HEAD - len(head), 0)]
                        size += len(part)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                try:
                    info = _header(head)
                    if error is None and (size if packed else length) < _voxel_end(info):
                        error = "ValueError: voxel data is cut short"
                except Exception as e:
                    error = error or f"{type(e).__name__}: {e}"
                found = (info["shape"], info["dtype"], info["spacing"].tolist(), info["affine"].tolist(), info["fields"]) if info else (None,) * 5
                rows.append((path, *found, error))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "spacing", "affine", "header", "error"])

    return rows.mapInPandas(parse, CATALOG_SCHEMA)


def _volume(content: bytes) -> tuple[dict, bytearray]:
    """Header and bytes up to the last voxel; the stream is read to its end, but what follows the voxels is not kept."""
    raw, info = bytearray(), None
    for part in unpacked(content):
        if info is None or len(raw) < _voxel_end(info):
            raw += part
        if info is None and len(raw) >= HEAD:
            info = _header(bytes(raw[:HEAD]))
    return info or _header(bytes(raw[:HEAD])), raw


def judged(files: DataFrame, *kept: str) -> DataFrame:
    """Per (path, content): shape, spacing, whether its values differ at all, and whether a slice of several is flat; the columns ``kept`` stay.

    A file is read once and its voxels stay in the task.  ``error`` says what is wrong with one that
    cannot be read to its last voxel, which has no other values.  Values that are no numbers make a slice and a scan flat.
    A row whose content is null is passed on as it is, with nulls.
    """
    names = ["path", "shape", "spacing", "intensity_valid", "empty_slices_detected", "error"]
    held = files.select("path", "content", *kept)
    schema = ", ".join([JUDGED_SCHEMA, *[f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[2:]]])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if content is None:
                    rows.append((path, *[None] * 5))
                    continue
                try:
                    info, raw = _volume(content)
                    shape = (info["shape"] + [1, 1])[: max(3, len(info["shape"]))]
                    flat = np.frombuffer(raw, info["raw_dtype"], int(np.prod(shape)), info["start"])
                    cube = flat.reshape(shape, order="F").reshape(*shape[:3], -1, order="F")
                    low, high = cube.min(axis=(0, 1, 3)), cube.max(axis=(0, 1, 3))
                    same = ~(high > low)
                    rows.append((path, info["shape"], info["spacing"].tolist(), bool(high.max() > low.min()), bool(len(low) > 1 and same.any()), None))
                except Exception as e:
                    rows.append((path, *[None] * 4, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(**{c: pdf[c].to_numpy() for c in kept})

    return held.mapInPandas(judge, schema)


def extract(files: DataFrame) -> DataFrame:
    """One row per (channel, z) slice of each readable file, and one row with ``error`` for every other file.

    A file is one task's read either way, but its voxels leave as slices, so no later step handles a whole volume.
    """
    names = ["scan_id", "c", "z", "nx", "ny", "nz", "px", "error"]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names[1:6]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, pixels = [], 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    info, raw = _volume(content)
                    shape = (info["shape"] + [1, 1])[: max(3, len(info["shape"]))]
                    flat = np.frombuffer(raw, info["raw_dtype"], int(np.prod(shape)), info["start"])
                except Exception as e:
                    rows.append((path, *[None] * 6, f"{type(e).__name__}: {e}"))
                    continue
                cube = flat.reshape(shape, order="F").reshape(*shape[:3], -1, order="F")
                nx, ny, nz, channels = cube.shape
                for c, z in np.ndindex(channels, nz):
                    px = cube[:, :, z, c].astype(np.float64)
                    if info["slope"] != 0:
                        px = px * info["slope"] + info["inter"]
                    rows.append((path, c, z, nx, ny, nz, px.astype(np.float32).ravel(), None))
                    pixels += px.size
                    if pixels >= PIXELS_PER_BATCH:
                        yield frame(rows)
                        rows, pixels = [], 0
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(decode, SLAB_SCHEMA + ", error string")


def extract_slabs(files: DataFrame) -> DataFrame:
    """The slices of :func:`extract`; files that could not be read are listed by :func:`extraction_errors`."""
    return extract(files).where("error is null").drop("error")


def extraction_errors(files: DataFrame) -> DataFrame:
    """(scan_id, error) of files without slices."""
    return extract(files).where("error is not null").select("scan_id", "error")


def _pictures(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The rows of Spark's image source; with ``glob`` those of files of that name in all folders below."""
    reader = spark.read.format("image").option("dropInvalid", True)
    if glob is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(path).select("image.*")


def judged_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Per picture (scan_id): shape, and whether its grey values differ at all.

    Pixels stay in the task that decodes the picture; grey is that of :func:`read_images`.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, w, h, ch, data in zip(pdf["origin"], pdf["width"], pdf["height"], pdf["nChannels"], pdf["data"]):
                px = np.frombuffer(data, "u1").reshape(-1, ch)
                grey = px if ch == 1 else np.floor(0.114 * px[:, 0] + 0.587 * px[:, 1] + 0.299 * px[:, 2] + 0.5)
                rows.append((name, [w, h, 1], bool(grey.max() > grey.min())))
            yield pd.DataFrame(rows, columns=["scan_id", "shape", "intensity_valid"])

    return _pictures(spark, path, glob).drop("mode").mapInPandas(judge, "scan_id string, shape array<int>, intensity_valid boolean")


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """2-D images as one-slice slabs, grey, transposed to (x, y); with ``glob`` those of that name in all folders below.

    Decoding is Spark's image source; grey is the usual luminance of the blue-green-red bytes it returns.
    """
    img = _pictures(spark, path, glob)
    w, h, ch = F.col("width"), F.col("height"), F.col("nChannels")
    byte = lambda i: F.conv(F.hex(F.substring(F.col("data"), (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")

    def grey(i):
        # pixel (x, y) of the transposed slice sits at row y, column x of the picture
        at = ((i % h) * w + F.floor(i / h)) * ch
        mixed = F.round(0.114 * byte(at) + 0.587 * byte(at + 1) + 0.299 * byte(at + 2))
        return F.when(ch == 1, byte(at)).otherwise(mixed).cast("float")

    return img.select(
        F.col("origin").alias("scan_id"), F.lit(0).alias("c"), F.lit(0).alias("z"), w.alias("nx"), h.alias("ny"),
        F.lit(1).alias("nz"), F.transform(F.sequence(F.lit(0), w * h - 1), grey).alias("px"),
    )


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, affine) of 2-D images: height, width, channels; identity affine."""
    img = _pictures(spark, path)
    text = lambda c: F.col(c).cast("string")
    header = F.create_map(
        F.lit("height"), text("height"), F.lit("width"), text("width"), F.lit("channels"), text("nChannels")
    )
    eye = F.array(*[F.array(*[F.lit(float(r == c)) for c in range(4)]) for r in range(4)])
    return img.select(F.col("origin").alias("path"), header.alias("header"), eye.alias("affine"))


def normal_header(header) -> object:
    """Header map without null or blank entries, values trimmed."""
    kept = F.map_filter(header, lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    return F.transform_values(kept, lambda _, v: F.trim(v))


def file_checks(files: DataFrame, headers: DataFrame) -> DataFrame:
    """exists, readable, corrupt per expected path; ``files`` is the listing, ``headers`` the catalogue."""
    j = files.select("path", F.lit(True).alias("_f")).join(
        headers.select("path", "error", F.lit(True).alias("_h")), "path", "full_outer"
    )
    exists = F.coalesce("_f", F.lit(False))
    readable = exists & F.coalesce("_h", F.lit(False)) & F.col("error").isNull()
    return j.select("path", exists.alias("exists"), readable.alias("readable"), (~(exists & readable)).alias("corrupt"))
