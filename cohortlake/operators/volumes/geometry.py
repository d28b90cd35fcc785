"""Coordinate operators on slabs: reorient, crop, pad, flip, shift, quarter turns, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import affine as A
from cohortlake.operators.volumes.slabs import (
    COLUMNS,
    columns_reversed,
    reshaped,
    rows_reversed,
    shape_of,
    transposed,
    window,
)
from cohortlake.operators.volumes.stats import foreground_box, to_grey
from cohortlake.session import stacked

AXES = ("nx", "ny", "nz")


def flip(slabs: DataFrame, axis: int) -> DataFrame:
    """x' = n - 1 - x along one axis, row by row."""
    nx, ny = F.col("nx"), F.col("ny")
    if axis == 2:
        return slabs.withColumn("z", F.col("nz") - 1 - F.col("z"))
    mirrored = rows_reversed if axis == 0 else columns_reversed
    return slabs.withColumn("px", mirrored(F.col("px"), nx, ny))


def translate(slabs: DataFrame, dx: Column | int, dy: Column | int, dz: Column | int) -> DataFrame:
    """Shift by whole voxels; vacated voxels become 0.  Slices shifted out make room for blank ones."""
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    moved = slabs.withColumn("_z", F.col("z") + dz).withColumn("_in", F.col("_z").between(0, nz - 1))
    px = F.when(F.col("_in"), window(F.col("px"), nx, ny, -dx, -dy, nx, ny)).otherwise(
        F.array_repeat(F.lit(0.0), F.size("px")).cast(dict(slabs.dtypes)["px"])
    )
    # pmod sends every slice that left at one end to the gap at the other end, as a blank one
    return moved.withColumn("px", px).withColumn("z", F.pmod(F.col("_z"), nz).cast("int")).select(*slabs.columns)


def cut(slabs: DataFrame, origin: Sequence[Column], size: Sequence[Column]) -> DataFrame:
    """Sub-box starting at ``origin`` with ``size`` voxels; no shuffle."""
    ox, oy, oz = origin
    kept = slabs.where((F.col("z") >= oz) & (F.col("z") < oz + size[2]))
    px = window(F.col("px"), F.col("nx"), F.col("ny"), ox, oy, size[0], size[1])
    return reshaped(kept, px, F.col("z") - oz, list(size))


def place(slabs: DataFrame, offset: Sequence[Column], size: Sequence[Column], fill: float = 0.0) -> DataFrame:
    """Volume set at ``offset`` into a box of ``size`` voxels of ``fill``.

    Blank slices come from one narrow row per scan and channel, so no pixels are shuffled and a scan that
    lacks its first slice gets them too.
    """
    ox, oy, oz = offset
    px = window(F.col("px"), F.col("nx"), F.col("ny"), -ox, -oy, size[0], size[1], fill)
    here = F.col("z") + oz
    blank_z = F.filter(F.sequence(F.lit(0), (size[2] - 1).cast("int")), lambda z: (z < oz) | (z >= oz + F.col("nz")))
    kept = reshaped(slabs, px, here, list(size)).select(*slabs.columns)
    others = [c for c in slabs.columns if c not in ("scan_id", "c", "z", "px")]
    scans = slabs.groupBy("scan_id", "c").agg(*[F.first(c).alias(c) for c in others]).withColumn("z", F.explode(blank_z))
    blank = F.array_repeat(F.lit(float(fill)), (size[0] * size[1]).cast("int"))
    empty = reshaped(scans.withColumn("px", F.array().cast("array<double>")), blank, F.col("z"), list(size))
    return stacked(kept, empty.select(*slabs.columns))


def _joined(slabs: DataFrame, per_scan: DataFrame) -> DataFrame:
    return slabs.join(per_scan, "scan_id", "left")


def crop_foreground(slabs: DataFrame, affines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slabs, affines, params): trimmed to non-zero voxels; a scan without any stays as it is."""
    box = foreground_box(slabs)
    j = _joined(slabs, box)
    low = [F.coalesce(F.col(f"{a}0"), F.lit(0)) for a in "xyz"]
    size = [F.coalesce(F.col(f"{a}1") - F.col(f"{a}0") + 1, F.col(n)) for a, n in zip("xyz", AXES)]
    out = cut(j, low, size).select(*slabs.columns)
    moved = affines.join(box, "scan_id", "left").select("scan_id", A.moved_origin(F.col("affine"), low).alias("affine"))
    shape = shape_of(slabs)
    params = shape.join(box, "scan_id").select(
        "scan_id", F.array(*AXES).alias("original_shape"), F.array("x0", "y0", "z0").alias("offsets")
    )
    return out, moved, params


def _margins(target: Sequence[int], grow: bool) -> list[Column]:
    """Leading margin per axis: half of the size difference, rounded down, where there is one."""
    out = []
    for t, n in zip(target, AXES):
        d = (F.lit(int(t)) - F.col(n)) if grow else (F.col(n) - F.lit(int(t)))
        out.append(F.when(d > 0, F.floor(d / 2)).otherwise(0).cast("int"))
    return out


def _recorded(slabs: DataFrame, affines: DataFrame, margins: list[Column], sign: int):
    shape = shape_of(slabs).select("scan_id", F.array(*AXES).alias("original_shape"), F.array(*margins).alias("offsets"))
    steps = [F.col("offsets")[i] * sign for i in range(3)]
    moved = affines.join(shape, "scan_id").select("scan_id", A.moved_origin(F.col("affine"), steps).alias("affine"))
    return moved, shape


def pad(slabs: DataFrame, affines: DataFrame, target: Sequence[int], value: float = 0.0):
    """Symmetric pad up to ``target``; axes already that large are kept."""
    margins = _margins(target, grow=True)
    size = [F.greatest(F.lit(int(t)), F.col(n)) for t, n in zip(target, AXES)]
    moved, params = _recorded(slabs, affines, margins, -1)
    return place(slabs, margins, size, value), moved, params


def center_crop(slabs: DataFrame, affines: DataFrame, target: Sequence[int]):
    """Central box of at most ``target`` voxels per axis."""
    margins = _margins(target, grow=False)
    size = [F.least(F.lit(int(t)), F.col(n)) for t, n in zip(target, AXES)]
    moved, params = _recorded(slabs, affines, margins, 1)
    return cut(slabs, margins, size), moved, params


def uncrop(slabs: DataFrame, affines: DataFrame, params: DataFrame):
    """Inverse of a crop: zeros around the kept box."""
    j = slabs.join(params, "scan_id", "left")
    off = [F.coalesce(F.col("offsets")[i], F.lit(0)) for i in range(3)]
    size = [F.coalesce(F.col("original_shape")[i], F.col(n)) for i, n in enumerate(AXES)]
    out = place(j, off, size).select(*slabs.columns)
    moved = affines.join(params, "scan_id", "left").select(
        "scan_id", A.moved_origin(F.col("affine"), [-o for o in off]).alias("affine")
    )
    return out, moved


def unpad(slabs: DataFrame, affines: DataFrame, params: DataFrame):
    """Inverse of a pad: the original box cut out again."""
    j = slabs.join(params, "scan_id")
    off = [F.col("offsets")[i] for i in range(3)]
    out = cut(j, off, [F.col("original_shape")[i] for i in range(3)]).select(*slabs.columns)
    moved = affines.join(params, "scan_id").select("scan_id", A.moved_origin(F.col("affine"), off).alias("affine"))
    return out, moved


def permute(slabs: DataFrame, source: Sequence[Column], flipped: Sequence[Column]) -> DataFrame:
    """Output axis t takes input axis ``source[t]``, reversed where ``flipped[t]``.

    Scans whose slice axis stays in place are rewritten row by row.  The others are sent as lines: a slice falls
    apart along the axis that becomes the slice axis, and each output slice is put together from one line
    of every input slice.
    """
    n = [F.col(c) for c in AXES]
    pick = lambda t, opts: F.when(source[t] == 0, opts[0]).when(source[t] == 1, opts[1]).otherwise(opts[2])
    size = [pick(t, n) for t in range(3)]
    # flag of an input axis: that of the output axis it feeds
    turned = [
        F.when(source[0] == a, flipped[0]).when(source[1] == a, flipped[1]).otherwise(flipped[2]) for a in range(3)
    ]
    back = lambda a, v: F.when(turned[a], n[a] - 1 - v).otherwise(v)
    # inside a slice: mirror along the input axes first, then exchange them if needed
    px = F.col("px")
    px = F.when(turned[0], rows_reversed(px, n[0], n[1])).otherwise(px)
    px = F.when(turned[1], columns_reversed(px, n[0], n[1])).otherwise(px)
    px = F.when(source[0] == 1, transposed(px, n[0], n[1])).otherwise(px)
    plane = reshaped(slabs.where(source[2] == 2), px, back(2, F.col("z")), [size[0], size[1], n[2]]).select(*COLUMNS)
    along_x = source[2] == 0  # else along y
    length = F.when(along_x, n[1]).otherwise(n[0]).cast("int")
    count = F.when(along_x, n[0]).otherwise(n[1]).cast("int")
    line_turned = F.when(along_x, turned[1]).otherwise(turned[0])
    ready = slabs.where(source[2] != 2).select(
        "scan_id", "c", back(2, F.col("z")).cast("int").alias("_pos"), n[2].alias("_depth"), length.alias("_len"), count.alias("_count"),
        F.when(along_x, F.col("px")).otherwise(transposed(F.col("px"), n[0], n[1])).alias("_rows"),
        F.when(along_x, turned[0]).otherwise(turned[1]).alias("_back"), line_turned.alias("_rev"), (source[0] == 2).alias("_first"),
        *[s.cast("int").alias(f"_{k}") for s, k in zip(size, AXES)],
    )
    lines = ready.select("*", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_k"))
    line = F.slice("_rows", F.col("_k") * F.col("_len") + 1, F.col("_len"))
    lines = lines.select(
        "scan_id", "c", F.when(F.col("_back"), F.col("_count") - 1 - F.col("_k")).otherwise(F.col("_k")).alias("z"),
        *[f"_{k}" for k in AXES], "_depth", "_len", "_first",
        F.struct("_pos", F.when(F.col("_rev"), F.reverse(line)).otherwise(line).alias("line")).alias("_line"),
    )
    whole = lines.groupBy("scan_id", "c", "z", *[f"_{k}" for k in AXES], "_depth", "_len", "_first").agg(
        F.array_sort(F.collect_list("_line")).alias("_lines")
    )
    stack = whole.withColumn("_px", F.flatten(F.col("_lines.line")))  # input slices down, the line across
    px = F.when(F.col("_first"), F.col("_px")).otherwise(transposed(F.col("_px"), F.col("_depth"), F.col("_len")))
    turned_slabs = stack.select("scan_id", "c", "z", *[F.col(f"_{k}").alias(k) for k in AXES], px.alias("px"))
    return stacked(plane, turned_slabs)


def rotate90(slabs: DataFrame, k: int) -> DataFrame:
    """k quarter turns in the (y, z) plane, from the second axis towards the third."""
    k %= 4
    if k == 0:
        return slabs
    lit = [F.lit(v) for v in range(3)]
    yes, no = F.lit(True), F.lit(False)
    if k == 2:
        return permute(slabs, lit, [no, yes, yes])
    # one turn: out[y, z] = in[z, n - 1 - y]; three turns run the other way
    return permute(slabs, [lit[0], lit[2], lit[1]], [no, yes, no] if k == 1 else [no, no, yes])


def reorient(slabs: DataFrame, affines: DataFrame, target: str = "RAS", current: DataFrame | None = None):
    """(slabs, affines, params) in the ``target`` axis order and directions.

    ``current`` (scan_id, codes, target) overrides what the affine says; the inverse step uses it.
    """
    if current is None:
        current = affines.select("scan_id", A.orientation(F.col("affine")).alias("codes"), F.lit(target).alias("target"))
    # worked out once per scan, then joined
    turn = current.select(
        "scan_id", "codes", "target",
        *[A.axis_source(F.col("codes"), F.col("target"), t).alias(f"_s{t}") for t in range(3)],
        *[A.axis_flipped(F.col("codes"), F.col("target"), t).alias(f"_f{t}") for t in range(3)],
    )
    source, flipped = [F.col(f"_s{t}") for t in range(3)], [F.col(f"_f{t}") for t in range(3)]
    out = permute(slabs.join(turn, "scan_id"), source, flipped)
    sizes = affines.join(turn, "scan_id").join(shape_of(slabs), "scan_id")
    rows = []
    for r in range(3):
        cols, origin = [], A.cell(F.col("affine"), r, 3)
        for t in range(3):
            a = F.element_at(F.element_at("affine", r + 1), source[t] + 1)
            n = F.get(F.array(*AXES), source[t])
            cols.append(F.when(flipped[t], -a).otherwise(a))
            origin = origin + F.when(flipped[t], a * (n - 1)).otherwise(0.0)
        rows.append([*cols, origin])
    moved = sizes.select("scan_id", A.matrix(rows).alias("affine"))
    return out.select(*slabs.columns), moved, turn.select("scan_id", "codes", "target")


def previews(slabs: DataFrame) -> DataFrame:
    """(scan_id, plane, slice_idx, rows, cols, image): grey middle planes of 3-D scans, or the one 2-D slice.

    Only the middle row or column of each slice is kept before slices are brought together.
    """
    c0 = slabs.where("c = 0")
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    mid = lambda n: F.floor(n / 2).cast("int")
    axial = c0.where((F.col("z") == mid(nz)) & (nz > 1) | (nz == 1)).select(
        "scan_id", F.when(nz > 1, "axial").otherwise("2D Image").alias("plane"), F.col("z").alias("slice_idx"),
        nx.alias("rows"), ny.alias("cols"), "px",
    )
    deep = c0.where(nz > 1)
    coronal_line = F.transform(F.sequence(F.lit(0), nx - 1), lambda x: F.get("px", (x * ny + mid(ny)).cast("int")))
    sagittal_line = F.slice("px", mid(nx) * ny + 1, ny)
    lines = deep.select(
        "scan_id", "z", "nz",
        F.explode(
            F.array(
                F.struct(F.lit("coronal").alias("plane"), mid(ny).alias("slice_idx"), nx.alias("rows"), coronal_line.alias("line")),
                F.struct(F.lit("sagittal").alias("plane"), mid(nx).alias("slice_idx"), ny.alias("rows"), sagittal_line.alias("line")),
            )
        ).alias("s"),
    ).select("scan_id", "z", "nz", "s.*")
    grouped = lines.groupBy("scan_id", "plane", "slice_idx", "rows", F.col("nz").alias("cols")).agg(
        F.array_sort(F.collect_list(F.struct("z", "line"))).alias("_l")
    )
    # lines are z-major; the picture is row-major in (x or y, z)
    px = F.transform(
        F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1),
        lambda i: F.get(F.get(F.col("_l.line"), (i % F.col("cols")).cast("int")), F.floor(i / F.col("cols")).cast("int")),
    )
    planes = grouped.select("scan_id", "plane", "slice_idx", "rows", "cols", px.alias("px"))
    return stacked(axial, planes).select(
        "scan_id", "plane", "slice_idx", "rows", "cols", to_grey(F.col("px")).alias("image")
    )


def plane(slabs: DataFrame, axis: int, index: Column) -> DataFrame:
    """Voxels of one slice along any axis: (scan_id, c, x, y, z, v).

    Only the wanted row or column of a slice becomes rows; an index outside a scan gives none of its voxels.
    """
    nx, ny = F.col("nx"), F.col("ny")
    at = slabs.withColumn("_at", index.cast("int"))
    inside = at.where((F.col("_at") >= 0) & (F.col("_at") < F.col(AXES[axis])))
    if axis == 2:
        rows = inside.where("z = _at").select("scan_id", "c", "z", "ny", F.posexplode("px").alias("i", "v"))
        x, y = F.floor(F.col("i") / ny), F.col("i") % ny
    elif axis == 1:
        line = F.transform(F.sequence(F.lit(0), nx - 1), lambda x: F.get("px", x * ny + F.col("_at")))
        rows = inside.select("scan_id", "c", "z", "_at", F.posexplode(line).alias("i", "v"))
        x, y = F.col("i"), F.col("_at")
    else:
        line = F.slice("px", F.col("_at") * ny + 1, ny)
        rows = inside.select("scan_id", "c", "z", "_at", F.posexplode(line).alias("i", "v"))
        x, y = F.col("_at"), F.col("i")
    return rows.select("scan_id", "c", x.cast("int").alias("x"), y.cast("int").alias("y"), "z", "v")
