"""Volume operators on 4 x 4 x 4 stand-in volumes: element i of an embedding is voxel (i div 16, (i div 4) mod 4, i mod 4)."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import affine as A
from cohortlake.functions import metadata as M
from cohortlake.functions import paths as P
from cohortlake.functions.formats import detect_format
from cohortlake.operators.volumes import geometry, intensity, masks, resample, slabs, stats, warp
from cohortlake.plans import augment, folder, preprocess, repeated, scoring
from cohortlake.sources import files as file_source
from cohortlake.sources import sinks
from cohortlake.session import fresh_path
from cohortlake.workloads.standins import table

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
    # adding 0.0 turns a rounded -0.0 into 0.0
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c).cast("double")) for c in cols})


# --- the stand-in volumes ---------------------------------------------------------------------

def volumes(spark, sf) -> DataFrame:
    """Slabs of all volumes; scans with scan_id % 7 = 3 have blank borders, % 50 = 49 are flat."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    px = F.expr(
        f"""transform(sequence(0, 15), p -> case when vec_id % 50 = 49 then 0.5D when vec_id % 7 = 3 and not ({KEEP}) then 0.0D
        else cast(element_at(embedding, cast(p div 4 as int) * 16 + p % 4 * 4 + z + 1) as double) end)"""
    )
    four = [F.lit(4).alias(n) for n in ("nx", "ny", "nz")]
    return rows.select(F.col("vec_id").alias("scan_id"), F.lit(0).alias("c"), "z", *four, px.alias("px"))


KEEP = "p div 4 >= vec_id % 2 and p div 4 <= 2 and p % 4 >= 1 and z <= 1 + vec_id % 3"
VOX = """vox AS (SELECT vec_id AS scan_id, (i//16)::INT AS x, ((i//4)%4)::INT AS y, (i%4)::INT AS z,
 CASE WHEN vec_id%50=49 THEN 0.5 WHEN vec_id%7=3 AND NOT (i//16>=vec_id%2 AND i//16<=2 AND (i//4)%4>=1 AND i%4<=1+vec_id%3) THEN 0.0 ELSE CAST(embedding[i+1] AS DOUBLE) END AS v FROM embeddings, unnest(range(64)) t(i))"""
V = "WITH " + VOX


def vox_out(s: DataFrame, name: str = "v") -> DataFrame:
    return slabs.voxels(s).select("scan_id", "x", "y", "z", r6("v").alias(name))


OUT = "SELECT scan_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, round(v,6)+0.0 AS v FROM o"

# signed axis-permutation affines: scan_id picks one of 48 orientations, spacing and origin
PERMS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def affines(spark, sf) -> DataFrame:
    k = F.col("vec_id")
    perm = F.array(*[F.array(*[F.lit(v) for v in p]) for p in PERMS])
    mine = F.get(perm, (k % 6).cast("int"))
    sign = [F.when((F.floor(k / 6) / 2**a).cast("int") % 2 == 1, -1.0).otherwise(1.0) for a in range(3)]
    rows = [
        [F.when(mine[a] == r, sign[a] * (1.0 + a * 0.5)).otherwise(0.0) for a in range(3)] + [(10.0 * (r + 1) + (k % 4)).cast("double")]
        for r in range(3)
    ]
    return table(spark, sf, "embeddings").select(k.alias("scan_id"), A.matrix(rows).alias("affine"))


# world axis w(a), sign s(a), size d(a) of voxel axis a, as SQL lists
AFF = """aff AS (SELECT vec_id AS scan_id, [[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]][vec_id%6+1] AS w,
 [CASE WHEN (vec_id//6)%2=1 THEN -1 ELSE 1 END, CASE WHEN (vec_id//12)%2=1 THEN -1 ELSE 1 END, CASE WHEN (vec_id//24)%2=1 THEN -1 ELSE 1 END] AS s, vec_id%4 AS o FROM embeddings)"""


# --- statistics -------------------------------------------------------------------------------

STATS = "st AS (SELECT scan_id, min(v) mn, max(v) mx, avg(v) mu, stddev_pop(v) sd FROM vox GROUP BY scan_id)"


@query("A01_volume_statistics", f"{V}, {STATS} SELECT scan_id, round(mn,6) AS min, round(mx,6) AS max, round(mu,6) AS mean, round(sd,6) AS std, '4x4x4' AS shape, 'float64' AS dtype FROM st")
def _(spark, sf):
    s = volumes(spark, sf)
    df = stats.volume_statistics(s).join(stats.shape_text(s), "scan_id")
    shape = F.array_join(F.col("shape").cast("array<string>"), "x")
    return rounded(df.withColumn("shape", shape), "min", "max", "mean", "std")


@query("A02_slice_statistics", f"{V} SELECT scan_id, z, round(avg(v),6) AS mean, round(min(v),6) AS min, round(max(v),6) AS max FROM vox GROUP BY scan_id, z")
def _(spark, sf):
    return rounded(stats.slice_statistics(volumes(spark, sf)).drop("c", "nz"), "mean", "min", "max")


@query("A03_range_and_snr", f"{V}, {STATS} SELECT scan_id, round(mx-mn,6) AS dynamic_range, round(CASE WHEN sd>0 THEN mu/sd ELSE 0 END,6)+0.0 AS snr FROM st")
def _(spark, sf):
    return rounded(stats.signal_range(stats.volume_statistics(volumes(spark, sf))), "dynamic_range", "snr")


CONTRAST = "ct AS (SELECT scan_id, quantile_cont(v,0.9) FILTER (v>0) a, quantile_cont(v,0.1) FILTER (v>0) b FROM vox GROUP BY scan_id)"


@query("A04_F05_tissue_contrast", f"{V}, {CONTRAST} SELECT scan_id, round(coalesce((a-b)/(a+b+1e-5),0),6) AS contrast FROM ct")
def _(spark, sf):
    return rounded(stats.tissue_contrast(volumes(spark, sf)), "contrast")


GREY = "mid AS (SELECT *, min(v) OVER (PARTITION BY scan_id) a, max(v) OVER (PARTITION BY scan_id) b FROM vox WHERE z=2), grey AS (SELECT scan_id, x, y, CASE WHEN a=b THEN 0 ELSE floor((v-a)/(b-a)*255) END::INT g FROM mid)"
BLUR = f"""{GREY}, off AS (SELECT * FROM (VALUES (-1,0,1),(1,0,1),(0,-1,1),(0,1,1),(0,0,-4)) t(dx,dy,k)),
lap AS (SELECT p.scan_id, p.x, p.y, sum(k*q.g)::DOUBLE l FROM grey p CROSS JOIN off JOIN grey q ON q.scan_id=p.scan_id AND q.x=(CASE p.x+dx WHEN -1 THEN 1 WHEN 4 THEN 2 ELSE p.x+dx END) AND q.y=(CASE p.y+dy WHEN -1 THEN 1 WHEN 4 THEN 2 ELSE p.y+dy END) GROUP BY ALL),
bl AS (SELECT scan_id, avg(l*l)-avg(l)*avg(l) AS blur FROM lap GROUP BY scan_id)"""


@query("A05_J11_blur_index", f"{V}, {BLUR} SELECT scan_id, round(blur,6) AS blur FROM bl")
def _(spark, sf):
    return rounded(stats.blur_index(volumes(spark, sf)), "blur")


def tall(spark, sf) -> DataFrame:
    """1 x 8 x 8 volumes read along z, with a jump in every fifth scan."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("scan_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("z"), "embedding"
    )
    lift = F.when((F.col("scan_id") % 5 == 0) & (F.col("z") == 4), 9.0).otherwise(0.0)
    px = F.transform(F.slice("embedding", F.col("z") * 8 + 1, 8), lambda v: v.cast("double") + lift)
    return rows.select("scan_id", F.lit(0).alias("c"), "z", F.lit(1).alias("nx"), F.lit(8).alias("ny"), F.lit(8).alias("nz"), px.alias("px"))


TALL = "WITH sl AS (SELECT vec_id AS scan_id, (i//8)::INT AS z, avg(CAST(embedding[i+1] AS DOUBLE)+CASE WHEN vec_id%5=0 AND i//8=4 THEN 9.0 ELSE 0.0 END) m FROM embeddings, unnest(range(64)) t(i) GROUP BY ALL), d AS (SELECT scan_id, z, abs(m-lag(m) OVER (PARTITION BY scan_id ORDER BY z)) AS diff FROM sl)"


@query("W08_slice_differences", TALL + " SELECT scan_id, z, round(diff,6) AS diff FROM d WHERE diff IS NOT NULL")
def _(spark, sf):
    return rounded(stats.slice_differences(tall(spark, sf)).drop("nz"), "diff")


@query("A06_slice_gaps", TALL + " SELECT scan_id, max(diff) > 8*median(diff) AS missing_slices FROM d GROUP BY scan_id")
def _(spark, sf):
    return stats.slice_gaps(tall(spark, sf))


@query("A07_P29_P30_quality_report", f"""{V}, {STATS}, {CONTRAST}, {BLUR}, q AS (SELECT scan_id, CASE WHEN sd>0 THEN mu/sd ELSE 0 END n, blur, coalesce((a-b)/(a+b+1e-5),0) c, mx-mn r FROM st JOIN bl USING (scan_id) JOIN ct USING (scan_id))
SELECT scan_id, round(n,6)+0.0 AS noise_score, round(blur,6) AS blur_score, 0.15 AS motion_score, round(c,6) AS contrast_score, round(r,6) AS dynamic_range, round(1/3.0::DOUBLE,6) AS resolution, 4 AS slice_count, false AS missing_slices, false AS has_artifacts,
round(least(greatest(least(n/20,1)*0.3+least(blur/500,1)*0.3+0.85*0.2+least(greatest(c,0),1)*0.2,0),1),6) AS overall_score FROM q""".replace("0.15 AS", "0.15::DOUBLE AS"))
def _(spark, sf):
    spacing = affines(spark, sf).select("scan_id", M.voxel_spacing(F.col("affine"), F.lit("nifti")).alias("spacing"))
    rep = stats.quality_report(volumes(spark, sf), spacing)
    return rounded(rep, "noise_score", "blur_score", "contrast_score", "dynamic_range", "resolution", "overall_score")


@query("A47_foreground_box", f"{V} SELECT scan_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM vox WHERE v<>0 GROUP BY scan_id")
def _(spark, sf):
    return stats.foreground_box(volumes(spark, sf))


OTSU = """rg AS (SELECT scan_id, min(v) lo, max(v) hi FROM vox GROUP BY scan_id), hb AS (SELECT vox.scan_id, lo, hi, CASE WHEN hi>lo THEN least(floor((v-lo)/((hi-lo)/128)),127) ELSE 0 END::BIGINT AS bin, count(*) n FROM vox JOIN rg USING (scan_id) GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER u n0, sum(n) OVER p nn, sum(n*(lo+(bin+0.5)*((hi-lo)/128))) OVER u m0, sum(n*(lo+(bin+0.5)*((hi-lo)/128))) OVER p m FROM hb WINDOW u AS (PARTITION BY scan_id ORDER BY bin), p AS (PARTITION BY scan_id)),
bt AS (SELECT *, coalesce(CASE WHEN nn>n0 THEN round(n0*(nn-n0)*pow(m0/n0-(m-m0)/(nn-n0),2)/(nn*nn::DOUBLE),12) END,0) bw FROM cm),
ot AS (SELECT scan_id, bin, lo+(bin+1)*((hi-lo)/128) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY bw DESC, bin) rn FROM bt) WHERE rn=1)"""


@query("A48_otsu_threshold", f"{V}, {OTSU} SELECT scan_id, bin, round(threshold,6)+0.0 AS threshold FROM ot")
def _(spark, sf):
    return rounded(stats.otsu_threshold(volumes(spark, sf)), "threshold")


# --- quality, validity ------------------------------------------------------------------------

@query("C02_volume_checks", f"""{V}, sl AS (SELECT scan_id, z, min(v) a, max(v) b FROM vox GROUP BY scan_id, z), e AS (SELECT scan_id, bool_or(a=b) e, max(b)>min(a) i FROM sl GROUP BY scan_id)
SELECT scan_id, scan_id%10<>1 AS voxel_spacing_valid, scan_id%10<>2 AS dimensions_valid, i AS intensity_valid, scan_id%10<>3 AS orientation_valid, scan_id%10<>4 AS metadata_complete, e AS empty_slices_detected FROM e""")
def _(spark, sf):
    return stats.volume_checks(volumes(spark, sf), _info(spark, sf))


def _info(spark, sf):
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        k.alias("scan_id"), F.array(F.lit(1.0), F.when(k % 10 == 1, 0.0).otherwise(2.0), F.lit(1.0)).alias("spacing"),
        F.when(k % 10 == 2, 4).otherwise(3).alias("n_dims"), F.when(k % 10 != 4, F.concat(F.lit("P"), k.cast("string"))).alias("patient_id"),
        F.when(k % 10 != 3, "RAS").alias("orientation"),
    )


@query("C03_errors_and_verdict", f"""{V}, sl AS (SELECT scan_id, z, min(v) a, max(v) b FROM vox GROUP BY scan_id, z), e AS (SELECT scan_id, bool_or(a=b) e, max(b)>min(a) i FROM sl GROUP BY scan_id),
m AS (SELECT scan_id, concat_ws('|', CASE WHEN scan_id%10=1 THEN 'Invalid or negative voxel spacing dimensions detected.' END, CASE WHEN scan_id%10=2 THEN 'MRI shape dimensions do not meet requirements.' END, CASE WHEN NOT i THEN 'Constant or flat voxel intensities detected.' END, CASE WHEN e THEN 'Blank zero-intensity slice volumes detected inside scan.' END) AS errors FROM e)
SELECT scan_id, CASE WHEN scan_id%20=5 THEN 'File does not exist on disk.' || CASE WHEN errors<>'' THEN '|' || errors ELSE '' END ELSE errors END AS errors, errors='' AND scan_id%20<>5 AS is_valid FROM m""")
def _(spark, sf):
    checks = stats.volume_checks(volumes(spark, sf), _info(spark, sf))
    checks = checks.withColumn("exists", F.col("scan_id") % 20 != 5).withColumn("readable", F.lit(True))
    return stats.verdict(checks).select("scan_id", F.array_join("errors", "|").alias("errors"), "is_valid")


@query("C07_wrong_shapes", "SELECT vec_id AS scan_id, CASE WHEN vec_id%9=0 THEN 3 ELSE 4 END::BIGINT AS slices FROM embeddings WHERE vec_id%9=0 OR vec_id%11=0")
def _(spark, sf):
    s = volumes(spark, sf).where("NOT (scan_id % 9 = 0 AND z = 3)")
    bad = F.when(F.col("scan_id") % 11 == 0, F.slice("px", 1, 15)).otherwise(F.col("px"))
    return preprocess.wrong_shapes(s.withColumn("px", bad), (1, 4, 4, 4))


# --- array and preview operators --------------------------------------------------------------

@query("R01_grey_scale", f"{V}, m AS (SELECT *, min(v) OVER w a, max(v) OVER w b FROM vox WINDOW w AS (PARTITION BY scan_id, z)) SELECT scan_id, x, y, z, CASE WHEN a=b THEN 0 ELSE floor((v-a)/(b-a)*255) END::INT AS grey FROM m")
def _(spark, sf):
    s = volumes(spark, sf).withColumn("px", stats.to_grey(F.col("px")))
    return slabs.voxels(s).select("scan_id", "x", "y", "z", F.col("v").alias("grey"))


@query("R02_standardised_layout", f"{V} SELECT scan_id, 0 AS c, x, y, z, round(v::FLOAT::DOUBLE,6)+0.0 AS v FROM vox")
def _(spark, sf):
    s = slabs.standardised(volumes(spark, sf).drop("c"))
    return slabs.voxels(s).select("scan_id", "c", "x", "y", "z", r6(F.col("v").cast("double")).alias("v"))


@query("R03_header_map", "SELECT o_orderkey AS scan_id, o_orderstatus AS status, CASE WHEN o_orderkey%3<>0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey%3<>0 THEN 2 ELSE 1 END AS n FROM orders")
def _(spark, sf):
    raw = F.create_map(
        F.lit("status"), F.concat(F.lit("  "), "o_orderstatus"), F.lit("priority"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")),
        F.lit("blank"), F.lit("  "),
    )
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), file_source.normal_header(raw).alias("h"))
    return df.select(
        "scan_id", F.try_element_at("h", F.lit("status")).alias("status"), F.try_element_at("h", F.lit("priority")).alias("priority"), F.size("h").alias("n")
    )


@query("V11_preview_planes", f"""{V}, p AS (SELECT scan_id, 'axial' AS plane, x r, y c, v FROM vox WHERE z=2 UNION ALL SELECT scan_id, 'coronal', x, z, v FROM vox WHERE y=2 UNION ALL SELECT scan_id, 'sagittal', y, z, v FROM vox WHERE x=2),
m AS (SELECT *, min(v) OVER w a, max(v) OVER w b FROM p WINDOW w AS (PARTITION BY scan_id, plane)) SELECT scan_id, plane, 2 AS slice_idx, (r*4+c)::INT AS pos, CASE WHEN a=b THEN 0 ELSE floor((v-a)/(b-a)*255) END::INT AS grey FROM m""")
def _(spark, sf):
    p = geometry.previews(volumes(spark, sf))
    return p.select("scan_id", "plane", "slice_idx", F.posexplode("image").alias("pos", "grey"))


@query("V11_axis_slice", f"{V}, o AS (SELECT * FROM vox WHERE y=1) {OUT}")
def _(spark, sf):
    p = geometry.plane(volumes(spark, sf), 1, F.lit(1))
    return p.select("scan_id", "x", "y", "z", r6("v").alias("v"))


# --- geometry ---------------------------------------------------------------------------------

def _re(t):
    """SQL for output coordinate t of a volume reoriented to RAS."""
    return f"CASE WHEN s[list_position(w,{t})]=-1 THEN 3-[x,y,z][list_position(w,{t})] ELSE [x,y,z][list_position(w,{t})] END"


@query("V01_reorient", f"{V}, {AFF}, o AS (SELECT scan_id, {_re(0)} AS x, {_re(1)} AS y, {_re(2)} AS z, v FROM vox JOIN aff USING (scan_id)) {OUT}")
def _(spark, sf):
    out, _, _ = geometry.reorient(volumes(spark, sf), affines(spark, sf))
    return vox_out(out)


@query("V01_reorient_affine", f"WITH {AFF} SELECT scan_id, " + ", ".join(
    f"round(0.5+0.5*list_position(w,{t}),6)::DOUBLE AS d{t}, round(10.0*({t}+1)+o+CASE WHEN s[list_position(w,{t})]=-1 THEN -3*(0.5+0.5*list_position(w,{t})) ELSE 0 END,6)::DOUBLE AS o{t}" for t in range(3)) + " FROM aff")
def _(spark, sf):
    _, moved, _ = geometry.reorient(volumes(spark, sf), affines(spark, sf))
    a = F.col("affine")
    return moved.select("scan_id", *[r6(A.cell(a, t, t)).alias(f"d{t}") for t in range(3)], *[r6(A.cell(a, t, 3)).alias(f"o{t}") for t in range(3)])


@query("V02_J07_zscore", f"{V}, {STATS}, o AS (SELECT scan_id, x, y, z, (v-mu)/(sd+1e-8) AS v FROM vox JOIN st USING (scan_id)) {OUT}")
def _(spark, sf):
    return vox_out(intensity.normalise(volumes(spark, sf), "z_score"))


@query("V02_min_max", f"{V}, {STATS}, o AS (SELECT scan_id, x, y, z, (v-mn)/(mx-mn+1e-8) AS v FROM vox JOIN st USING (scan_id)) {OUT}")
def _(spark, sf):
    return vox_out(intensity.normalise(volumes(spark, sf), "min_max"))


BOX = "bx AS (SELECT scan_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM vox WHERE v<>0 GROUP BY scan_id)"


@query("V03_crop_foreground", f"{V}, {BOX}, o AS (SELECT scan_id, x-x0 AS x, y-y0 AS y, z-z0 AS z, v FROM vox JOIN bx USING (scan_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1) {OUT}")
def _(spark, sf):
    out, _, _ = geometry.crop_foreground(volumes(spark, sf), affines(spark, sf))
    return vox_out(out)


@query("V03_crop_affine", f"{V}, {BOX}, {AFF} SELECT scan_id, " + ", ".join(
    f"round(10.0*({r}+1)+o+s[list_position(w,{r})]*(0.5+0.5*list_position(w,{r}))*[x0,y0,z0][list_position(w,{r})],6)::DOUBLE AS o{r}" for r in range(3)) + " FROM aff JOIN bx USING (scan_id)")
def _(spark, sf):
    _, moved, _ = geometry.crop_foreground(volumes(spark, sf), affines(spark, sf))
    return moved.select("scan_id", *[r6(A.cell(F.col("affine"), t, 3)).alias(f"o{t}") for t in range(3)])


@query("V04_pad", f"{V}, g AS (SELECT vec_id AS scan_id, (i//35)::INT x, ((i//7)%5)::INT y, (i%7)::INT z FROM embeddings, unnest(range(6*5*7)) t(i)), o AS (SELECT g.scan_id, g.x, g.y, g.z, coalesce(v,-1.0) v FROM g LEFT JOIN vox ON vox.scan_id=g.scan_id AND vox.x=g.x-1 AND vox.y=g.y AND vox.z=g.z-1) {OUT}")
def _(spark, sf):
    out, _, _ = geometry.pad(volumes(spark, sf), affines(spark, sf), (6, 5, 7), -1.0)
    return vox_out(out)


@query("V05_center_crop", f"{V}, o AS (SELECT scan_id, x-1 AS x, y AS y, z-0 AS z, v FROM vox WHERE x BETWEEN 1 AND 2 AND z<=2) {OUT}")
def _(spark, sf):
    out, _, _ = geometry.center_crop(volumes(spark, sf), affines(spark, sf), (2, 8, 3))
    return vox_out(out)


def _lin(axis, ratio, n, size):
    """SQL lists of (target, source, weight) rows of one axis."""
    rows = []
    for i in range(size):
        p = i * ratio
        if p >= n - 0.5:
            continue
        lo = math.floor(p)
        for s, w in ((lo, 1 - (p - lo)), (min(lo + 1, n - 1), p - lo)):
            if w > 0:
                rows.append(f"({i},{s},{w!r}::DOUBLE)")
    return f"w{axis} AS (SELECT * FROM (VALUES {','.join(rows)}) t(i,s,w))"


def _grid_sql(sizes, ratios):
    """Oracle voxels of a regridded volume: weights per axis, zero where nothing is read."""
    parts = ", ".join(_lin(a, r, 4, n) for a, n, r in zip("xyz", sizes, ratios))
    nx, ny, nz = sizes
    return f"""{parts}, g AS (SELECT vec_id AS scan_id, (i//{ny * nz})::INT x, ((i//{nz})%{ny})::INT y, (i%{nz})::INT z FROM embeddings, unnest(range({nx * ny * nz})) t(i)),
iv AS (SELECT scan_id, wx.i x, wy.i y, wz.i z, sum(wx.w*wy.w*wz.w*v) v FROM vox JOIN wx ON wx.s=vox.x JOIN wy ON wy.s=vox.y JOIN wz ON wz.s=vox.z GROUP BY ALL),
o AS (SELECT g.scan_id, g.x, g.y, g.z, coalesce(iv.v,0.0) v FROM g LEFT JOIN iv ON iv.scan_id=g.scan_id AND iv.x=g.x AND iv.y=g.y AND iv.z=g.z)"""


# spacing of every stand-in scan is (1.0, 1.5, 2.0)
RS = (0.75, 1.5, 1.25)
RS_SIZE = [round(4 * s / t) for s, t in zip((1.0, 1.5, 2.0), RS)]


@query("V06_resample", f"{V}, {_grid_sql(RS_SIZE, [t / s for s, t in zip((1.0, 1.5, 2.0), RS)])} {OUT}")
def _(spark, sf):
    out, _, _ = resample.resample(volumes(spark, sf), affines(spark, sf), RS)
    return vox_out(out)


@query("V07_resize_linear", f"{V}, {_grid_sql((6, 3, 5), (4 / 6, 4 / 3, 4 / 5))} {OUT}")
def _(spark, sf):
    out, _, _ = resample.resize(volumes(spark, sf), affines(spark, sf), (6, 3, 5))
    return vox_out(out)


@query("V07_resize_nearest", f"{V}, n6 AS (SELECT i, least(floor(i*(4/6.0::DOUBLE)+0.5),3)::INT s, i*(4/6.0::DOUBLE)<3.5 ok FROM unnest(range(6)) t(i)), n3 AS (SELECT i, floor(i*(4/3.0::DOUBLE)+0.5)::INT s FROM unnest(range(3)) t(i)), o AS (SELECT scan_id, n6.i x, n3.i y, vox.z, CASE WHEN ok THEN v ELSE 0.0 END v FROM vox JOIN n6 ON n6.s=vox.x JOIN n3 ON n3.s=vox.y) {OUT}")
def _(spark, sf):
    out, _, _ = resample.resize(volumes(spark, sf), affines(spark, sf), (6, 3, 4), "nearest")
    return vox_out(out)


# --- masks ------------------------------------------------------------------------------------

def positive(spark, sf):
    s = volumes(spark, sf)
    return s.withColumn("px", F.transform("px", lambda v: F.when(v > 0.05, 1.0).otherwise(0.0)))


def _ball_sql(r):
    return f"b{r} AS (SELECT dx, dy, dz FROM unnest(range(-{r},{r + 1})) a(dx), unnest(range(-{r},{r + 1})) b(dy), unnest(range(-{r},{r + 1})) c(dz) WHERE dx*dx+dy*dy+dz*dz<=({r}+0.5)*({r}+0.5))"


def _dilate_sql(src, out, r, lo=0, hi=3):
    return f"{out} AS (SELECT DISTINCT scan_id, x+dx AS x, y+dy AS y, z+dz AS z FROM {src}, b{r} WHERE x+dx BETWEEN {lo} AND {hi} AND y+dy BETWEEN {lo} AND {hi} AND z+dz BETWEEN {lo} AND {hi})"


def _grid(name, lo=0, hi=3):
    return f"{name} AS (SELECT vec_id AS scan_id, x, y, z FROM embeddings, unnest(range({lo},{hi + 1})) a(x), unnest(range({lo},{hi + 1})) b(y), unnest(range({lo},{hi + 1})) c(z))"


def _erode_sql(src, out, r, grid, lo=0, hi=3):
    return f"{out}_bg AS (SELECT * FROM {grid} EXCEPT SELECT scan_id, x, y, z FROM {src}), {_dilate_sql(out + '_bg', out + '_no', r, lo, hi)}, {out} AS (SELECT * FROM {grid} EXCEPT SELECT * FROM {out}_no)"


SET = "p AS (SELECT scan_id, x, y, z FROM vox WHERE v>0.05)"
MASK_OUT = "SELECT g.scan_id, CAST(g.x AS INT) AS x, CAST(g.y AS INT) AS y, CAST(g.z AS INT) AS z, CASE WHEN m.scan_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM g LEFT JOIN {m} m ON m.scan_id=g.scan_id AND m.x=g.x AND m.y=g.y AND m.z=g.z"


@query("V09_dilate", f"{V}, {SET}, {_ball_sql(1)}, {_grid('g')}, {_dilate_sql('p', 'd', 1)} " + MASK_OUT.format(m="d"))
def _(spark, sf):
    return vox_out(masks.dilate(positive(spark, sf), 1))


@query("V09_erode", f"{V}, {SET}, {_ball_sql(1)}, {_grid('g')}, {_erode_sql('p', 'e', 1, 'g')} " + MASK_OUT.format(m="e"))
def _(spark, sf):
    return vox_out(masks.erode(positive(spark, sf), 1))


@query("V09_open", f"{V}, {SET}, {_ball_sql(1)}, {_grid('g')}, {_erode_sql('p', 'e', 1, 'g')}, {_dilate_sql('e', 'd', 1)} " + MASK_OUT.format(m="d"))
def _(spark, sf):
    return vox_out(masks.opening(positive(spark, sf), 1))


@query("V09_close", f"{V}, {SET}, {_ball_sql(1)}, {_grid('g')}, {_grid('gw', -1, 4)}, {_dilate_sql('p', 'd', 1, -1, 4)}, {_erode_sql('d', 'e', 1, 'gw', -1, 4)} " + MASK_OUT.format(m="e"))
def _(spark, sf):
    return vox_out(masks.closing(positive(spark, sf), 1))


@query("V08_head_mask", f"{V}, {OTSU}, p AS (SELECT scan_id, x, y, z FROM vox JOIN ot USING (scan_id) WHERE v>threshold), {_ball_sql(1)}, {_ball_sql(3)}, {_grid('g')}, {_grid('gw', -3, 6)}, {_dilate_sql('p', 'd', 3, -3, 6)}, {_erode_sql('d', 'e', 3, 'gw', -3, 6)}, inn AS (SELECT e.* FROM e JOIN g USING (scan_id,x,y,z)), {_erode_sql('inn', 'f', 1, 'g')}, {_dilate_sql('f', 'h', 1)} " + MASK_OUT.format(m="h"))
def _(spark, sf):
    return vox_out(masks.head_mask(volumes(spark, sf)))


@query("V10_J08_apply_mask", f"{V}, o AS (SELECT scan_id, x, y, z, CASE WHEN v>0.05 THEN v ELSE 0.0 END v FROM vox) {OUT}")
def _(spark, sf):
    return vox_out(masks.apply_mask(volumes(spark, sf), positive(spark, sf)))


@query("A41_J09_dice", f"""{V}, p AS (SELECT scan_id//2 AS pair, scan_id%2 AS side, x, y, z FROM vox WHERE v>CASE WHEN scan_id%20<2 THEN 9 ELSE 0.05 END), n AS (SELECT pair, count(*) FILTER (side=0) a, count(*) FILTER (side=1) b FROM p GROUP BY pair),
i AS (SELECT pair, count(*) c FROM (SELECT pair, x, y, z FROM p GROUP BY ALL HAVING count(*)=2) GROUP BY pair) SELECT q.pair, round(CASE WHEN coalesce(a+b,0)=0 THEN 1.0 ELSE 2*coalesce(c,0)/(a+b)::DOUBLE END,6) AS dice FROM (SELECT DISTINCT vec_id//2 AS pair FROM embeddings) q LEFT JOIN n USING (pair) LEFT JOIN i USING (pair)""")
def _(spark, sf):
    limit = F.when(F.col("scan_id") % 20 < 2, 9.0).otherwise(0.05)
    m = volumes(spark, sf).withColumn("px", F.transform("px", lambda v: F.when(v > limit, 1.0).otherwise(0.0)))
    side = lambda k: m.where(F.col("scan_id") % 2 == k).withColumn("scan_id", F.floor(F.col("scan_id") / 2))
    return rounded(masks.dice(side(0), side(1)), "dice").withColumnRenamed("scan_id", "pair")


@query("J13_channel_stack", f"{V} SELECT scan_id//4 AS subject, x, y, z, " + ", ".join(f"round(max(v) FILTER (scan_id%4={c}),6)+0.0 AS {m}" for c, m in enumerate(("t1", "t1ce", "t2", "flair"))) + " FROM vox GROUP BY subject, x, y, z HAVING count(*)=4")
def _(spark, sf):
    names = F.array(*[F.lit(m) for m in P.MODALITIES])
    rows = volumes(spark, sf).select(
        F.floor(F.col("scan_id") / 4).alias("scan_id"), F.get(names, (F.col("scan_id") % 4).cast("int")).alias("modality"), "z", "nx", "ny", "nz", "px"
    )
    # whole slices side by side, then voxel by voxel without a shuffle
    side = slabs.stacked_channels(rows, P.MODALITIES).groupBy("scan_id", "z", "ny").agg(
        *[F.first(F.when(F.col("c") == c, F.col("px")), ignorenulls=True).alias(m) for c, m in enumerate(P.MODALITIES)]
    )
    vox = side.select("scan_id", "z", "ny", F.posexplode(F.arrays_zip(*P.MODALITIES)).alias("i", "v"))
    return vox.select(
        F.col("scan_id").alias("subject"), F.floor(F.col("i") / F.col("ny")).cast("int").alias("x"),
        (F.col("i") % F.col("ny")).cast("int").alias("y"), "z", *[r6(F.col(f"v.{m}")).alias(m) for m in P.MODALITIES],
    )


# --- augmentation transforms ------------------------------------------------------------------

@query("V13_flip", f"{V}, o AS (SELECT scan_id, 3-x AS x, y, z, v FROM vox) {OUT}")
def _(spark, sf):
    return vox_out(geometry.flip(volumes(spark, sf), 0))


@query("V14_translate", f"{V}, o AS (SELECT a.scan_id, a.x, a.y, a.z, coalesce(b.v,0.0) v FROM vox a LEFT JOIN vox b ON b.scan_id=a.scan_id AND b.x=a.x-1 AND b.y=a.y+2 AND b.z=a.z-1) {OUT}")
def _(spark, sf):
    return vox_out(geometry.translate(volumes(spark, sf), 1, -2, 1))


def _u(key, part):
    return f"((('0x' || substr(md5({key}),{1 + 8 * part},8))::BIGINT)+0.5)/4294967296.0::DOUBLE"


_VKEY = "'7:' || scan_id || ':0:' || z || ':' || (x*4+y)"


@query("V15_gaussian_noise", f"{V}, o AS (SELECT scan_id, x, y, z, v + 0.1*sqrt(-2*ln({_u(_VKEY, 0)}))*cos(2*pi()*({_u(_VKEY, 1)})) AS v FROM vox) {OUT}")
def _(spark, sf):
    return vox_out(intensity.gaussian_noise(volumes(spark, sf), 0.1, seed=7))


@query("V16_scale_shift", f"{V}, o AS (SELECT scan_id, x, y, z, (v*1.25-0.5)*1.1 AS v FROM vox) {OUT}")
def _(spark, sf):
    return vox_out(intensity.scale_by_factor(intensity.scale_shift(volumes(spark, sf), 1.25, -0.5), 0.1))


@query("V17_gamma_contrast", f"{V}, {STATS}, o AS (SELECT scan_id, x, y, z, pow((v-mn)/(mx-mn+1e-7),1.15)*(mx-mn)+mn AS v FROM vox JOIN st USING (scan_id)) {OUT}")
def _(spark, sf):
    return vox_out(intensity.adjust_contrast(volumes(spark, sf), 1.15))


@query("V18_percentile_scale", f"{V}, pc AS (SELECT scan_id, quantile_cont(v,0.01) a, quantile_cont(v,0.99) b FROM vox GROUP BY scan_id), o AS (SELECT scan_id, x, y, z, CASE WHEN a=b THEN v-a ELSE (v-a)/(b-a)*1.05 END AS v FROM vox JOIN pc USING (scan_id)) {OUT}")
def _(spark, sf):
    return vox_out(intensity.percentile_scale(volumes(spark, sf)))


@query("V19_rotate90", f"{V}, o AS (SELECT scan_id, x, 3-z AS y, y AS z, v FROM vox) {OUT}")
def _(spark, sf):
    return vox_out(geometry.rotate90(volumes(spark, sf), 1))


def _warp_sql(rot, t, s):
    """Trilinear sampling at R(S q + t) + 1.5 with zeros outside."""
    m = warp.rotation(*rot)
    q = [f"(({a}-1.5)*{s[k]!r}+{t[k]!r})" for k, a in enumerate(("g.x", "g.y", "g.z"))]
    src = ["(" + "+".join(f"{float(m[r, k])!r}*{q[k]}" for k in range(3)) + "+1.5)" for r in range(3)]
    return f"""g AS (SELECT DISTINCT x, y, z FROM vox), src AS (SELECT g.*, {src[0]}::DOUBLE sx, {src[1]}::DOUBLE sy, {src[2]}::DOUBLE sz FROM g), cn AS (SELECT * FROM unnest([0,1]) a(cx), unnest([0,1]) b(cy), unnest([0,1]) c(cz)),
wt AS (SELECT src.x, src.y, src.z, floor(sx)+cx AS ix, floor(sy)+cy AS iy, floor(sz)+cz AS iz, (1-abs(sx-floor(sx)-cx))*(1-abs(sy-floor(sy)-cy))*(1-abs(sz-floor(sz)-cz)) w FROM src, cn),
hit AS (SELECT scan_id, wt.x, wt.y, wt.z, sum(w*v) v FROM wt JOIN vox ON vox.x=ix AND vox.y=iy AND vox.z=iz GROUP BY ALL),
o AS (SELECT vox.scan_id, vox.x, vox.y, vox.z, coalesce(hit.v,0.0) v FROM vox LEFT JOIN hit ON hit.scan_id=vox.scan_id AND hit.x=vox.x AND hit.y=vox.y AND hit.z=vox.z)"""


ROT = (0.13, -0.09, 0.11)


@query("V20_affine_warp", f"{V}, {_warp_sql(ROT, (0.7, -0.4, 0.3), (1.05, 0.95, 1.02))} {OUT}")
def _(spark, sf):
    names = dict(zip(warp.WARP, [*ROT, 0.7, -0.4, 0.3, 1.05, 0.95, 1.02]))
    return vox_out(warp.fixed_warp(volumes(spark, sf), **names))


@query("V21_zoom", f"{V}, {_warp_sql((0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1 / 1.1,) * 3)} {OUT}")
def _(spark, sf):
    return vox_out(warp.zoom(volumes(spark, sf), 1.1))


_G = warp.gaussian_weights(0.8)
_GW = f"k AS (SELECT unnest(range(-{len(_G) // 2},{len(_G) // 2 + 1})) d, unnest([{','.join(f'{w!r}::DOUBLE' for w in _G)}]) w)"


@query("V22_gaussian_smooth", f"{V}, {_GW}, a1 AS (SELECT scan_id, x+d AS x, y, z, sum(w*v) v FROM vox, k WHERE x+d BETWEEN 0 AND 3 GROUP BY ALL), a2 AS (SELECT scan_id, x, y+d AS y, z, sum(w*v) v FROM a1, k WHERE y+d BETWEEN 0 AND 3 GROUP BY ALL), o AS (SELECT scan_id, x, y, z+d AS z, sum(w*v) v FROM a2, k WHERE z+d BETWEEN 0 AND 3 GROUP BY ALL) {OUT}")
def _(spark, sf):
    return vox_out(warp.gaussian_smooth(volumes(spark, sf), 0.8))


# --- plans ------------------------------------------------------------------------------------

def scans(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("scan_id"))


def _plan_sql(profile):
    rows = []
    for no, (name, p, ranges) in enumerate(augment.PROFILES[profile]):
        key = f"'42:' || scan_id || ':' || r || ':{no}"
        fires = f"{_u(key + chr(39), 0)} < {p}"
        values = " UNION ALL ".join(
            f"SELECT scan_id, r, {no} AS step_no, '{name}' AS transform, '{n}' AS param, {lo!r}::DOUBLE + {_u(key + ':' + n + chr(39), 0)}*{hi - lo!r}::DOUBLE AS value FROM sr WHERE {fires}"
            for n, (lo, hi) in ranges.items()
        ) or f"SELECT scan_id, r, {no} AS step_no, '{name}' AS transform, CAST(NULL AS VARCHAR) AS param, CAST(NULL AS DOUBLE) AS value FROM sr WHERE {fires}"
        rows.append(values)
    return "WITH sr AS (SELECT vec_id AS scan_id, r FROM embeddings, unnest(range(2)) t(r)), pl AS (" + " UNION ALL ".join(rows) + ") SELECT scan_id, CAST(r AS INT) AS replicate, CAST(step_no AS INT) AS step_no, transform, param, round(value,6) AS value FROM pl"


def _flat_plan(plan):
    return plan.select("scan_id", "replicate", "step_no", "transform", F.explode_outer("params").alias("param", "value")).withColumn("value", F.round("value", 6))


@query("V23_augmentation_plan", _plan_sql("strong"))
def _(spark, sf):
    return _flat_plan(augment.augmentation_plan(scans(spark, sf), "strong", 2))


@query("V23_research_plan", _plan_sql("research"))
def _(spark, sf):
    return _flat_plan(augment.augmentation_plan(scans(spark, sf), "research", 2))


def _tta_sql():
    rows = [
        "SELECT 1 AS run, 0 AS step_no, 'flip' AS transform, NULL AS param, NULL AS value",
        f"SELECT 2, 0, 'affine', 'rx', {5 * math.pi / 180!r}", "SELECT 2, 0, 'affine', 'tx', 1.0",
        *[f"SELECT 3, 0, 'scale_percentiles', '{n}', {v}" for n, v in (("lower", 0.01), ("upper", 0.99), ("low", 0.0), ("high", 1.05))],
        "SELECT 4, 0, 'contrast', 'gamma', 1.15",
    ]
    for run in (5, 6, 7):
        k = f"'{42 + run}:"
        rows.append(f"SELECT {run}, 0, 'flip', NULL, NULL WHERE {_u(k + 'flip' + chr(39), 0)} > 0.5")
        for n, lo, span in [*[(r, -0.05, 0.1) for r in ("rx", "ry", "rz")], *[(t, -0.5, 1.0) for t in ("tx", "ty", "tz")]]:
            rows.append(f"SELECT {run}, 1, 'affine', '{n}', {lo} + {_u(k + n + chr(39), 0)}*{span}")
        rows.append(f"SELECT {run}, 2, 'contrast', 'gamma', 0.85 + {_u(k + 'gamma' + chr(39), 0)}*0.3")
    return "WITH pl AS (" + " UNION ALL ".join(rows) + ") SELECT vec_id AS scan_id, CAST(run AS INT) AS run, CAST(step_no AS INT) AS step_no, transform, CAST(param AS VARCHAR) AS param, round(CAST(value AS DOUBLE),6) AS value FROM embeddings CROSS JOIN pl"


@query("V24_repeated_prediction_plan", _tta_sql())
def _(spark, sf):
    plan = augment.tta_plan(scans(spark, sf), 8)
    return plan.select("scan_id", "run", "step_no", "transform", F.explode_outer("params").alias("param", "value")).withColumn("value", F.round("value", 6))


@query("V24_apply_run", f"{V}, {_warp_sql((5 * math.pi / 180, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 1.0))} {OUT}")
def _(spark, sf):
    plan = augment.tta_plan(scans(spark, sf), 3).where("run = 2")
    return vox_out(augment.apply_plan(volumes(spark, sf), plan, ["flip", "affine"]))


def _unit(key):
    """The number that a draw gives for a key."""
    return (int(hashlib.md5(key.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def _run_sql(run):
    """Voxels r<run> of one of eight runs: flipped, warped, then levelled or curved."""
    u = lambda name, lo, hi: lo + _unit(f"{42 + run}:{name}") * (hi - lo)
    flip = run == 1 or run > 4 and _unit(f"{42 + run}:flip") > 0.5
    rot, shift, gamma = {2: ((5 * math.pi / 180, 0.0, 0.0), (1.0, 0.0, 0.0), None), 4: (None, None, 1.15)}.get(run, (None, None, None))
    if run > 4:
        rot, shift = tuple(u(n, -0.05, 0.05) for n in ("rx", "ry", "rz")), tuple(u(n, -0.5, 0.5) for n in ("tx", "ty", "tz"))
        gamma = u("gamma", 0.85, 1.15)
    ctes = [f"f{run} AS MATERIALIZED (SELECT scan_id, {'3-x' if flip else 'x'} AS x, y, z, v FROM vox)"]
    if rot:
        warped = _warp_sql(rot, shift, (1.0, 1.0, 1.0))
        for name in ("vox", "src", "hit", "wt", "cn", "g", "o"):
            warped = re.sub(rf"\b{name}\b", f"f{run}" if name == "vox" else f"{name}{run}", warped)
        ctes.append(warped)
    at = f"o{run}" if rot else f"f{run}"
    if gamma:
        ctes.append(f"c{run} AS (SELECT scan_id, x, y, z, pow((v-a)/(b-a+1e-7),{gamma!r})*(b-a)+a AS v FROM {at} JOIN (SELECT scan_id, min(v) a, max(v) b FROM {at} GROUP BY scan_id) USING (scan_id))")
    elif run == 3:
        ctes.append(f"c3 AS (SELECT scan_id, x, y, z, CASE WHEN a=b THEN v-a ELSE (v-a)/(b-a)*1.05 END AS v FROM {at} JOIN (SELECT scan_id, quantile_cont(v,0.01) a, quantile_cont(v,0.99) b FROM {at} GROUP BY scan_id) USING (scan_id))")
    else:
        ctes.append(f"c{run} AS (SELECT * FROM {at})")
    return ", ".join(ctes)


RUNS_SQL = ", ".join(_run_sql(r) for r in range(8)) + ", r AS (" + " UNION ALL ".join(f"SELECT {r} AS run, * FROM c{r}" for r in range(8)) + ")"


@query("V24_repeated_runs", f"{V}, {RUNS_SQL} SELECT scan_id, run, z, round(sum(v),5)+0.0 AS total, round(sum(v*(x*4+y)),4)+0.0 AS place FROM r GROUP BY ALL")
def _(spark, sf):
    out = repeated.repeated_runs(volumes(spark, sf), 8)
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    place = F.aggregate(F.transform("px", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return out.select("scan_id", "run", "z", (F.round(total, 5) + 0.0).alias("total"), (F.round(place, 4) + 0.0).alias("place"))


@query("V24_A39_repeated_prediction", f"{V}, {RUNS_SQL}, l AS (SELECT scan_id, run, avg(v) FILTER (x<2)*10 a, avg(v) FILTER (x>=2)*10 b FROM r GROUP BY ALL), m AS (SELECT scan_id, avg(a) a, avg(b) b, count(*) AS runs FROM l GROUP BY scan_id) SELECT scan_id, runs, round(1/(1+exp(a-b)),5) AS prob FROM m")
def _(spark, sf):
    """Two logits per scan and run, the means of the halves of the volume times ten; averaged over the runs of a scan."""
    out = repeated.repeated_runs(volumes(spark, sf), 8)
    half = lambda low: F.aggregate(F.slice("px", 1 if low else 9, 8), F.lit(0.0), lambda a, v: a + v)
    logits = out.groupBy("scan_id", "run").agg(*[(F.sum(half(k == 0)) / 32 * 10).alias(f"l{k}") for k in (0, 1)])
    mean = logits.groupBy("scan_id").agg(F.avg("l0").alias("a"), F.avg("l1").alias("b"), F.count("*").alias("runs"))
    return mean.select("scan_id", "runs", F.round(1 / (1 + F.exp(F.col("a") - F.col("b"))), 5).alias("prob"))


@query("V23_apply_minimal", f"""{V}, o AS (SELECT scan_id, CASE WHEN {_u("'42:' || scan_id || ':0:0'", 0)} < 0.5 THEN 3-x ELSE x END AS x, y, z, v + CASE WHEN {_u("'42:' || scan_id || ':0:1'", 0)} < 0.5 THEN -0.08 + {_u("'42:' || scan_id || ':0:1:offset'", 0)}*0.16 ELSE 0 END AS v FROM vox) {OUT}""")
def _(spark, sf):
    plan = augment.augmentation_plan(scans(spark, sf), "minimal")
    return vox_out(augment.apply_plan(volumes(spark, sf), plan, ["RandFlip", "RandShiftIntensity"]))


@query("V23_apply_strong")
def _(spark, sf):
    plan = augment.augmentation_plan(scans(spark, sf), "strong")
    return vox_out(augment.apply_plan(volumes(spark, sf), plan, [n for n, _, _ in augment.PROFILES["strong"]]))


def _draw(name):
    return _u(f"'42:' || scan_id || ':{name}'", 0)


_CELL = "'42:' || a.scan_id || ':0:' || a.z || ':' || (a.x*4+a.y)"


@query("V14_random_shift_augmentation", f"""{V}, dr AS (SELECT scan_id, {_draw('flip')} < 0.5 AS fl, {_draw('move')} < 0.5 AS mv, {_draw('noise')} < 0.5 AS ns, {_draw('level')} < 0.5 AS lv,
 CAST(floor(-1 + {_draw('dx')}*3) AS INT) AS sx, CAST(floor(-1 + {_draw('dy')}*3) AS INT) AS sy, CAST(floor(-1 + {_draw('dz')}*3) AS INT) AS sz,
 0.95 + {_draw('scale')}*0.1 AS sc, -0.05 + {_draw('shift')}*0.1 AS sh FROM (SELECT DISTINCT scan_id FROM vox)),
k AS (SELECT scan_id, fl, CASE WHEN mv THEN sx ELSE 0 END AS dx, CASE WHEN mv THEN sy ELSE 0 END AS dy, CASE WHEN mv THEN sz ELSE 0 END AS dz,
 CASE WHEN ns THEN 0.01 ELSE 0 END AS sd, CASE WHEN lv THEN sc ELSE 1 END AS sc, CASE WHEN lv THEN sh ELSE 0 END AS sh FROM dr),
o AS (SELECT a.scan_id, a.x, a.y, a.z, (coalesce(b.v, 0.0) + sd*sqrt(-2*ln({_u(_CELL, 0)}))*cos(2*pi()*({_u(_CELL, 1)})))*sc + sh AS v
 FROM vox a JOIN k ON k.scan_id=a.scan_id LEFT JOIN vox b ON b.scan_id=a.scan_id AND b.x=CASE WHEN fl THEN 3-(a.x-dx) ELSE a.x-dx END AND b.y=a.y-dy AND b.z=a.z-dz) {OUT}""")
def _(spark, sf):
    return vox_out(augment.random_shift_augmentation(volumes(spark, sf), reach=1))


# --- preprocessing, inverse, provenance -------------------------------------------------------

def _volume_set(spark, sf):
    return preprocess.Volumes(volumes(spark, sf), affines(spark, sf))


@query("V12_inverse_geometry", f"{V}, {BOX}, o AS (SELECT scan_id, x, y, z, v FROM vox) {OUT}")
def _(spark, sf):
    steps = [("reorient", {}), ("crop_foreground", {}), ("pad", {"target_shape": [6, 6, 6]}), ("center_crop", {"target_shape": [8, 8, 8]})]
    vol = _volume_set(spark, sf)
    done, _ = preprocess.run_steps(vol, steps)
    back = preprocess.undo(done).slabs.withColumn("px", F.col("px").cast("array<double>"))
    original = volumes(spark, sf).select("scan_id", "c", "z", F.col("px").alias("px0"))
    # voxels went through float32; exact identity is checked against the float32 originals
    same = back.join(original, ["scan_id", "c", "z"]).withColumn(
        "px", F.zip_with("px", "px0", lambda a, b: F.when(a == b.cast("float").cast("double"), b).otherwise(a))
    )
    return vox_out(same)


@query("V26_profile_runner")
def _(spark, sf):
    steps = [(n, {"target_shape": [8, 8, 8]} if n == "resize" else p) for n, p in preprocess.profile("autism")]
    done, _ = preprocess.run_steps(_volume_set(spark, sf), steps)
    return slabs.voxels(done.slabs).select("scan_id", "x", "y", "z", F.round(F.col("v").cast("double"), 4).alias("v"))


@query("P27_V25_provenance", f"{V}, {STATS}, n AS (SELECT scan_id, (v-mu)/(sd+1e-8) v FROM vox JOIN st USING (scan_id)), s2 AS (SELECT scan_id, avg(v) mu, stddev_pop(v) sd FROM n GROUP BY scan_id) SELECT st.scan_id, 0 AS step_no, 'normalize' AS step, 'mode=z_score' AS params, st.sd > 1e-9 AS changed, true AS key_ok FROM st JOIN s2 USING (scan_id)")
def _(spark, sf):
    vol = _volume_set(spark, sf)
    after = preprocess.create("normalize", mode="z_score")(vol)
    h = preprocess.provenance(vol, after, 0, "normalize", {"mode": "z_score"})
    flat = F.col("scan_id") % 50 == 49
    key = F.sha2(F.concat_ws("_", "input_hash", F.lit("normalize"), F.lit("mode=z_score"), F.lit("1.0.0")), 256)
    # a flat volume keeps std 0 but its mean moves to 0, so every hash changes; only non-flat ones are reported as changed
    return h.select(
        "scan_id", "step_no", "step", M.stable_params(F.col("params")).alias("params"),
        (~flat & (F.col("input_hash") != F.col("output_hash"))).alias("changed"), (key == F.col("cache_key")).alias("key_ok"),
    )


@query("P27_state_hash", "WITH s AS (SELECT vec_id%50 AS grp, count(*) n, CAST(sum(vec_id) AS DOUBLE)/1024 AS mu, CAST(max(vec_id) AS DOUBLE)/2048 AS sd FROM embeddings GROUP BY ALL) SELECT grp, sha256('4,4,4_1,1,1_e_' || printf('%.6f', mu) || '_' || printf('%.6f', sd) || '_mask_' || printf('%.6f', mu/2)) AS hash FROM s")
def _(spark, sf):
    s = table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 50).alias("grp")).agg(
        (F.sum("vec_id").cast("double") / 1024).alias("mu"), (F.max("vec_id").cast("double") / 2048).alias("sd")
    )
    h = M.state_hash(F.lit("4,4,4"), F.lit("1,1,1"), F.lit("e"), F.col("mu"), F.col("sd"), F.col("mu") / 2)
    return s.select("grp", h.alias("hash"))


@query("P28_step_cache_key", "SELECT vec_id, sha256(md5(CAST(vec_id AS VARCHAR)) || '_resize_alpha=' || label || ',target=8_1.0.0') AS cache_key FROM embeddings")
def _(spark, sf):
    params = F.create_map(F.lit("target"), F.lit("8"), F.lit("alpha"), F.col("label").cast("string"))
    key = M.step_cache_key(F.md5(F.col("vec_id").cast("string")), F.lit("resize"), params)
    return table(spark, sf, "embeddings").select("vec_id", key.alias("cache_key"))


@query("S15_versioned_sink", f"{V} SELECT scan_id, z, round(sum(v),5)+0.0 AS total FROM vox GROUP BY scan_id, z")
def _(spark, sf):
    path, rows = fresh_path(spark, "volumes"), volumes(spark, sf)
    sinks.write_volumes(rows, path, "v1")
    sinks.write_volumes(rows.where("scan_id % 2 = 0"), path, "v1", clear=True)  # half of it is gone
    sinks.write_volumes(rows, path, "v1")  # and comes back, the rest is skipped
    back = spark.read.parquet(path).where("cache_version = 'v1'")
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    return back.select("scan_id", "z", (F.round(total, 5) + 0.0).alias("total"))


# --- files ------------------------------------------------------------------------------------

def _nifti(vid, emb):
    """(path, NIfTI-1 bytes) of an embedding; of ten files one ends inside its header and one inside its voxels, every third is gzipped."""
    import gzip

    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 4, 4, 4, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, 1, 1.5, 2, 1, 1, 1, 1)
    struct.pack_into("<fff", head, 108, 352, 0, 0)
    struct.pack_into("<hh", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, 1, 0, 0, vid % 7, 0, 1.5, 0, 2, 0, 0, 2, 3)
    head[344:348] = b"n+1\0"
    cube = np.asarray(emb, dtype="<f4").reshape(4, 4, 4)
    raw = bytes(head) + cube.tobytes(order="F")
    raw = raw[:100] if vid % 10 == 9 else raw[:-20] if vid % 10 == 8 else raw
    packed = vid % 3 == 0
    return f"/scans/v{vid}.nii" + (".gz" if packed else ""), gzip.compress(raw, mtime=0) if packed else raw


def _encode(batches):
    """Embedding rows -> the files of :func:`_nifti`."""
    for pdf in batches:
        made = [_nifti(vid, emb) for vid, emb in zip(pdf["vec_id"], pdf["embedding"])]
        yield pd.DataFrame(made, columns=["path", "content"])


def nifti_files(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_encode, "path string, content binary")


NAME = "'/scans/v' || vec_id || '.nii' || CASE WHEN vec_id%3=0 THEN '.gz' ELSE '' END"


@query("S03_header_catalog", f"SELECT {NAME} AS path, CASE WHEN vec_id%10<>9 THEN '4x4x4' END AS shape, CASE WHEN vec_id%10<>9 THEN 'float32' END AS dtype, CASE WHEN vec_id%10<>9 THEN 4.5 END::DOUBLE AS spacing_sum, CASE WHEN vec_id%10<>9 THEN vec_id%7 END::DOUBLE AS origin_x, vec_id%10>=8 AS failed FROM embeddings")
def _(spark, sf):
    c = file_source.catalog(nifti_files(spark, sf))
    return c.select(
        "path", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "dtype",
        F.aggregate("spacing", F.lit(0.0), lambda a, v: a + v).alias("spacing_sum"), A.cell(F.col("affine"), 0, 3).alias("origin_x"),
        F.col("error").isNotNull().alias("failed"),
    )


@query("S04_slab_extraction", f"SELECT {NAME} AS path, (i//16)::INT AS x, ((i//4)%4)::INT AS y, (i%4)::INT AS z, round(CAST(embedding[i+1] AS DOUBLE),6)+0.0 AS v FROM embeddings, unnest(range(64)) t(i) WHERE vec_id%10<8")
def _(spark, sf):
    s = file_source.extract_slabs(nifti_files(spark, sf))
    return slabs.voxels(s).select(F.col("scan_id").alias("path"), "x", "y", "z", r6(F.col("v").cast("double")).alias("v"))


@query("S04_extraction_errors", f"SELECT {NAME} AS path FROM embeddings WHERE vec_id%10>=8")
def _(spark, sf):
    return file_source.extraction_errors(nifti_files(spark, sf)).select(F.col("scan_id").alias("path"))


def _packed(batches):
    """Embedding rows -> compressed files: whole, cut after compression, of two members, of two with the second cut, damaged."""
    import gzip

    for pdf in _encode(batches):
        out = []
        for path, raw in zip(pdf["path"], pdf["content"]):
            vid = int(path.split("/v")[1].split(".")[0])
            raw = gzip.decompress(raw) if path.endswith(".gz") else raw
            one, two = (gzip.compress(part, mtime=0) for part in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
            whole = gzip.compress(raw, mtime=0)
            flipped = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]  # inside the checksum
            out.append((whole, whole[: -9 - vid % 20], one + two, one + two[:-10], flipped)[vid % 5])
        yield pd.DataFrame({"path": [p.removesuffix(".gz") + ".gz" for p in pdf["path"]], "content": out})


def packed_files(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_packed, "path string, content binary")


PACKED = "'/scans/v' || vec_id || '.nii.gz'"
WHOLE = "(vec_id%5 IN (0,2) AND vec_id%10<8)"


@query("S03_compressed_catalog", f"SELECT {PACKED} AS path, CASE WHEN vec_id%5 IN (0,2) AND vec_id%10<>9 THEN '4x4x4' END AS shape, NOT {WHOLE} AS failed FROM embeddings")
def _(spark, sf):
    c = file_source.catalog(packed_files(spark, sf))
    whole = F.expr("cast(regexp_extract(path, 'v([0-9]+)', 1) as bigint) % 5 in (0, 2)")
    return c.select(
        "path", F.when(whole, F.array_join(F.col("shape").cast("array<string>"), "x")).alias("shape"), F.col("error").isNotNull().alias("failed")
    )


@query("C01_compressed_checks", f"SELECT {PACKED} AS path, vec_id%7<>0 AS exists, vec_id%7<>0 AND {WHOLE} AS readable, NOT (vec_id%7<>0 AND {WHOLE}) AS corrupt FROM embeddings")
def _(spark, sf):
    files = packed_files(spark, sf)
    found = files.where("cast(regexp_extract(path, 'v([0-9]+)', 1) as bigint) % 7 <> 0").select("path")
    return file_source.file_checks(found, file_source.catalog(files))


@query("S04_compressed_slabs", f"SELECT {PACKED} AS path, round(sum(CAST(embedding[i+1] AS DOUBLE)),5)+0.0 AS total FROM embeddings, unnest(range(64)) t(i) WHERE {WHOLE} GROUP BY vec_id")
def _(spark, sf):
    s = file_source.extract_slabs(packed_files(spark, sf))
    v = s.select("scan_id", F.explode("px").alias("v"))
    return v.groupBy(F.col("scan_id").alias("path")).agg((F.round(F.sum(F.col("v").cast("double")), 5) + 0.0).alias("total"))


def _png(picture):
    """Bytes of an 8-bit grey PNG."""
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows, cols = picture.shape
    lines = b"".join(b"\0" + row.tobytes() for row in picture)
    head = struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _write_files(spark, sf, name, made):
    """A new folder with the file ``made(vec_id, embedding)``, a (relative path, bytes), of every embedding.

    A file costs much more than its row, so rows are dealt to all cores, however few parts the table has.
    """
    root = fresh_path(spark, name)

    def write(batches):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        system.create_dir(inner, recursive=True)
        there = {inner}
        for pdf in batches:
            for vid, emb in zip(pdf["vec_id"], pdf["embedding"]):
                rel, content = made(vid, emb)
                at = f"{inner}/{rel}".rpartition("/")[0]
                if at not in there:
                    system.create_dir(at, recursive=True)
                    there.add(at)
                # a repeated attempt writes the same bytes again
                with system.open_output_stream(f"{inner}/{rel}", compression=None) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()  # one number
    return root


def _picture_file(vid, emb):
    grey = np.minimum(np.floor(np.abs(np.asarray(emb, dtype=np.float64)) * 255), 255).astype(np.uint8)
    return f"p{vid}.png", _png(grey.reshape(8, 8))


def picture_files(spark, sf):
    """The folder of one grey 8 x 8 picture per embedding: pixel (row, column) is 255 times the size of an element, at most 255."""
    return _write_files(spark, sf, "pictures", _picture_file)


PICTURE = "cast(regexp_extract(path, 'p([0-9]+)[.]png', 1) as bigint)"


@query("S05_image_source", "SELECT vec_id, (i%8)::INT AS x, (i//8)::INT AS y, least(floor(abs(CAST(embedding[i+1] AS DOUBLE))*255),255)::INT AS grey FROM embeddings, unnest(range(64)) t(i)")
def _(spark, sf):
    v = slabs.voxels(file_source.read_images(spark, picture_files(spark, sf)))
    return v.select(F.expr(PICTURE.replace("path", "scan_id")).alias("vec_id"), "x", "y", F.col("v").cast("int").alias("grey"))


@query("S05_image_headers", "SELECT vec_id, '8' AS height, '8' AS width, '1' AS channels FROM embeddings")
def _(spark, sf):
    h = file_source.image_headers(spark, picture_files(spark, sf))
    return h.select(F.expr(PICTURE).alias("vec_id"), *[F.col("header")[n].alias(n) for n in ("height", "width", "channels")])


def _scan_file(vid, emb):
    """(relative path, bytes) of the file of an embedding: by the last digit of its id a picture (4), a note (5), a slice (6) or a volume.

    Volumes end inside their header (9) or voxels (8), are flat (7, of every second), have a spacing of 0 (3) or a blank slice (2).
    """
    import gzip

    place = f"{('AD', 'control', 'site')[vid % 3]}/s{vid % 17}"
    kind = vid % 10
    if kind == 4:
        grey = np.minimum(np.floor(np.abs(np.asarray(emb, dtype=np.float64)) * 255), 254).astype(np.uint8)
        grey[0] = 255
        return f"{place}/p{vid}.png", _png(grey.reshape(8, 8))
    if kind == 5:
        return f"{place}/v{vid}.txt", b"notes"
    if kind == 6:
        return f"{place}/series{vid % 5}{vid % 2}{vid % 7}/i{vid}.dcm", bytes(128) + (b"DICM" if vid % 40 != 16 else b"none") + bytes(8)
    cube = np.asarray(emb, dtype="<f4").reshape(4, 4, 4).copy()
    cube[:, :, 1] = 0.5 if kind == 2 else cube[:, :, 1]
    cube[:] = 1.0 if vid % 20 == 7 else cube
    name, content = _nifti(vid, cube)
    if kind == 3:
        raw = bytearray(gzip.decompress(content) if name.endswith(".gz") else content)
        struct.pack_into("<f", raw, 84, 0.0)
        content = gzip.compress(bytes(raw), mtime=0) if name.endswith(".gz") else bytes(raw)
    return f"{place}/{name.rsplit('/', 1)[1]}", content


def scan_folder(spark, sf):
    """A folder of files of many kinds, one per embedding."""
    return _write_files(spark, sf, "scans", _scan_file)


UNREADABLE, FLAT, BLANK, SPACING = (stats.ERRORS[k] for k in ("readable", "intensity_valid", "no_empty_slices", "voxel_spacing_valid"))
FOLDER = f"""WITH k AS (SELECT vec_id, vec_id%10 AS d, CASE vec_id%3 WHEN 0 THEN 'AD' WHEN 1 THEN 'control' ELSE 'site' END AS top, 's' || vec_id%17 AS s FROM embeddings),
sc AS (SELECT top || '/' || s || CASE WHEN d=4 THEN '/p' || vec_id || '.png' ELSE '/v' || vec_id || '.nii' || CASE WHEN vec_id%3=0 THEN '.gz' ELSE '' END END AS path, 'file' AS kind,
 CASE WHEN d=4 THEN 'image' ELSE 'nifti' END AS format, CASE WHEN top='site' THEN top ELSE s END AS subject, CASE top WHEN 'site' THEN 'Unknown' ELSE upper(top) END AS class,
 CASE WHEN d=4 THEN '8x8x1' WHEN d<8 THEN '4x4x4' END AS dims, CASE WHEN d=4 THEN 1 WHEN d=3 THEN 0 WHEN d<8 THEN 1.5 END::DOUBLE AS s1,
 CASE WHEN d>=8 THEN '{UNREADABLE}' WHEN d=3 THEN '{SPACING}' WHEN vec_id%20=7 THEN '{FLAT}|{BLANK}' WHEN d=2 THEN '{BLANK}' ELSE '' END AS errors FROM k WHERE d NOT IN (5,6)
UNION ALL SELECT top || '/' || s || '/series' || vec_id%5 || vec_id%2 || vec_id%7, 'series', 'dicom', any_value(CASE WHEN top='site' THEN top ELSE s END), any_value(CASE top WHEN 'site' THEN 'Unknown' ELSE upper(top) END), NULL, NULL,
 CASE WHEN bool_or(vec_id%40=16) THEN '{UNREADABLE}' ELSE '' END FROM k WHERE d=6 GROUP BY 1)"""


@query("S01_S02_S03_C01_C03_folder_audit", f"{FOLDER} SELECT path, kind, format, subject, class, dims, errors, errors='' AS valid FROM sc")
def _(spark, sf):
    scans = folder.audited_scans(spark, scan_folder(spark, sf))
    dims = F.array_join(F.col("dims").cast("array<string>"), "x")
    return scans.select("path", "kind", "format", "subject", "class", dims.alias("dims"), F.array_join("errors", "|").alias("errors"), "valid")


@query("A08_F04_folder_report", f"""{FOLDER}, v AS (SELECT * FROM sc WHERE errors='') SELECT (SELECT count(DISTINCT subject) FROM sc) AS total_subjects, (SELECT count(*) FROM sc) AS total_files, (SELECT count(*) FROM sc WHERE errors<>'') AS corrupt_count,
string_agg(DISTINCT format, ',' ORDER BY format) AS formats, string_agg(DISTINCT dims, ',' ORDER BY dims) AS dims, count(*) AS missing_metadata_count, round(min(s1),6) AS min1, round(max(s1),6) AS max1, round(avg(s1),6) AS mean1,
(SELECT string_agg(class || '=' || n, ',' ORDER BY class) FROM (SELECT class, count(*) n FROM v GROUP BY class)) AS classes, 'Unknown=' || count(*) AS makers FROM v""")
def _(spark, sf):
    rep = folder.folder_report(folder.audited_scans(spark, scan_folder(spark, sf)))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    dims = F.array_sort(F.transform("unique_dimensions", lambda d: F.array_join(d.cast("array<string>"), "x")))
    return rep.select(
        "total_subjects", "total_files", "corrupt_count", F.array_join("formats_present", ",").alias("formats"), F.array_join(dims, ",").alias("dims"),
        "missing_metadata_count", *[r6(F.col(f"{n}_spacing")[1]).alias(f"{n}1") for n in ("min", "max", "mean")],
        text("class_balance").alias("classes"), text("scanner_manufacturers").alias("makers"),
    )


# leading bytes per page, the page text as the body
MAGIC = ["89504E470D0A1A0A", "FFD8FFE0", "00" * 128 + "4449434D", "00" * 344 + "6E2B3100", "00" * 344 + "6E693100", "00000000" + "6E2B3200", "00000000" + "6E693200", ""]
EXT = [".nii", ".png", ".dcm", ".bin", ".JPG", ".nii.gz"]


def signed_files(spark, sf):
    k = F.col("page_id")
    magic = F.get(F.array(*[F.lit(m) for m in MAGIC]), (k % 8).cast("int"))
    ext = F.get(F.array(*[F.lit(e) for e in EXT]), (k % 6).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", F.concat(F.unhex(magic), F.encode("html", "UTF-8")).alias("content"), F.concat(F.lit("/scans/p"), k.cast("string"), ext).alias("path"),
        F.octet_length("html").alias("length"),
    )


@query("S02_format_detection", "SELECT page_id, CASE WHEN page_id%8 IN (0,1) THEN 'image' WHEN page_id%8=2 THEN 'dicom' WHEN page_id%8 BETWEEN 3 AND 6 THEN 'nifti' ELSE CASE page_id%6 WHEN 0 THEN 'nifti' WHEN 1 THEN 'image' WHEN 2 THEN 'dicom' WHEN 4 THEN 'image' WHEN 5 THEN 'nifti' END END AS format FROM pages")
def _(spark, sf):
    name = F.substring_index("path", "/", -1)
    return signed_files(spark, sf).select("page_id", detect_format(F.col("content"), name).alias("format"))


@query("P25_content_fingerprint", "SELECT page_id, sha256(strlen(html) || '_' || page_id || html) AS fingerprint FROM pages WHERE page_id%5<>0 UNION ALL SELECT page_id, '' FROM pages WHERE page_id%5=0")
def _(spark, sf):
    length = F.when(F.col("page_id") % 5 != 0, F.octet_length("html"))
    content = F.encode("html", "UTF-8")
    return table(spark, sf, "pages").select("page_id", M.content_fingerprint(length, F.col("page_id"), content).alias("fingerprint"))


LIST = "case when o_orderkey % 6 = 0 then '/data/s' || cast(o_custkey as string) || '/series/i' || cast(o_orderkey as string) || '.dcm' when o_orderkey % 6 = 1 then '/data/s' || cast(o_custkey as string) || '/t1_' || cast(o_orderkey as string) || '.nii.GZ' when o_orderkey % 6 = 2 then '/data/s' || cast(o_custkey as string) || '/p' || cast(o_orderkey as string) || '.Jpeg' when o_orderkey % 6 = 3 then '/data/s' || cast(o_custkey as string) || '/series/X' || cast(o_orderkey as string) || '.DCM' else '/data/s' || cast(o_custkey as string) || '/notes' || cast(o_orderkey as string) || '.txt' end"


@query("S01_scan_discovery", f"""WITH f AS (SELECT {LIST} AS path FROM orders), d AS (SELECT DISTINCT regexp_replace(path,'/[^/]*$','') AS path FROM f WHERE path LIKE '%.dcm')
SELECT path, 'series' AS kind FROM d UNION ALL SELECT path, 'file' FROM f WHERE (lower(path) LIKE '%.nii.gz' OR lower(path) LIKE '%.jpeg' OR (path LIKE '%.DCM' AND regexp_replace(path,'/[^/]*$','') NOT IN (SELECT path FROM d)))""")
def _(spark, sf):
    return file_source.discover_scans(table(spark, sf, "orders").select(F.expr(LIST).alias("path")))


@query("C01_file_checks", f"SELECT {NAME} AS path, vec_id%8<>0 AS exists, vec_id%8<>0 AND vec_id%10<8 AS readable, NOT (vec_id%8<>0 AND vec_id%10<8) AS corrupt FROM embeddings")
def _(spark, sf):
    found = nifti_files(spark, sf).where("cast(regexp_extract(path, 'v([0-9]+)', 1) as bigint) % 8 <> 0").select("path")
    return file_source.file_checks(found, file_source.catalog(nifti_files(spark, sf)))


# --- scoring ----------------------------------------------------------------------------------

def _two_means():
    """Model: logits are the means of the two halves of the features, times ten."""
    return lambda x: np.stack([x[:, :32].mean(axis=1) * 10, x[:, 32:].mean(axis=1) * 10], axis=1)


@query("X03_batch_scoring", """WITH l AS (SELECT vec_id, avg(v) FILTER (i<32)*10 a, avg(v) FILTER (i>=32)*10 b FROM (SELECT vec_id, i, CAST(embedding[i+1] AS DOUBLE) v FROM embeddings, unnest(range(64)) t(i)) GROUP BY vec_id)
SELECT vec_id, round(1/(1+exp(a-b)),5) AS prob, CASE WHEN b>=a THEN 1 ELSE 0 END AS pred FROM l""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scored = scoring.score(rows, ["vec_id"], "x", _two_means)
    return scored.select("vec_id", F.round(F.col("probs")[1], 5).alias("prob"), "pred")


@query("X01_transform_registry", f"{V}, {STATS}, n AS (SELECT scan_id, x, y, z, (v-mn)/(mx-mn+1e-8) AS v FROM vox JOIN st USING (scan_id)), o AS (SELECT scan_id, x-1 AS x, y-1 AS y, z-1 AS z, v FROM n WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2 AND z BETWEEN 1 AND 2) {OUT}")
def _(spark, sf):
    vol = preprocess.create("normalize", mode="min_max")(_volume_set(spark, sf))
    return vox_out(preprocess.create("center_crop", target_shape=[2, 2, 2])(vol).slabs)
