"""Augmentation and repeated-prediction plans: which transform runs on which scan, with which parameters.

A plan is a table (scan_id, replicate, step_no, transform, params).  Draws come from hashes of
(seed, scan, replicate, step, name), so a plan can be recomputed anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import draws
from cohortlake.operators.volumes import geometry, intensity, warp
from cohortlake.operators.volumes.slabs import rows_reversed
from cohortlake.session import materialised, stacked

# fixed values: parameter ranges of the random transforms
TEN_DEGREES = math.pi / 18
FLIP = ("RandFlip", 0.5, {})
ROTATE90 = ("RandRotate90", 0.5, {"k": (1.0, 4.0)})
AFFINE = (
    "RandAffine", 0.5,
    {
        **{r: (-TEN_DEGREES, TEN_DEGREES) for r in ("rx", "ry", "rz")},
        **{t: (-4.0, 4.0) for t in ("tx", "ty", "tz")},
        **{s: (0.9, 1.1) for s in ("sx", "sy", "sz")},
    },
)
ZOOM = ("RandZoom", 0.5, {"zoom": (0.9, 1.1)})
NOISE = ("RandGaussianNoise", 0.5, {"std": (0.0, 0.015)})
SMOOTH = ("RandGaussianSmooth", 0.5, {s: (0.25, 1.5) for s in ("sigma_x", "sigma_y", "sigma_z")})
CONTRAST = ("RandAdjustContrast", 0.5, {"gamma": (0.5, 2.0)})
SHIFT = ("RandShiftIntensity", 0.5, {"offset": (-0.08, 0.08)})
SCALE = ("RandScaleIntensity", 0.5, {"factor": (-0.1, 0.1)})
ELASTIC = ("Rand3DElastic", 0.15, {"sigma": (5.0, 8.0), "magnitude": (50.0, 100.0)})

# fixed values: ordered transforms of each profile
PROFILES = {
    "minimal": [FLIP, SHIFT],
    "moderate": [FLIP, AFFINE, CONTRAST, NOISE],
    "strong": [FLIP, ROTATE90, AFFINE, ZOOM, NOISE, SMOOTH, CONTRAST, SHIFT, SCALE],
    "research": [FLIP, ROTATE90, AFFINE, ZOOM, ELASTIC, NOISE, SMOOTH, CONTRAST, SHIFT, SCALE],
}


def profile_steps(profile: str) -> list[tuple[str, float, dict]]:
    if profile not in PROFILES:
        raise ValueError(f"unknown augmentation profile: {profile}")
    return PROFILES[profile]


def profile_metadata(profile: str) -> dict:
    steps = profile_steps(profile)
    return {
        "augmentation_profile": profile,
        "enabled_transforms": [name for name, _, _ in steps],
        "transform_probabilities": {name: p for name, p, _ in steps},
    }


def _drawn(ranges: dict, *keys: Column) -> Column:
    if not ranges:
        return F.create_map().cast("map<string,double>")
    return F.create_map(
        *[c for n, (lo, hi) in ranges.items() for c in (F.lit(n), draws.between(lo, hi, *keys, F.lit(n)))]
    )


def augmentation_plan(scans: DataFrame, profile: str, replicates: int = 1, seed: int = 42) -> DataFrame:
    """Steps that fire for each scan and replicate, in order, with their drawn parameters."""
    steps = profile_steps(profile)
    rows = scans.select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    options = []
    for no, (name, prob, ranges) in enumerate(steps):
        keys = [F.lit(seed), F.col("scan_id"), F.col("replicate"), F.lit(no)]
        options.append(
            F.when(
                draws.uniform(*keys) < prob,
                F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("transform"), _drawn(ranges, *keys).alias("params")),
            )
        )
    fired = F.filter(F.array(*options), lambda s: s.isNotNull())
    return rows.select("scan_id", "replicate", F.explode(fired).alias("s")).select("scan_id", "replicate", "s.*")


# fixed values: the deterministic first runs of repeated prediction
TTA_FIXED = {
    0: [],
    1: [("flip", {})],
    2: [("affine", {"rx": 5.0 * (math.pi / 180.0), "tx": 1.0})],
    3: [("scale_percentiles", {"lower": 0.01, "upper": 0.99, "low": 0.0, "high": 1.05})],
    4: [("contrast", {"gamma": 1.15})],
}


def tta_plan(scans: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """(scan_id, run, step_no, transform, params): fixed runs 0-4, seeded random ones after that.

    A random run depends on seed + run only, so all scans of that run share its parameters.
    Run 0 is the unchanged scan and has no row.
    """
    def step(no, name, params):
        cells = [c for k, v in params.items() for c in (F.lit(k), v if isinstance(v, Column) else F.lit(float(v)))]
        values = F.create_map(*cells) if cells else F.create_map().cast("map<string,double>")
        return F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("transform"), values.alias("params"))

    kind = "array<struct<step_no:int,transform:string,params:map<string,double>>>"
    key = F.lit(seed) + F.col("run")
    fixed_runs = F.array().cast(kind)
    for r, steps in TTA_FIXED.items():
        listed = F.array(*[step(i, n, p) for i, (n, p) in enumerate(steps)]).cast(kind)
        fixed_runs = F.when(F.col("run") == r, listed).otherwise(fixed_runs)
    u = lambda name, lo, hi: draws.between(lo, hi, key, F.lit(name))
    warped = {**{r: u(r, -0.05, 0.05) for r in ("rx", "ry", "rz")}, **{t: u(t, -0.5, 0.5) for t in ("tx", "ty", "tz")}}
    drawn = F.filter(
        F.array(
            F.when(draws.uniform(key, F.lit("flip")) > 0.5, step(0, "flip", {})),
            step(1, "affine", warped),
            step(2, "contrast", {"gamma": u("gamma", 0.85, 1.15)}),
        ),
        lambda s: s.isNotNull(),
    ).cast(kind)
    planned = F.when(F.col("run") > max(TTA_FIXED), drawn).otherwise(fixed_runs)
    rows = scans.select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return rows.select("scan_id", "run", F.explode(planned).alias("s")).select("scan_id", "run", "s.*")


def _params_of(plan: DataFrame, transform: str, names: list[str], neutral: dict[str, float]) -> DataFrame:
    """One row per planned scan: the parameters of ``transform``."""
    return plan.where(F.col("transform") == transform).select(
        "scan_id", *[F.coalesce(F.try_element_at("params", F.lit(n)), F.lit(neutral.get(n, 0.0))).alias(n) for n in names]
    )


def _where_planned(slabs: DataFrame, params: DataFrame, px) -> DataFrame:
    """Rewrite pixels of planned scans in one pass; ``px`` sees the parameters as columns."""
    j = slabs.join(params.withColumn("_on", F.lit(True)), "scan_id", "left")
    return j.withColumn("px", F.when(F.col("_on"), px).otherwise(F.col("px"))).select(*slabs.columns)


def _apart(slabs: DataFrame, params: DataFrame, fn) -> DataFrame:
    """Send planned scans through ``fn`` and the others past it."""
    return stacked(fn(slabs.join(params, "scan_id")).select(*slabs.columns), slabs.join(params, "scan_id", "left_anti"))


def _flip(slabs, params, seed):
    nx, ny = F.col("nx"), F.col("ny")
    return _where_planned(slabs, params, rows_reversed(F.col("px"), nx, ny))


def _rotate(slabs, params, seed):
    turns = F.floor(F.col("k"))
    no = F.lit(False)
    source = [F.lit(0), F.when(turns == 2, 1).otherwise(2), F.when(turns == 2, 2).otherwise(1)]
    flipped = [no, turns.isin(1, 2), turns.isin(2, 3)]
    return _apart(slabs, params, lambda hit: geometry.permute(hit, source, flipped))


def _affine(slabs, params, seed):
    return _apart(slabs, params, lambda hit: warp.affine_warp(hit.drop(*warp.WARP), params))


def _zoom(slabs, params, seed):
    inverse = params.select(
        "scan_id", *[F.lit(0.0).alias(c) for c in warp.WARP[:6]], *[(1 / F.col("zoom")).alias(c) for c in warp.WARP[6:]]
    )
    return _affine(slabs, inverse, seed)


def _smooth(slabs, params, seed):
    return _apart(slabs, params, lambda hit: warp.gaussian_smooth(hit, ("sigma_x", "sigma_y", "sigma_z")))


def _noise(slabs, params, seed):
    return _where_planned(slabs, params, intensity.noisy(F.col("px"), F.col("std"), seed))


def _contrast(slabs, params, seed):
    return _apart(slabs, params, lambda hit: intensity.adjust_contrast(hit, F.col("gamma")))


def _shift(slabs, params, seed):
    return _where_planned(slabs, params, F.transform("px", lambda v: v + F.col("offset")))


def _scale(slabs, params, seed):
    return _where_planned(slabs, params, F.transform("px", lambda v: v * (1 + F.col("factor"))))


def _percentiles(slabs, params, seed):
    return _apart(slabs, params, intensity.percentile_scale)


UNIT = {c: 1.0 for c in ("sx", "sy", "sz")}
RUNNERS = {
    "RandFlip": (_flip, []), "RandRotate90": (_rotate, ["k"]), "RandAffine": (_affine, warp.WARP),
    "RandZoom": (_zoom, ["zoom"]), "RandGaussianNoise": (_noise, ["std"]),
    "RandGaussianSmooth": (_smooth, ["sigma_x", "sigma_y", "sigma_z"]), "RandAdjustContrast": (_contrast, ["gamma"]),
    "RandShiftIntensity": (_shift, ["offset"]), "RandScaleIntensity": (_scale, ["factor"]),
    "flip": (_flip, []), "affine": (_affine, warp.WARP), "contrast": (_contrast, ["gamma"]),
    "scale_percentiles": (_percentiles, []),
}
# transforms that read their input more than once
REREADING = {_rotate, _affine, _zoom, _smooth, _contrast, _percentiles}


def apply_plan(slabs: DataFrame, plan: DataFrame, transforms: list[str], seed: int = 42) -> DataFrame:
    """Run a plan of one replicate (or run) step by step; scans without a step pass through it.

    Input that a step reads more than once is written to the shared folder first, unless it is
    the input of the whole plan.
    """
    unknown = [t for t in transforms if t not in RUNNERS]
    if unknown:
        raise ValueError(f"transforms {unknown} cannot be applied to slabs")
    derived = False
    for name in transforms:
        run, names = RUNNERS[name]
        if derived and run in REREADING:
            slabs, derived = materialised(slabs, "augmented"), False
        slabs, derived = run(slabs, _params_of(plan, name, names, UNIT), seed), True
    return slabs


def random_shift_augmentation(
    slabs: DataFrame, seed: int = 42, flip_prob: float = 0.5, reach: int = 4, noise: float = 0.01,
    scale: tuple[float, float] = (0.95, 1.05), shift: tuple[float, float] = (-0.05, 0.05),
) -> DataFrame:
    """Flip, whole-voxel shift with zero fill, noise, scale and shift, each by its own draw per scan."""
    sid = F.col("scan_id")
    fires = lambda name, p: draws.uniform(F.lit(seed), sid, F.lit(name)) < p
    whole = lambda name: F.floor(draws.between(-reach, reach + 1, F.lit(seed), sid, F.lit(name))).cast("int")
    nx, ny = F.col("nx"), F.col("ny")
    flipped = F.when(
        fires("flip", flip_prob), rows_reversed(F.col("px"), nx, ny)
    ).otherwise(F.col("px"))
    out = slabs.withColumn("px", flipped)
    step = lambda name: F.when(fires("move", 0.5), whole(name)).otherwise(0)
    out = geometry.translate(out, step("dx"), step("dy"), step("dz"))
    out = intensity.gaussian_noise(out, F.when(fires("noise", 0.5), noise).otherwise(0.0), seed)
    between = lambda name, r: draws.between(*r, F.lit(seed), sid, F.lit(name))
    on = fires("level", 0.5)
    return intensity.scale_shift(
        out, F.when(on, between("scale", scale)).otherwise(1.0), F.when(on, between("shift", shift)).otherwise(0.0)
    )
