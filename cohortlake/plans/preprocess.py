"""Preprocessing profiles: named transforms chained over volume tables, with provenance and inverses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import metadata as M
from cohortlake.operators.volumes import geometry, intensity, masks, resample
from cohortlake.operators.volumes.slabs import standardised
from cohortlake.operators.volumes.stats import shape_text, volume_statistics
from cohortlake.session import checkpointed, materialised

# fixed values: steps of each profile; the bias-field solver is not built, so its step is left out
PROFILES = {
    "autism": [
        ("reorient", {"target": "RAS"}), ("skull_strip", {"strategy": "threshold"}), ("normalize", {"mode": "z_score"}),
        ("crop_foreground", {}), ("resample", {"spacing": [1.0, 1.0, 1.0]}), ("resize", {"target_shape": [128, 128, 128]}),
    ],
    "alzheimer": [
        ("reorient", {"target": "RAS"}), ("skull_strip", {"strategy": "threshold"}), ("crop_foreground", {}),
        ("resample", {"spacing": [1.0, 1.0, 1.0]}), ("resize", {"target_shape": [128, 128, 128]}),
        ("normalize", {"mode": "z_score"}),
    ],
    "tumor": [
        ("reorient", {"target": "RAS"}), ("resample", {"spacing": [1.0, 1.0, 1.0]}),
        ("resize", {"target_shape": [128, 128, 128]}), ("normalize", {"mode": "min_max"}),
    ],
}


@dataclass(frozen=True)
class Volumes:
    """Volume tables passed between steps.

    ``inverse`` lists (step, per-scan parameter table) of the steps that can be undone, in order.
    """

    slabs: DataFrame
    affines: DataFrame
    mask: DataFrame | None = None
    steps: tuple = ()
    inverse: tuple = field(default=())


TRANSFORMS: dict[str, Callable[..., Volumes]] = {}


def register(name: str):
    """Add a transform ``Volumes, **params -> Volumes`` under a name."""
    def add(fn):
        TRANSFORMS[name] = fn
        return fn

    return add


def create(name: str, **params) -> Callable[[Volumes], Volumes]:
    if name not in TRANSFORMS:
        raise ValueError(f"transform {name} is not registered; available: {sorted(TRANSFORMS)}")
    return lambda vol: TRANSFORMS[name](vol, **params)


def _moved(vol: Volumes, step: str, result) -> Volumes:
    slabs, affines, params = result
    return replace(vol, slabs=slabs, affines=affines, inverse=(*vol.inverse, (step, params)))


@register("reorient")
def _reorient(vol: Volumes, target: str = "RAS") -> Volumes:
    return _moved(vol, "reorient", geometry.reorient(vol.slabs, vol.affines, target))


@register("skull_strip")
def _skull_strip(vol: Volumes, strategy: str = "threshold") -> Volumes:
    """Every strategy name uses the threshold mask, the only one there is."""
    mask = masks.head_mask(vol.slabs.where("c = 0"))
    return replace(vol, slabs=masks.apply_mask(vol.slabs, mask), mask=mask)


@register("normalize")
def _normalize(vol: Volumes, mode: str = "z_score") -> Volumes:
    return replace(vol, slabs=intensity.normalise(vol.slabs, mode))


@register("crop_foreground")
def _crop_foreground(vol: Volumes) -> Volumes:
    return _moved(vol, "crop", geometry.crop_foreground(vol.slabs, vol.affines))


@register("pad")
def _pad(vol: Volumes, target_shape, value: float = 0.0) -> Volumes:
    return _moved(vol, "pad", geometry.pad(vol.slabs, vol.affines, target_shape, value))


@register("center_crop")
def _center_crop(vol: Volumes, target_shape) -> Volumes:
    return _moved(vol, "crop", geometry.center_crop(vol.slabs, vol.affines, target_shape))


@register("resample")
def _resample(vol: Volumes, spacing) -> Volumes:
    return _moved(vol, "grid", resample.resample(vol.slabs, vol.affines, spacing))


@register("resize")
def _resize(vol: Volumes, target_shape, interpolator: str = "linear") -> Volumes:
    return _moved(vol, "grid", resample.resize(vol.slabs, vol.affines, target_shape, interpolator))


def state_hashes(vol: Volumes) -> DataFrame:
    """(scan_id, hash) of the current state: layout, spacing, affine and rounded moments."""
    text = lambda a: F.concat_ws(",", F.transform(a, lambda v: v.cast("string")))
    rows = shape_text(vol.slabs).join(volume_statistics(vol.slabs), "scan_id").join(vol.affines, "scan_id")
    spacing = M.voxel_spacing(F.col("affine"), F.lit("nifti"))
    return rows.select(
        "scan_id",
        M.state_hash(
            text(F.col("shape")), text(F.transform(spacing, lambda v: F.round(v, 9))),
            text(F.transform(F.flatten("affine"), lambda v: F.round(v, 9))), F.col("mean"), F.col("std"),
        ).alias("hash"),
    )


def provenance(before: Volumes, after: Volumes, step_no: int, step: str, params: dict) -> DataFrame:
    """History rows of one step: parameters as text, and the state before and after it."""
    cells = [F.lit(str(x)) for k in sorted(params) for x in (k, params[k])]
    shown = F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
    old = state_hashes(before).withColumnRenamed("hash", "input_hash")
    new = state_hashes(after).withColumnRenamed("hash", "output_hash")
    return old.join(new, "scan_id").select(
        "scan_id", F.lit(step_no).alias("step_no"), F.lit(step).alias("step"), shown.alias("params"),
        "input_hash", "output_hash", M.step_cache_key(F.col("input_hash"), F.lit(step), shown).alias("cache_key"),
    )


def profile(name: str, profiles: dict | None = None) -> list[tuple[str, dict]]:
    profiles = profiles or PROFILES
    if name not in profiles:
        raise ValueError(f"profile {name} is not defined; available: {sorted(profiles)}")
    return profiles[name]


def load_profiles(path: str) -> dict[str, list[tuple[str, dict]]]:
    """Profiles from YAML: ``profiles: {name: [{transform, params}]}``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        listed = (yaml.safe_load(f) or {}).get("profiles", {})
    out = {}
    for name, steps in listed.items():
        if any(not s.get("transform") for s in steps):
            raise ValueError(f"profile {name} has a step without a transform")
        out[name] = [(s["transform"], s.get("params") or {}) for s in steps]
    return out


def describe(steps: list[tuple[str, dict]]) -> str:
    return " -> ".join(["Load", *[n for n, _ in steps], "Standardize", "Volumes"])


def run_steps(
    vol: Volumes, steps: list[tuple[str, dict]], materialise: bool = True, history: bool = False,
    before: tuple = (), after: tuple = (),
) -> tuple[Volumes, list[DataFrame]]:
    """Chain transforms; returns the volumes in float32 and the history tables.

    Each step reads its input several times (statistics, then the rewrite), so with ``materialise``
    the step's result is written to the shared folder: lineage stays short and a lost executor
    repeats one step only.  ``before`` and ``after`` are hooks ``Volumes -> Volumes``.
    """
    records = []
    for hook in before:
        vol = hook(vol)
    for no, (name, params) in enumerate(steps):
        old, vol = vol, create(name, **params)(vol)
        if materialise:
            vol = replace(
                vol, slabs=materialised(vol.slabs, f"step-{name}"), affines=checkpointed(vol.affines),
                inverse=tuple((s, p if (s, p) in old.inverse else checkpointed(p)) for s, p in vol.inverse),
            )
        if history:
            records.append(provenance(old, vol, no, name, params))
    vol = replace(vol, slabs=standardised(vol.slabs), steps=(*vol.steps, *[n for n, _ in steps]))
    for hook in after:
        vol = hook(vol)
    return vol, records


def undo(vol: Volumes) -> Volumes:
    """Walk the recorded geometric steps backwards; intensity steps are not undone."""
    slabs, affines = vol.slabs, vol.affines
    for step, params in reversed(vol.inverse):
        if step == "reorient":
            back = params.select("scan_id", F.col("target").alias("codes"), F.col("codes").alias("target"))
            slabs, affines, _ = geometry.reorient(slabs, affines, current=back)
        elif step == "crop":
            slabs, affines = geometry.uncrop(slabs, affines, params)
        elif step == "pad":
            slabs, affines = geometry.unpad(slabs, affines, params)
        else:
            slabs, affines = resample.restore_grid(slabs, affines, params)
    return replace(vol, slabs=slabs, affines=affines, inverse=())


def wrong_shapes(slabs: DataFrame, shape) -> DataFrame:
    """Scans whose slices do not form exactly the expected (c, x, y, z) shape; these go to quarantine."""
    c, nx, ny, nz = shape
    ok = (F.col("n") == c * nz) & F.col("fit")
    per = slabs.groupBy("scan_id").agg(
        F.count("*").alias("n"),
        F.bool_and((F.col("nx") == nx) & (F.col("ny") == ny) & (F.col("nz") == nz) & (F.size("px") == nx * ny)).alias("fit"),
    )
    return per.where(~ok).select("scan_id", F.col("n").alias("slices"))
