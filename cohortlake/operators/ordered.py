"""Ranks, running aggregates and exact percentiles that never sort a whole group in one task.

A window over an unbounded group puts that group into one task.  Here the order
is cut into buckets first: each bucket is windowed on its own, and the totals of
the earlier buckets (one small row each) are added as a carry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import checkpointed

HASH_PREFIX = 3  # hex digits: 4,096 buckets per group


def value_edges(df: DataFrame, col: str, parts: int = 128) -> list[float]:
    """At most ``parts - 1`` approximate quantiles of ``col``: one pruned scan, sketches only, no shuffle of rows."""
    return sorted(set(df.approxQuantile(col, [i / parts for i in range(1, parts)], 0.004)))


def with_value_bucket(df: DataFrame, col: str, edges: list[float], bucket: str = "_bucket") -> DataFrame:
    """Add a range bucket over ``col``.

    The edges are literals in the plan, so every recomputation of a lost task sees the same
    buckets.  They steer balance only, not results.
    """
    if not edges:
        return df.withColumn(bucket, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=col, outputCol=bucket, handleInvalid="keep")
    return cut.transform(df).withColumn(bucket, F.col(bucket).cast("int"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    aggs: dict[str, tuple[Callable[[Column], Column], Column]],
    descending: bool = False,
    inclusive: bool = True,
    totals: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sum / max / min along ``order`` inside each ``keys`` group, in one pass.

    ``bucket`` must be monotone in ``order``.  ``aggs`` maps an output column to
    ``(F.sum | F.max | F.min, input)``; with ``inclusive=False`` the current row is left out.
    ``totals`` adds whole-group sums.  ``previous`` and ``following`` add a value of the
    neighbouring row, also across a bucket border; they need a single, distinct order column.
    Rows with a null key form a group of their own; a null order value comes first (last if descending).
    """
    keys, totals, previous, following = list(keys), totals or {}, previous or {}, following or {}
    # a struct with null fields equals another one, so null groups are kept, and all steps share one shuffle
    df, columns = df.withColumn("_at", F.struct(*keys, bucket)), df.columns
    fields = [F.col("_at")[k] for k in keys]
    way = F.desc if descending else F.asc
    first, last = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    per_bucket = df.groupBy("_at").agg(
        *[fn(c).alias(f"_t_{o}") for o, (fn, c) in aggs.items()],
        *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()],
        *[last(c, F.col(order[0])).alias(f"_t_{o}") for o, c in previous.items()],
        *[first(c, F.col(order[0])).alias(f"_t_{o}") for o, c in following.items()],
    )
    buckets = Window.partitionBy(*fields).orderBy(F.col("_at")[bucket].desc() if descending else F.col("_at")[bucket].asc())
    earlier, whole = buckets.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*fields)
    carry = per_bucket.select(
        "_at",
        *[fn(F.col(f"_t_{o}")).over(earlier).alias(f"_c_{o}") for o, (fn, _) in aggs.items()],
        *[F.sum(f"_t_{o}").over(whole).alias(f"_c_{o}") for o in totals],
        *[F.lag(f"_t_{o}").over(buckets).alias(f"_c_{o}") for o in previous],
        *[F.lead(f"_t_{o}").over(buckets).alias(f"_c_{o}") for o in following],
    )
    inside = Window.partitionBy("_at").orderBy(*[way(c) for c in order])
    here = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    merge = {
        F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        F.max: F.greatest,
        F.min: F.least,
    }
    return df.join(carry, "_at").select(
        *columns,
        *[merge[fn](F.col(f"_c_{o}"), fn(c).over(here)).alias(o) for o, (fn, c) in aggs.items()],
        *[F.col(f"_c_{o}").alias(o) for o in totals],
        *[F.coalesce(F.lag(c).over(inside), F.col(f"_c_{o}")).alias(o) for o, c in previous.items()],
        *[F.coalesce(F.lead(c).over(inside), F.col(f"_c_{o}")).alias(o) for o, c in following.items()],
    )


def seeded_hash(seed: int, ident: Column | str) -> Column:
    """Stable pseudo-random order key: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string") if isinstance(ident, str) else ident))


def hash_rank(
    df: DataFrame, keys: Sequence[str], ident: str, seed: int, out: str = "rn", total: str | None = None
) -> DataFrame:
    """1-based rank of each row inside ``keys`` by :func:`seeded_hash`; also keeps the hash as ``_h``.

    ``total`` names an extra column with the size of the group.

    Equal to ``row_number() over (partition by keys order by md5)``, computed in
    4,096 hash-prefix buckets per group so that one large class spreads over the cluster.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, ident)).withColumn(
        "_hb", F.substring("_h", 1, HASH_PREFIX)
    )
    sizes = {total: F.lit(1)} if total else None
    ranked = running(hashed, keys, "_hb", ["_h", ident], {out: (F.sum, F.lit(1))}, totals=sizes)
    return ranked.withColumn(out, F.col(out).cast("bigint")).drop("_hb")


def sorted_rank(df: DataFrame, order: Sequence[str], out: str = "rn") -> DataFrame:
    """1-based global rank by any sortable columns.

    Range-sort, number rows inside each partition, then add the sizes of the earlier
    partitions.  The sorted rows are checkpointed because range edges come from sampling.
    """
    numbered = checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.select(*df.columns, part.alias("_p"), row.alias("_r"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_p").agg(F.count("*").alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return numbered.join(offsets, "_p").select(
        *df.columns, (F.col("_before") + F.col("_r") + 1).alias(out)
    )


def group_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, one column per entry of ``probs``.

    Values are counted before any shuffle, so a huge group costs only its distinct
    values, and those are ranked in range buckets rather than in one task.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running(
        with_value_bucket(counts, value, value_edges(df, value)), keys, "_bucket", [value], {"_upto": (F.sum, F.col("_n"))}
    )
    totals = df.groupBy(*keys).agg(F.count(value).alias("_total"))
    located = ranked.join(totals, keys)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_fr_{name}"),
        ]
    found = located.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
            for n in probs
        ],
    )
