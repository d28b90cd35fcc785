"""Pieces that several corpus operators share: storage, balanced numbering, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.session import fresh_path, materialised

#: Rows that one numbering bucket should hold; the number of buckets follows the table.
BUCKET_ROWS = 20_000
#: Bytes of the rows that Spark hands to a Python worker at once.
BATCH = 1 << 23
#: Edges that one task shrinks to stars; the number of tasks follows the graph.
TASK_EDGES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; what later steps read survives lost executors."""
    return materialised(df, name)


def released(*frames: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so when the driver collects garbage.

    Memory that the driver's Python has freed goes back to the system too, where the C library can do that.
    """
    gc.collect()
    trimmed()
    spark.sparkContext._jvm.System.gc()


def trimmed() -> None:
    """Give memory that this process has freed back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold ``BATCH`` bytes at most, or one row, from now on; a limit that the session has been given stays.

    Spark counts 10,000 rows, which are tens of megabytes of whole texts, and holds each batch in the JVM and in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, f"{BATCH}b")


Batches = Iterator[pa.RecordBatch]


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` for ``mapInArrow``, whose worker gives freed memory back after every batch and at its end.

    Workers outlive their tasks: what the allocators keep of the largest batch stays with each of them while
    later stages fill the executor's heap.
    """

    def handed(batches: Batches) -> Batches:
        for batch in batches:
            yield batch
            trimmed()

    @wraps(work)
    def run(batches: Batches) -> Batches:
        try:
            yield from work(handed(batches))
        finally:
            trimmed()

    return run


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets_for(rows: int, per: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // per))


def numbered(df: DataFrame, keys: Sequence[str], ident: Sequence[str], buckets: int, out: str) -> DataFrame:
    """Add a gapless 0-based number within ``keys``, in no meaningful order but the same on every run.

    Rows of a key are spread over ``buckets`` by a hash of ``ident``; each bucket is numbered on its
    own and the sizes of the earlier buckets are added.  So a key that holds most rows is never
    sorted in one task.  Null keys form a group of their own.
    """
    keys = list(keys)
    cut = df.withColumn("_nb", F.pmod(F.xxhash64(*ident), F.lit(buckets)))
    sizes = cut.groupBy(*keys, "_nb").agg(F.count("*").alias("_nc"))
    before = Window.partitionBy(*keys).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        F.col("_nb").alias("_s_nb"),
        F.coalesce(F.sum("_nc").over(before), F.lit(0)).alias("_ns"),
    )
    same = F.col("_nb") == F.col("_s_nb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    inside = Window.partitionBy(*keys, "_nb").orderBy(*ident)
    ranked = cut.withColumn("_nr", F.row_number().over(inside))
    return ranked.join(starts, same).select(
        *df.columns, (F.col("_ns") + F.col("_nr") - 1).cast("long").alias(out)
    )


def _forest(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: the edges seen, as stars of their local components (union-find on one partition)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in pairs:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    rows = [(x, root(x)) for x in list(parent)]
    rows = [(x, r) for x, r in rows if x != r]
    if rows:
        yield pd.DataFrame(rows, columns=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (u long, v long): one row (node, label), label the smallest node.

    Every task first shrinks its ``TASK_EDGES`` edges to stars.  As long as several tasks hold parts of the
    graph, large-star and small-star steps alternate until all that is left are stars; each step is a
    grouped minimum and a join, and its result is written to the shared folder.  Nodes without a proper
    edge are absent from the result.
    """
    spark = edges.sparkSession

    def unfinished(df: DataFrame) -> bool:
        """Whether some node has two parents, or is a parent and a child."""
        ends = df.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            df.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()

    def star(df: DataFrame, both: bool) -> DataFrame:
        near = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else df
        low = near.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        low = low.select("c", F.least("c", "m").alias("m"))
        met = near.join(low, F.col("u") == F.col("c"))
        if both:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        return out.where("u > v")

    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    oriented = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )

    def shrunk(df: DataFrame) -> tuple[DataFrame, int]:
        """Stars of what each task holds, and how many tasks there were."""
        tasks = buckets_for(df.count(), TASK_EDGES)
        return stored(df.coalesce(tasks).mapInPandas(_forest, "u long, v long"), "edges"), min(tasks, df.rdd.getNumPartitions())

    given = stored(oriented, "edges")
    now, tasks = shrunk(given)
    released(given)
    while tasks > 1 and unfinished(now):
        then = stored(star(star(now, True), False).distinct(), "edges")
        released(now)
        now, tasks = shrunk(then)
        released(then)
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("label"))


__all__ = ["buckets_for", "components", "fresh_path", "lean", "numbered", "released", "small_batches", "stored", "table", "tidy", "trimmed", "unused"]
