"""Structured Streaming: ingest only unseen content, keep balances current, watch runs for early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.runs import early_stop
from cohortlake.session import delete, file_exists, file_system, fresh_path


def stream_table(spark: SparkSession, folder: str, name: str = "", files: int = 1000) -> DataFrame:
    """Stream over ``<folder>/<name>*.parquet`` with the schema of the files already there, ``files`` at a time."""
    one = f"{folder}/{name}.parquet" if name else folder
    reader = spark.readStream.schema(spark.read.parquet(one).schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def _drain(writer, path: str):
    """Run everything available, then stop.  Offsets and state belong to the output path, so a later run goes on from here."""
    query = writer.option("checkpointLocation", f"{path.rstrip('/')}/_offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_new(stream: DataFrame, content: Column, path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Append unseen content to a parquet table and return all its fingerprints.

    Each trigger drops repeats inside itself and whatever the table already holds, and writes one batch
    folder.  A batch that is tried again replaces its own folder and is compared with the others only.
    Nothing is kept in memory between triggers, and content is known for good, however old it is.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "ingest")
    rows = stream.select(F.sha2(content, 256).alias("fingerprint"), *keep)
    schema = ", ".join([f"{c} {t}" for c, t in rows.dtypes] + ["batch bigint"])

    def publish(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["fingerprint"])
        if batch_id:
            known = batch.sparkSession.read.schema(schema).parquet(path).where(F.col("batch") != batch_id)
            fresh = fresh.join(known.select("fingerprint"), "fingerprint", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _drain(rows.writeStream.foreachBatch(publish), path)
    return spark.read.schema(schema).parquet(path).drop("batch")


def running_balance(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Rows per class so far, over all runs on ``path``.  Each trigger writes the (few) class counts to a new batch folder."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "balance")
    counts = stream.groupBy(label).agg(F.count("*").alias("n"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _drain(counts.writeStream.outputMode("complete").foreachBatch(publish), path)
    seen = spark.read.schema(f"{label} {dict(stream.dtypes)[label]}, n bigint, batch bigint").parquet(path)
    return seen.groupBy(label).agg(F.max_by("n", "batch").alias("n"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Last batches that the stored answers cover, one per version whose write was completed."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [n for n in names if n.startswith("upto=") and file_exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(int(n.removeprefix("upto=")) for n in whole)


def early_stop_monitor(
    stream: DataFrame, patience: int, min_delta: float = 0.0, path: str | None = None
) -> DataFrame:
    """(run, stop_epoch) after the input available so far, over all runs on ``path``; null while a run may go on.

    Each trigger appends its epochs to a table and keeps no state, so epochs may arrive in any order and however late.
    Afterwards the runs that got new epochs are worked out anew by :func:`runs.early_stop` over the table, which cuts
    a run into slices; the answers of all others are taken over from the version before.  A batch
    that is tried again replaces its own folder, and a version counts once its write is complete.
    """
    spark = stream.sparkSession
    path = (path or fresh_path(spark, "monitor")).rstrip("/")
    scores, answers = f"{path}/scores", f"{path}/answers"
    rows = stream.select("run", F.col("epoch").cast("bigint").alias("epoch"), F.col("metric").cast("double").alias("metric"))
    kind = dict(rows.dtypes)["run"]

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scores}/batch={batch_id}")

    _drain(rows.writeStream.foreachBatch(publish), path)
    answer = f"run {kind}, stop_epoch bigint"
    if not file_exists(spark, scores):
        return spark.createDataFrame([], answer)
    seen = spark.read.schema(f"run {kind}, epoch bigint, metric double, batch bigint").parquet(scores)
    done = _versions(spark, answers)
    upto, last = done[-1] if done else -1, seen.agg(F.max("batch")).first()[0]
    known = spark.read.schema(answer).parquet(f"{answers}/upto={upto}") if done else None
    if last is None or last == upto:
        return known if known is not None else spark.createDataFrame([], answer)
    touched = seen.where(F.col("batch") > upto).select("run").distinct()
    mine = seen.join(touched, "run", "left_semi").select("run", "epoch", "metric")
    # a run without a score so far has no answer yet
    now = touched.join(early_stop(mine, "run", "epoch", "metric", patience, min_delta), "run", "left").select("run", "stop_epoch")
    if known is not None:
        now = now.unionByName(known.join(touched, "run", "left_anti").select("run", "stop_epoch"))
    now.write.mode("overwrite").parquet(f"{answers}/upto={last}")
    for old in done[:-1]:
        delete(spark, f"{answers}/upto={old}")
    return spark.read.schema(answer).parquet(f"{answers}/upto={last}")
