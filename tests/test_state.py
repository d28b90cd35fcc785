"""Stateful sinks and streams: a second run goes on where the first one stopped."""

from pyspark.sql import functions as F

from cohortlake.operators.runs import COMPARISON_COLUMNS
from cohortlake.sources import sinks
from cohortlake.streaming import incremental


def arrivals(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return incremental.stream_table(spark, folder)


def test_ingest_goes_on(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda rows: sorted(
        r.c for r in incremental.ingest_new(arrivals(spark, folder, rows, "c string"), F.col("c").cast("binary"), path, ["c"]).collect()
    )
    assert run([("a",), ("b",), ("a",)]) == ["a", "b"]
    assert run([("b",), ("c",)]) == ["a", "b", "c"]
    assert run([("a",)]) == ["a", "b", "c"]


def test_balance_goes_on(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda rows: dict(incremental.running_balance(arrivals(spark, folder, rows, "k string"), "k", path).collect())
    assert run([("a",), ("b",), ("a",)]) == {"a": 2, "b": 1}
    assert run([("c",), ("a",)]) == {"a": 3, "b": 1, "c": 1}


def test_monitor_goes_on_and_places_late_epochs(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schema = "run bigint, epoch bigint, metric double"
    run = lambda rows: dict(incremental.early_stop_monitor(arrivals(spark, folder, rows, schema), 2, path=path).collect())
    assert run([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 1.0)]) == {1: None, 2: None}
    assert run([(1, 3, 7.0), (2, 3, 2.0), (2, 4, 3.0)]) == {1: 3, 2: 4}
    assert run([(2, 2, 0.5)]) == {1: 3, 2: 4}  # late: the wait now starts at epoch 2
    assert run([(1, 0, 1.0)]) == {1: 2, 2: 4}  # late: nothing after epoch 0 is better
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_comparison_table_opens_again(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *names: spark.createDataFrame([(n, "x") for n in names], f"Experiment string, {COMPARISON_COLUMNS[1]} string")
    sinks.ComparisonTable(spark, path).upsert(rows("a", "b"))
    (tmp_path / "t" / "v2").mkdir()  # a write that failed
    sinks.ComparisonTable(spark, path).upsert(rows("b", "c"))
    again = sinks.ComparisonTable(spark, path)
    assert again.version == 3 and sorted(r.Experiment for r in again.read().collect()) == ["a", "b", "c"]


def test_volume_sink_reruns(spark, tmp_path):
    path = str(tmp_path / "v")
    slabs = spark.createDataFrame([(s, 0, z, 1, 1, 3, [1.0]) for s in range(6) for z in range(3)],
                                  "scan_id long, c int, z int, nx int, ny int, nz int, px array<float>")
    count = lambda version: spark.read.parquet(path).where(F.col("cache_version") == version).count()
    sinks.write_volumes(slabs, path, "v1")
    sinks.write_volumes(slabs, path, "v1")
    sinks.write_volumes(slabs, path, "v2")
    assert (count("v1"), count("v2")) == (18, 18)
    sinks.write_volumes(slabs.where("scan_id < 2"), path, "v1", clear=True)
    assert (count("v1"), count("v2")) == (6, 18)
