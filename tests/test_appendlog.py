"""Appends that may be repeated, attempts that fail, compaction, and the windowed drift state."""

import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import drift
from vigil.sources import appendlog as log
from vigil.streaming import monitors

SCHEMA = "a long, b string"


def _rows(spark, ids):
    return spark.createDataFrame([(i, f"x{i}") for i in ids], SCHEMA)


def _ids(spark, path):
    return sorted(r["a"] for r in log.read(spark, path, SCHEMA).collect())


def test_append_is_idempotent_and_reads_only_committed_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    assert _ids(spark, path) == [] and log.runs(spark, path) == []
    assert log.append(_rows(spark, [1, 2]), path, "r1")
    log._write(_rows(spark, [8, 9]), path, "r2")  # died before its manifest
    assert _ids(spark, path) == [1, 2]
    assert log.append(_rows(spark, [3, 3]), path, "r2") and not log.append(_rows(spark, [3, 3]), path, "r2")
    assert log.append(_rows(spark, []), path, "empty")
    assert _ids(spark, path) == [1, 2, 3, 3]
    assert [(r.run, r.rows) for r in log.runs(spark, path)] == [("empty", 0), ("r1", 2), ("r2", 2)]
    for bad in ("", "../x", "_x", "a/b"):
        with pytest.raises(ValueError):
            log.append(_rows(spark, [1]), path, bad)


def test_the_first_manifest_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    a, b = (log._write(_rows(spark, [i]), path, "r") for i in (1, 2))
    assert log._commit(spark, path, log.Run("r", *a)) and not log._commit(spark, path, log.Run("r", *b))
    assert _ids(spark, path) == [1]


def test_compaction_replaces_and_vacuum_deletes(spark, tmp_path):
    path = str(tmp_path / "log")
    assert not log.compact(spark, path, SCHEMA)
    for i in range(4):
        log.append(_rows(spark, [i, 10 + i]), path, f"r{i}")
    log._write(_rows(spark, [99]), path, "lost")
    assert log.compact(spark, path, SCHEMA) and not log.compact(spark, path, SCHEMA)
    assert _ids(spark, path) == [0, 1, 2, 3, 10, 11, 12, 13] and len(log.runs(spark, path)) == 1
    assert log.append(_rows(spark, [50]), path, "r9") and not log.append(_rows(spark, [0, 10]), path, "r0")
    assert log.vacuum(spark, path) == 5 and len(os.listdir(f"{path}/runs")) == 2
    assert _ids(spark, path) == [0, 1, 2, 3, 10, 11, 12, 13, 50]


def test_compaction_writes_files_by_the_bytes_of_the_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        log.append(spark.range(i, 4000, 2).selectExpr("id AS a", "sha2(CAST(id AS STRING), 256) AS b"), path, f"r{i}")
    assert log.compact(spark, path, SCHEMA, file_bytes=32 << 10)
    (run,) = log.runs(spark, path)
    sizes = [os.path.getsize(f"{path}/{run.folder}/{f}") for f in os.listdir(f"{path}/{run.folder}") if f.endswith(".parquet")]
    assert len(sizes) > 4 and max(sizes) < 2 * (32 << 10)
    assert _ids(spark, path) == list(range(4000))


def test_windowed_drift_equals_the_batch_trend(spark, tmp_path):
    """Rows of one window arrive in several micro-batches, late ones within the watermark included."""
    rows = [(f"2024-01-{1 + i % 3:02d} {i % 24:02d}:00:00", float(i % 13), int(i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, x double, prediction int").select(F.col("t").cast("timestamp").alias("ts"), "x", "prediction")
    ref = spark.createDataFrame([(float(i % 11),) for i in range(100)], "x double")
    for i in range(3):
        df.where(F.pmod(F.hash("ts", "x"), F.lit(3)) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*")).withWatermark("ts", "10 days")
    model = drift.psi_fit(ref, ["x"])
    q, trend = monitors.windowed_drift(stream, model)
    monitors.await_all(q)
    got = {r["bucket_start"]: (r["n"], r["high_risk_rate"], r["avg_psi"]) for r in trend().collect()}
    day = df.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    p = drift.drift_summary(drift.psi_table(ref, day, ["x"], group_cols=["day"], model=model), "day")
    rate = drift.positive_rate(day, "prediction", group_cols=["day"])
    n = day.groupBy("day").count()
    want = {r["day"]: (r["count"], r["rate"], r["avg_psi"]) for r in p.join(rate, "day").join(n, "day").collect()}
    assert got == want and len(got) == 3
