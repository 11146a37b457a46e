"""The model version in force at each row's time, in batch and in a stream."""

import pytest
from pyspark.sql import functions as F

from vigil.sources import registry


def _registry(spark):
    rows = [("v1", 10, 0.4, "f1"), ("v2", 20, None, "cost"), ("v2b", 20, 0.6, None), ("v3", 30, 0.7, "recall"), ("lost", None, 0.1, "f1")]
    return spark.createDataFrame(rows, "version string, valid_from int, risk_threshold double, strategy string")


def _brute(t):
    if t is None or t < 10:
        return "unknown", 0.5072, "n/d"
    return ("v1", 0.4, "f1") if t < 20 else ("v2b", 0.6, "n/d") if t < 30 else ("v3", 0.7, "recall")


def test_in_force_by_time(spark):
    times = [None, 0, 9, 10, 11, 19, 20, 29, 30, 1000, 20]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, at int")
    got = {r["id"]: (r["model_version"], r["risk_threshold"], r["threshold_strategy"]) for r in registry.in_force(rows, "at", _registry(spark)).collect()}
    assert got == {i: _brute(t) for i, t in enumerate(times)}


def test_empty_registry_and_missing_columns(spark):
    rows = spark.createDataFrame([(1, 15)], "id int, at int")
    none = _registry(spark).limit(0)
    assert registry.in_force(rows, "at", none).first()["model_version"] == "unknown"
    slim = _registry(spark).select("version", "valid_from")
    r = registry.in_force(rows, "at", slim, threshold=0.3).first()
    assert (r["model_version"], r["risk_threshold"], r["threshold_strategy"]) == ("v1", 0.3, "n/d")


def test_too_many_versions_are_refused(spark, monkeypatch):
    monkeypatch.setattr(registry, "MAX_VERSIONS", 2)
    with pytest.raises(ValueError):
        registry.in_force(spark.createDataFrame([(1, 15)], "id int, at int"), "at", _registry(spark))


def test_stream_static_join(spark, tmp_path):
    rows = spark.range(40).select(F.col("id"), F.col("id").cast("int").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = (registry.in_force(stream, "at", _registry(spark)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["id"]: (r["model_version"], r["risk_threshold"], r["threshold_strategy"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: _brute(i) for i in range(40)}
