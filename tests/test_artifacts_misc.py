import os
import tempfile

from pyspark.sql import functions as F

from vigil.operators import features, metrics
from vigil.sources import artifacts, files


def test_duplicate_canonical_names_keep_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`FASE 2022` int, fase int, RA int")
    out = files.canonical_columns(df, 2022)
    assert out.columns == ["FASE", "RA"] and out.first()["FASE"] == 1


def test_history_store_fallback_chain(spark):
    d = tempfile.mkdtemp(prefix="vigil-hist-")
    with open(f"{d}/h.csv", "w") as f:
        f.write("RA;YEAR;INDE\n1;2023;5.0\n")
    with open(f"{d}/nokey.csv", "w") as f:
        f.write("X;YEAR\n1;2023\n")
    assert artifacts.scan_history(spark, f"{d}/h.csv", "RA").count() == 1
    loader = lambda: spark.createDataFrame([("9", 2022)], "RA string, YEAR int")
    assert artifacts.scan_history(spark, f"{d}/nokey.csv", "RA", loader).first()["RA"] == "9"
    assert artifacts.scan_history(spark, f"{d}/missing.csv", "RA", lambda: 1 / 0) is None


def test_sinks_metrics_cv_report(spark):
    d = tempfile.mkdtemp(prefix="vigil-sink-")
    ref = spark.createDataFrame([("1", 0.3, 1)], "RA string, p double, y int")
    files.write_table(ref, f"{d}/reference", mode="overwrite")
    files.write_table(ref, f"{d}/reference", mode="overwrite")
    assert spark.read.parquet(f"{d}/reference").count() == 1
    m = artifacts.metrics_long(spark, "v1", {"f1": 0.7, "auc": None})
    artifacts.append_metrics(m, f"{d}/metrics")
    artifacts.append_metrics(artifacts.metrics_long(spark, "v2", {"f1": 0.8}), f"{d}/metrics")
    assert spark.read.parquet(f"{d}/metrics").where(F.col("metric") == "f1").count() == 2
    folds = spark.createDataFrame([(1, .8, .7, .75, .9, .5), (2, .6, .7, .65, None, .4)],
                                  "fold int, recall double, precision double, f1 double, auc double, threshold double")
    rep = artifacts.cv_report(folds, metrics.fold_summary(folds), "v1")
    assert rep.where(F.col("kind") == "fold").count() == 10 and rep.where(F.col("kind") == "summary").count() == 20
    assert artifacts.version_tag().startswith("v20")


def test_leakage_guard_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "RA int, INDE double, PEDRA string")
    out = features.drop_present(df, ["INDE", "PEDRA", "DEFASAGEM"])
    assert out.columns == ["RA"]
    filled = features.add_missing(out, ["AGE"], ["GROUP"]).first()
    assert filled["AGE"] == 0 and filled["GROUP"] == "N/A"


def test_throttled_drift_monitor_starts_and_stops(spark, small_dir):
    from vigil.plans.bindings import LOG_FEATURES, log
    from vigil.streaming import monitors
    ref = log(spark, small_dir).where(F.col("is_ref"))
    ev = monitors.event_stream(spark, small_dir).withColumn("uid", F.col("user_id").cast("double")) \
        .withColumn("k", F.get_json_object("props", "$.k").cast("double")) \
        .withColumn("prediction", (F.col("event_type") == "error").cast("int"))
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-mon-"), "history")
    q = monitors.drift_monitor(ev, ref, LOG_FEATURES, out, available_now=False, interval_seconds=5)
    try:
        q.processAllAvailable()
        assert spark.read.parquet(out).count() == 1   # first trigger fires at start; later ones every interval
    finally:
        q.stop()


def test_history_fallbacks_say_why(spark, tmp_path, caplog):
    good = spark.createDataFrame([("1", 2)], "RA string, v int")
    with caplog.at_level("WARNING", logger="vigil.sources"):
        assert artifacts.scan_history(spark, str(tmp_path / "none.csv"), "RA", lambda: good) is good
        assert artifacts.scan_history(spark, None, "RA") is None
        assert artifacts.scan_history(spark, None, "RA", lambda: 1 / 0) is None
    said = [r.getMessage() for r in caplog.records]
    assert "cannot be read" in said[0] and "cold start" in said[1] and "division" in said[2]
