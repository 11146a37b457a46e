"""Seeded splits, bootstrap, Spark ML training and calibration, prediction-log
rows and the streaming twins.  Those without an exact SQL oracle are checked by
row counts in the driver and by invariants in tests/."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions import decision as dec
from vigil.functions.numeric import rnd
from vigil.operators import drift, metrics, ml, split, training
from vigil.plans.bindings import LOG_FEATURES, SCORED_SQL, log, panel, scored, with_ctes
from vigil.plans.q_log import HISTORY, TREND_SQL
from vigil.plans.registry import query
from vigil.session import run_folder
from vigil.sources import appendlog
from vigil.streaming import monitors

T = dec.DEFAULT_THRESHOLD


@query("hash_split")
def hash_split(spark, d):
    return split.hash_split(scored(spark, d), "id").select("id", "role")


@query("stratified_split")
def stratified_split(spark, d):
    return split.stratified_split(scored(spark, d), "y", "id").select("id", "y", "role")


@query("stratified_counts", with_ctes(SCORED_SQL, "c AS (SELECT y, count(*) AS n FROM scored GROUP BY y)") + """
SELECT y, 'train' AS role, CAST(floor(n * 0.8) AS BIGINT) AS n FROM c
UNION ALL SELECT y, 'test', CAST(n - floor(n * 0.8) AS BIGINT) FROM c""")
def stratified_counts(spark, d):
    """Rows of each class on each side of the exact stratified split."""
    return split.stratified_split(scored(spark, d), "y", "id").groupBy("y", "role").agg(F.count(F.lit(1)).alias("n"))


@query("bootstrap_f1")
def bootstrap_f1(spark, d):
    return metrics.bootstrap_f1(scored(spark, d), "y", metrics.predicted("p", T), "grp")


TRAIN_SPEC = {"key": "entity_id", "period": "period", "label_gap": None, "label_index": "idx",
              "lag_cols": ["idx", "act"], "leak_cols": ["idx", "bal"], "start": "start_period", "age": "age",
              "group": "grp_class", "code": "code"}


@query("train_eval")
def train_eval(spark, d):
    p = panel(spark, d).withColumn("grp_class", F.col("grp")).withColumn("code", F.col("grp"))
    out, _ = training.train_and_evaluate(p, TRAIN_SPEC)
    return out


@query("calibration_choice")
def calibration_choice(spark, d):
    s = scored(spark, d)
    cands = ml.calibration_candidates(s, "y", "p", "id")
    stats = s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).first()
    return ml.choose_calibration(cands, int(stats["n"]), int(stats["k"]))


MODEL_VERSION = "v0"


@query("prediction_log_rows")
def prediction_log_rows(spark, d):
    """Append-ready prediction log records (id, correlation id, timestamp,
    version, nested features and result) for every scored order."""
    s = scored(spark, d)
    pred = dec.decision("p", T)
    return s.select(
        F.expr("uuid()").alias("prediction_id"), F.expr("uuid()").alias("correlation_id"),
        F.current_timestamp().alias("timestamp"), F.lit(MODEL_VERSION).alias("model_version"),
        F.struct(F.col("id").alias("id"), F.col("period").alias("period"), F.col("grp").alias("group"))
         .alias("input_features"),
        F.struct(pred.alias("class"), rnd("p", 4).alias("probability"),
                 dec.risk_label(pred).alias("label")).alias("prediction_result"))


@query("stream_timeseries", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, round(avg(value), 6) AS avg_value, count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def stream_timeseries(spark, d):
    q, read = monitors.run_latest(monitors.windowed_timeseries(monitors.event_stream(spark, d)), "timeseries", ["bucket_start"])
    monitors.await_all(q)
    return read().withColumn("avg_value", rnd("avg_value", 6))


@query("stream_error_rate", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, count(*) AS n,
       round(100.0 * avg(CASE WHEN event_type = 'error' THEN 1.0 WHEN event_type IS NOT NULL THEN 0.0 END), 6) AS error_pct
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def stream_error_rate(spark, d):
    q, read = monitors.run_latest(monitors.windowed_error_rate(monitors.event_stream(spark, d)), "error_rate", ["bucket_start"])
    monitors.await_all(q)
    return read().withColumn("error_pct", rnd("error_pct", 6))


@query("stream_latest", """
SELECT host, value AS latest_value, event_type AS latest_type, ts AS latest_ts
FROM (SELECT user_id % 10 AS host, value, event_type, ts,
             row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts IS NOT NULL)
WHERE r = 1""")
def stream_latest(spark, d):
    q, read = monitors.run_latest(monitors.latest_per_facet(monitors.event_stream(spark, d)), "latest", ["host"])
    monitors.await_all(q)
    return read()


LOG_SCHEMA = ("id bigint, model_version string, input_features struct<period:int,`group`:string>, "
              "prediction_result struct<class:int,probability:double,label:string>")


@query("prediction_log_append", with_ctes(SCORED_SQL) + f"""
SELECT period, 'v' || CAST(period AS VARCHAR) AS model_version, count(*) AS n, CAST(sum(CAST(p >= {T!r} AS INTEGER)) AS BIGINT) AS positives,
       round(sum(round(p, 4)), 2) AS probability
FROM scored GROUP BY 1, 2""")
def prediction_log_append(spark, d):
    """The prediction log, appended one half after the other: the second after an attempt that left rows without a
    commit, and once more as a retry that must add nothing; then compacted and read back."""
    s = scored(spark, d)
    pred = dec.decision("p", T)
    records = s.select("id", F.concat(F.lit("v"), F.col("period").cast("string")).alias("model_version"),
                       F.struct(F.col("period"), F.col("grp").alias("group")).alias("input_features"),
                       F.struct(pred.alias("class"), rnd("p", 4).alias("probability"), dec.risk_label(pred).alias("label")).alias("prediction_result"))
    path = f"{run_folder(spark)}/prediction-log-{uuid.uuid4().hex}"
    half = F.col("id") % 2 == 0
    appendlog.append(records.where(half), path, "even")
    appendlog._write(records.where(~half), path, "odd")  # an attempt that died before its commit
    appendlog.append(records.where(~half), path, "odd")
    appendlog.append(records.where(~half), path, "odd")  # a retry
    appendlog.compact(spark, path, LOG_SCHEMA)
    r = F.col("prediction_result")
    return (appendlog.read(spark, path, LOG_SCHEMA).groupBy(F.col("input_features.period").alias("period"), "model_version")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(r["class"].cast("long")).alias("positives"), rnd(F.sum(r["probability"]), 2).alias("probability")))


@query("stream_drift", HISTORY + TREND_SQL + " SELECT hr.day AS bucket_start, hr.n, hr.high_risk_rate, hs.avg_psi FROM hr JOIN hs ON hs.day = hr.day")
def stream_drift(spark, d):
    """The drift trend per day of the current log, from bin counts that a stream keeps per window."""
    ref = log(spark, d).where(F.col("is_ref"))
    ev = monitors.event_stream(spark, d).where(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp"))
    features = ev.withColumn("uid", F.col("user_id").cast("double")) \
        .withColumn("k", F.get_json_object("props", "$.k").cast("double")) \
        .withColumn("prediction", (F.col("event_type") == "error").cast("int"))
    q, trend = monitors.windowed_drift(features, drift.psi_fit(ref, LOG_FEATURES))
    monitors.await_all(q)
    return trend()
