"""Metric event streams: the report tables as complete event rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators import curve, events, temporal
from vigil.operators.ordered import scalar
from vigil.plans import q_log, q_scored
from vigil.plans.bindings import LOG_SQL, SCORED_SQL, VERSIONS_LOG_SQL, log, scored, versions_log, with_ctes
from vigil.plans.registry import ORACLES, query
from vigil.sources import registry

ENV = (q_log.ENVIRONMENT_DEFAULT, q_log.SERVICE_NAME)
VERSION_SQL = f"(WITH {LOG_SQL.strip()},{VERSIONS_LOG_SQL.strip()} SELECT max_by(version, valid_from) FROM versions WHERE valid_from <= (SELECT max(ts) FROM log))"
COMMON_SQL = f"{VERSION_SQL} AS model_version, (SELECT max(ts) FROM events) AS window_timestamp, '{ENV[0]}' AS environment, '{ENV[1]}' AS service_name"


def _common(spark, d):
    """The columns of every event; the version is the one in force at the log's last row."""
    last = log(spark, d).agg(F.max("ts").alias("at"))
    version = registry.in_force(last, "at", versions_log(spark, d)).select("model_version").scalar()
    return events.common(version, scalar(log(spark, d), F.max("ts")), *ENV)


def _from(key: str) -> str:
    return f"FROM ({ORACLES[key]})"


@query("event_psi_feature", f"""SELECT {COMMON_SQL}, feature, coalesce(psi, 0.0) AS psi, coalesce(reference_mean, 0.0) AS reference_mean,
       coalesce(current_mean, 0.0) AS current_mean, coalesce(delta_mean, 0.0) AS delta_mean, direction, drift_flag
{_from("psi_by_feature")}""")
def event_psi_feature(spark, d):
    return events.psi_events(q_log.psi_by_feature(spark, d), _common(spark, d))


def _one(key: str, column: str, where: str = "true") -> str:
    return f"(SELECT {column} {_from(key)} WHERE {where})"


def _size(role: str) -> str:
    return f"({with_ctes(SCORED_SQL, q_scored.SPLIT_SQL)} SELECT count(*) FROM split WHERE role = '{role}')"


@query("event_performance", f"""SELECT {COMMON_SQL}, recall, precision, f1 AS f1_score, {_one("roc_auc", "auc", "dataset = 'scored'")} AS auc,
       {_one("brier_score", "brier")} AS brier_score, {_one("threshold_strategies", "threshold", "is_active")} AS risk_threshold,
       {_one("overfit_gap", "overfit_gap_f1")} AS overfitting_gap_f1, {_one("threshold_strategies", "strategy", "is_active")} AS threshold_strategy,
       {_size("train")} AS train_size, {_size("test")} AS test_size
{_from("classification_metrics")}""")
def event_performance(spark, d):
    """One row joined from the metric tables: AUC, Brier score, the active strategy's threshold, the overfit gap, sizes."""
    s = scored(spark, d)
    sizes = temporal.temporal_split(s, "period").agg(F.count_if(F.col("role") == "train").alias("train_size"), F.count_if(F.col("role") == "test").alias("test_size"))
    active = q_scored.threshold_strategies(spark, d).where("is_active").select(F.col("threshold").alias("risk_threshold"), F.col("strategy").alias("threshold_strategy"))
    one = (q_scored.classification_metrics(spark, d).select("recall", "precision", F.col("f1").alias("f1_score"))
           .crossJoin(curve.roc_auc(s, "y", "p").select(rnd("auc", 6).alias("auc"))).crossJoin(q_scored.brier_score(spark, d).withColumnRenamed("brier", "brier_score"))
           .crossJoin(active).crossJoin(q_scored.overfit_gap(spark, d).select(F.col("overfit_gap_f1").alias("overfitting_gap_f1"))).crossJoin(sizes))
    return events.performance_event(one, _common(spark, d))


@query("event_threshold_strategy", f"""SELECT {COMMON_SQL}, strategy, is_active, recall, f1 AS f1_score, threshold,
       CAST((SELECT count(*) FROM (SELECT o_totalprice / 500000.0 AS p FROM orders) WHERE p >= threshold) AS DOUBLE) AS high_risk_estimated,
       CAST((SELECT count(*) FROM (SELECT o_totalprice / 500000.0 AS p FROM orders) WHERE abs(p - threshold) <= {curve.REVIEW_MARGIN}) AS DOUBLE) AS human_reviews
{_from("threshold_strategies")}""")
def event_threshold_strategy(spark, d):
    rows = curve.threshold_report(scored(spark, d), "y", "p", "grp").withColumns({c: rnd(c, 4) for c in ("recall", "f1")})
    active = F.when(F.col("is_active"), F.col("strategy"))
    return events.threshold_events(rows, active, _common(spark, d)).withColumn("is_active", F.coalesce("is_active", F.lit(False)))


@query("event_fairness_group", f"""SELECT {COMMON_SQL}, dimension AS group_column, value AS group_value, recall, precision, f1 AS f1_score,
       CAST(support AS BIGINT) AS support
{_from("group_metrics")} WHERE dimension = 'grp'""")
def event_fairness_group(spark, d):
    return events.fairness_events(q_scored.group_metrics(spark, d), "grp", _common(spark, d))


@query("event_feature_importance", f"""SELECT {COMMON_SQL}, feature, importance, CAST(rank AS BIGINT) AS rank
{_from("importance_ranking")}""")
def event_feature_importance(spark, d):
    return events.importance_events(q_scored.importance_ranking(spark, d).select("feature", "importance"), _common(spark, d))
