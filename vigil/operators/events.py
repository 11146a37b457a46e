"""Metric event rows: one table per event type, each with the common columns
``model_version, window_timestamp, environment, service_name``.

Numbers that are missing become 0, texts ``n/d``, flags false, so that a row is
always complete for the sink (a partitioned append, see ``files.write_table``).
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.clean import to_number

# fixed values of the reference events
MISSING_TEXT = "n/d"
MAX_IMPORTANCE_EVENTS = 20
THRESHOLD_ALIASES = {
    "strategy": ["strategy", "name", "metodo"],
    "recall": ["recall"],
    "f1_score": ["f1_score", "f1"],
    "threshold": ["threshold"],
    "high_risk_estimated": ["high_risk_estimated", "alto_risco_estimado"],
    "human_reviews": ["human_reviews", "revisoes_humanas"],
}


def number(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(default))


def count(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(0).cast("long"))


def text(c: Column | str) -> Column:
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(s) > 0, s).otherwise(F.lit(MISSING_TEXT))


def common(model_version: str, window_timestamp: Column, environment: str, service_name: str) -> list[Column]:
    return [F.lit(model_version).alias("model_version"), window_timestamp.alias("window_timestamp"),
            F.lit(environment).alias("environment"), F.lit(service_name).alias("service_name")]


def psi_events(psi_tbl: DataFrame, shared: list[Column]) -> DataFrame:
    """One row per feature of a PSI table."""
    return psi_tbl.select(*shared, text("feature").alias("feature"),
                          *[number(c).alias(c) for c in ("psi", "reference_mean", "current_mean", "delta_mean")],
                          text("direction").alias("direction"), F.coalesce("drift_flag", F.lit(False)).alias("drift_flag"))


def performance_event(one: DataFrame, shared: list[Column], names: Mapping[str, str] | None = None) -> DataFrame:
    """One row from a one-row metrics table; ``names`` maps event column -> its column there."""
    names = names or {}
    src = lambda c: F.col(names.get(c, c)) if names.get(c, c) in one.columns else F.lit(None)
    numbers = ("recall", "precision", "f1_score", "auc", "brier_score", "risk_threshold", "overfitting_gap_f1")
    return one.select(*shared, *[number(src(c)).alias(c) for c in numbers], text(src("threshold_strategy")).alias("threshold_strategy"),
                      *[count(src(c)).alias(c) for c in ("train_size", "test_size")])


def threshold_rows(df: DataFrame, payload: str) -> DataFrame:
    """Strategy rows of a JSON text column, in any of the accepted shapes: a list of
    rows, a record with the list under ``strategies`` or ``rows``, or one row.
    Text that is none of these gives no row; names come by ``THRESHOLD_ALIASES``."""
    p = F.col(payload)
    record = "map<string,string>"
    inner = F.coalesce(*[F.get_json_object(p, f"$.{k}") for k in ("strategies", "rows")])
    body = F.coalesce(F.when(F.trim(inner).startswith("["), inner), p)
    many = F.from_json(body, f"array<{record}>")
    one = F.from_json(p, record)
    rows = F.when(F.trim(body).startswith("["), many).when(F.trim(p).startswith("{") & (F.size(one) > 0), F.array(one))
    flat = df.select(F.explode(F.filter(rows, lambda r: r.isNotNull() & (F.size(r) > 0))).alias("_r"))
    value = lambda names: F.coalesce(*[F.try_element_at("_r", F.lit(n)) for n in names])
    return flat.select(text(value(THRESHOLD_ALIASES["strategy"])).alias("strategy"),
                       *[number(to_number(value(v))).alias(k) for k, v in THRESHOLD_ALIASES.items() if k != "strategy"])


def threshold_events(rows: DataFrame, active: str | Column, shared: list[Column]) -> DataFrame:
    """One row per strategy; ``is_active`` where it is the trained one."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    f1 = has("f1_score") if "f1_score" in rows.columns else has("f1")
    return rows.select(*shared, text("strategy").alias("strategy"),
                       (text("strategy") == (F.lit(active) if isinstance(active, str) else active)).alias("is_active"),
                       number(has("recall")).alias("recall"), number(f1).alias("f1_score"),
                       *[number(has(c)).alias(c) for c in ("threshold", "high_risk_estimated", "human_reviews")])


def fairness_events(groups: DataFrame, dimension: str, shared: list[Column]) -> DataFrame:
    """One row per value of the sensitive dimension of a group-metrics table; other dimensions are left out."""
    return groups.where(F.col("dimension") == dimension).select(
        *shared, F.col("dimension").alias("group_column"), F.col("value").alias("group_value"),
        number("recall").alias("recall"), number("precision").alias("precision"), number("f1").alias("f1_score"),
        count("support").alias("support"))


def importance_events(ranking: DataFrame, shared: list[Column], top: int = MAX_IMPORTANCE_EVENTS) -> DataFrame:
    """The ``top`` features of ``ranking(feature, importance)`` with their rank."""
    w = Window.orderBy(F.col("importance").desc_nulls_last(), F.col("feature"))  # one row per feature
    return (ranking.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
            .select(*shared, text("feature").alias("feature"), number("importance").alias("importance"), "rank"))
