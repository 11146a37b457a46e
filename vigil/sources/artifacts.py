"""Training and monitoring artifacts as tables: one-row statistics, long
metric tables, the CV report, versioned models with a pointer table, and
the history store with its fallback chain.

Artifacts are written with Spark (parquet / Spark ML format) to a shared
folder; "read-modify-write" documents become append-only tables whose
history is the table itself.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid
from typing import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.files import open_if_there, scan_csv

log = logging.getLogger("vigil.sources")

STATS_SCHEMA = "median_start int, median_age int"
MODELS_SCHEMA = "version string, path string, promoted_at timestamp, f1 double, recall double, risk_threshold double, strategy string"


def write_statistics(stats: DataFrame, path: str) -> None:
    """One-row training statistics (overwrite)."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Statistics back at scoring time; unreadable -> empty table (callers
    then use their defaults, as the reference does with ``{}``)."""
    try:
        return spark.read.schema(STATS_SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001
        log.warning("no statistics at %s, defaults are used: %s", path, e)
        return spark.createDataFrame([], STATS_SCHEMA)


def metrics_long(spark: SparkSession, version: str, values: Mapping[str, float | None],
                 kind: str = "holdout") -> DataFrame:
    """A metrics document as long rows ``version, kind, metric, value``."""
    return spark.createDataFrame([(version, kind, k, None if v is None else float(v)) for k, v in values.items()],
                                 "version string, kind string, metric string, value double")


def append_metrics(df: DataFrame, path: str) -> None:
    """Metrics / CV report / drift history sink: append, partitioned by version."""
    df.write.mode("append").partitionBy("version").parquet(path)


def version_tag(now: _dt.datetime | None = None) -> str:
    """Model version ``vYYYY.MM.DD`` of the promotion day."""
    return (now or _dt.datetime.now(_dt.timezone.utc)).strftime("v%Y.%m.%d")


def promote_model(model: PipelineModel, base: str, registry: str, f1: float, recall: float,
                  version: str | None = None, risk_threshold: float | None = None, strategy: str | None = None) -> str:
    """Save the model under ``base/<version>`` (previous versions stay as
    backups) and append a pointer row, with the threshold that the version decides
    by, to the ``registry`` table (``registry.in_force`` joins it to rows)."""
    spark = SparkSession.getActiveSession()
    version = version or version_tag()
    path = f"{base.rstrip('/')}/{version}-{uuid.uuid4().hex[:8]}"  # two promotions of one day keep both models
    model.write().save(path)
    row = spark.createDataFrame([(version, path, f1, recall, risk_threshold, strategy)],
                                "version string, path string, f1 double, recall double, risk_threshold double, strategy string")
    row.withColumn("promoted_at", F.current_timestamp()).select("version", "path", "promoted_at", "f1", "recall", "risk_threshold", "strategy") \
        .write.mode("append").parquet(registry)
    return version


def current_model(spark: SparkSession, registry: str) -> tuple[PipelineModel | None, Mapping | None]:
    """Latest promoted model and its metrics row; nothing promoted -> (None, None)."""
    if open_if_there(spark, registry) is None:
        return None, None
    reg = spark.read.schema(MODELS_SCHEMA).parquet(registry)
    last = reg.orderBy(F.col("promoted_at").desc(), F.col("version").desc()).limit(1).collect()
    if not last:
        return None, None
    return PipelineModel.load(last[0]["path"]), last[0].asDict()


def scan_history(spark: SparkSession, csv_path: str | None, key: str, loader=None) -> DataFrame | None:
    """History store: the configured CSV when it exists and has the key
    column; else the full loader; any failure -> None (empty store, every
    lookup is a cold start).  Each step down is logged with its reason, so that a
    store that cannot be read is not taken for one that is empty."""
    if csv_path:
        try:
            df = scan_csv(spark, csv_path)
            if key in df.columns:
                return df
            log.warning("history %s has no column %s, the loader is used", csv_path, key)
        except Exception as e:  # noqa: BLE001
            log.warning("history %s cannot be read, the loader is used: %s", csv_path, e)
    if loader is None:
        log.warning("no history: every lookup is a cold start")
        return None
    try:
        return loader()
    except Exception as e:  # noqa: BLE001
        log.warning("the history loader failed, every lookup is a cold start: %s", e)
        return None


def cv_report(folds: DataFrame, summary: DataFrame, version: str) -> DataFrame:
    """CV report as one long table (per-fold metrics and the summary)."""
    per = folds.unpivot(["fold"], [c for c in ("recall", "precision", "f1", "auc", "threshold") if c in folds.columns],
                        "metric", "value").select(F.lit(version).alias("version"), F.lit("fold").alias("kind"),
                                                  F.col("fold").cast("string").alias("scope"), "metric",
                                                  F.col("value").cast("double").alias("value"))
    stats: Sequence[str] = [c for c in ("mean", "std", "min", "max", "gap") if c in summary.columns]
    agg = summary.unpivot(["metric"], list(stats), "stat", "value").select(
        F.lit(version).alias("version"), F.lit("summary").alias("kind"), F.col("stat").alias("scope"), "metric",
        F.col("value").cast("double").alias("value"))
    return per.unionByName(agg)


def model_version(spark: SparkSession, registry: str, default: str = "unknown") -> str:
    """Version of the promoted model from the registry table, else ``default``."""
    _, info = current_model(spark, registry) if registry else (None, None)
    return str(info["version"]) if info and info.get("version") else default
