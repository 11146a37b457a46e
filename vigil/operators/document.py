"""The evaluation of a scored table as one long document: every curve, table and choice under its section."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators import curve, metrics

SCHEMA = "section string, at double, name string, value double"


def section(df: DataFrame, name: str, at: Column | str | None, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Rows (section, at, name, value) of a table: ``at`` is its row's place (a threshold, a bin), null for a single row."""
    where = F.lit(None).cast("double") if at is None else (F.col(at) if isinstance(at, str) else at).cast("double")
    wide = df.select(where.alias("at"), *[rnd(F.col(c).cast("double"), digits).alias(c) for c in columns])
    return wide.unpivot(["at"], list(columns), "name", "value").select(F.lit(name).alias("section"), "at", "name", "value")


def evaluation_document(scored: DataFrame, label: str, score: str, group: str | None, threshold: float,
                        train: DataFrame | None = None) -> DataFrame:
    """The metrics document of a scored table at a threshold: confusion matrix, hold-out metrics, AUC, Brier score, ROC and
    precision-recall curve, calibration curve, score distribution, threshold trade-off, and with a group the fairness
    gaps; with ``train`` also that side's metrics and the overfit gap."""
    pred = metrics.predicted(score, threshold)
    m = metrics.classification_metrics(scored, label, pred)
    parts = [section(m, "confusion_matrix", None, ["tn", "fp", "fn", "tp"]),
             section(m, "holdout", None, ["recall", "precision", "f1", "support"]),
             section(curve.roc_auc(scored, label, score), "holdout", None, ["auc"]),
             section(metrics.brier_score(scored, label, score), "holdout", None, ["brier"]),
             section(curve.roc_curve(scored, label, score), "roc_curve", "threshold", ["fpr", "tpr"]),
             section(curve.pr_curve(scored, label, score), "pr_curve", "threshold", ["precision", "recall"]),
             section(curve.calibration_curve(scored, label, score), "calibration_curve", "bin", ["mean_predicted", "fraction_positive", "n"]),
             section(curve.score_histogram(scored, label, score), "score_distribution", "bin", ["bin_lo", "bin_hi", "positive", "negative"]),
             section(curve.threshold_grid(scored, label, score), "threshold_tradeoff", rnd("threshold", 6), ["recall", "precision", "f1"])]
    if group is not None:
        gaps = metrics.fairness_gaps(scored, label, pred, group)
        one = ["gap_fpr", "gap_fnr", "max_fpr", "max_fnr"]
        parts.append(section(gaps.agg(*[F.max(c).alias(c) for c in one]), "fairness", None, one, 4))
    if train is not None:
        t = metrics.classification_metrics(train, label, pred)
        parts += [section(t, "train", None, ["recall", "precision", "f1", "support"]),
                  section(t.select(F.col("f1").alias("t")).crossJoin(m.select("f1")).select((F.col("t") - F.col("f1")).alias("overfit_gap_f1")), "train", None,
                          ["overfit_gap_f1"], 4)]
    return reduce(DataFrame.unionByName, parts)


def with_version(document: DataFrame, version: str, texts: Mapping[str, str] | None = None) -> DataFrame:
    """The document's rows as the metrics sink takes them (``artifacts.append_metrics``); ``texts`` - the strategy, its
    justification and trade-off - become rows with a text instead of a value."""
    rows = document.withColumn("text", F.lit(None).cast("string"))
    if texts:
        said = document.sparkSession.createDataFrame([("text", None, k, None, v) for k, v in texts.items()], f"{SCHEMA}, text string")
        rows = rows.unionByName(said)
    return rows.withColumn("version", F.lit(version))
