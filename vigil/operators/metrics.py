"""Single-pass classification metrics, fairness, fold statistics and gates.

All metrics derive from four confusion counts computed with conditional
sums in one aggregate (partial aggregation on every executor), per optional
group.  Division by zero gives 0, as ``zero_division=0`` does.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators.ordered import _cols, safe_div, scalar, same_groups
from vigil.session import written

# fixed values of the reference configuration
MIN_RECALL_GATE = 0.6
GATE_F1_RATIO = 0.95
CV_HIGH_VARIABILITY = 0.15
CV_SEVERE_DEGRADATION = 0.15
CV_LOW_RECALL = 0.70
BOOTSTRAP_DRAWS = 500
SEED = 42


def predicted(score: str, threshold: float | Column) -> Column:
    """Decision rule ``score >= threshold`` as 0/1 (inclusive boundary)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.col(score) >= t).cast("int")


def confusion(df: DataFrame, label: str, pred: str | Column,
              group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """``group…, tn, fp, fn, tp`` (bigint); an empty input gives zeros."""
    g = _cols(group_cols)
    y = F.col(label).cast("int")
    yh = (F.col(pred) if isinstance(pred, str) else pred).cast("int")
    return df.groupBy(*g).agg(
        F.count_if((y == 0) & (yh == 0)).alias("tn"), F.count_if((y == 0) & (yh == 1)).alias("fp"),
        F.count_if((y == 1) & (yh == 0)).alias("fn"), F.count_if((y == 1) & (yh == 1)).alias("tp"))


def prf(tp: Column, fp: Column, fn: Column, digits: int | None = 4) -> list[Column]:
    """precision, recall, f1 columns from counts (0 when undefined)."""
    p = safe_div(tp.cast("double"), (tp + fp).cast("double"))
    r = safe_div(tp.cast("double"), (tp + fn).cast("double"))
    f = safe_div(2.0 * tp.cast("double"), (2 * tp + fp + fn).cast("double"))
    if digits is not None:
        p, r, f = rnd(p, digits), rnd(r, digits), rnd(f, digits)
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def classification_metrics(df: DataFrame, label: str, pred: str | Column,
                           group_cols: Sequence[str] | str | None = None, digits: int = 4) -> DataFrame:
    """``group…, tn, fp, fn, tp, precision, recall, f1, support``."""
    g = _cols(group_cols)
    c = confusion(df, label, pred, g)
    return c.select(*g, "tn", "fp", "fn", "tp",
                    *prf(F.col("tp"), F.col("fp"), F.col("fn"), digits),
                    (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("support"))


def brier_score(df: DataFrame, label: str, score: str,
                group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """Mean squared error of the probability: ``group…, brier``."""
    g = _cols(group_cols)
    d = F.col(score).cast("double") - F.col(label).cast("double")
    return df.groupBy(*g).agg(F.avg(d * d).alias("brier"))


def fairness_gaps(df: DataFrame, label: str, pred: str | Column, group: str) -> DataFrame:
    """Per group FPR and FNR in percent (0 without a denominator) with the
    gap (max − min) and maxima across groups attached; null groups dropped."""
    c = confusion(df.where(F.col(group).isNotNull()), label, pred, group)
    rates = c.select(group,
                     (safe_div(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
                      * 100.0).alias("fpr"),
                     (safe_div(F.col("fn").cast("double"), (F.col("fn") + F.col("tp")).cast("double"))
                      * 100.0).alias("fnr"))
    span = rates.agg(F.max("fpr").alias("max_fpr"), F.min("fpr").alias("_min_fpr"),
                     F.max("fnr").alias("max_fnr"), F.min("fnr").alias("_min_fnr"))
    return (rates.crossJoin(F.broadcast(span))  # one row
            .select(group, "fpr", "fnr", (F.col("max_fpr") - F.col("_min_fpr")).alias("gap_fpr"),
                    (F.col("max_fnr") - F.col("_min_fnr")).alias("gap_fnr"), "max_fpr", "max_fnr"))


def group_metrics(df: DataFrame, label: str, pred: str | Column, dimensions: Sequence[str],
                  digits: int = 4) -> DataFrame:
    """Recall, precision, F1 and support per value of every dimension column in
    one pass: rows are expanded to (dimension, value) pairs — as many as
    dimensions — then aggregated; null values are dropped."""
    yh = (F.col(pred) if isinstance(pred, str) else pred).cast("int")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"),
                                         F.col(d).cast("string").alias("value")) for d in dimensions]))
    long = df.select(F.col(label).cast("int").alias("_y"), yh.alias("_yh"), pairs.alias("_p"))
    long = long.select("_y", "_yh", "_p.dimension", "_p.value").where(F.col("value").isNotNull())
    c = confusion(long, "_y", "_yh", ["dimension", "value"])
    return c.select("dimension", "value", *prf(F.col("tp"), F.col("fp"), F.col("fn"), digits),
                    (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("support"))


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """Most frequent label, the lowest on ties: one row ``majority_class``."""
    return df.agg(F.mode(F.col(label).cast("int"), True).alias("majority_class"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """Predict the training majority class for every test row:
    ``majority_class, precision, recall, f1``."""
    maj = scalar(train, F.mode(F.col(label).cast("int"), True))
    c = confusion(test.withColumn("_m", maj), label, "_m")
    return c.select(maj.alias("majority_class"), *prf(F.col("tp"), F.col("fp"), F.col("fn"), digits))


def group_weights(df: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """Representation weight per row = mean group count / own group count.
    Group counts come from a partial aggregate; the small count table is written, so that its size is known and it is
    broadcast: a join dealt out by the group would leave the rows in as many tasks as there are groups."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    mean = counts.agg(F.avg("_gn").alias("_gm"))
    w = counts.crossJoin(F.broadcast(mean)).select(group, (F.col("_gm") / F.col("_gn")).alias(name))  # one row
    return same_groups(df, written(w, "group-weights"), [group], "left")  # a null group is a group


# --------------------------------------------------------------------------- folds

def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("recall", "precision", "f1", "auc"),
                 digits: int = 4) -> DataFrame:
    """Across folds per metric: mean, population std, min, max, gap (max−min);
    null values skipped.  Output ``metric, mean, std, min, max, gap``."""
    long = folds.unpivot([], list(metrics), "metric", "v").where(F.col("v").isNotNull())
    agg = long.groupBy("metric").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
                                     F.min("v").alias("lo"), F.max("v").alias("hi"))
    return agg.select("metric", rnd("m", digits).alias("mean"), rnd("s", digits).alias("std"),
                      rnd("lo", digits).alias("min"), rnd("hi", digits).alias("max"),
                      rnd(F.col("hi") - F.col("lo"), digits).alias("gap"))


def fold_stability(folds: DataFrame, order: str = "fold") -> DataFrame:
    """Stability verdict over folds: coefficient of variation of F1,
    first − last F1, mean recall and the three flags."""
    s = folds.agg(rnd(F.avg("f1"), 4).alias("mean_f1"), rnd(F.stddev_pop("f1"), 4).alias("std_f1"),
                  rnd(F.avg("recall"), 4).alias("mean_recall"),
                  F.min_by("f1", order).alias("first_f1"), F.max_by("f1", order).alias("last_f1"),
                  F.count(F.lit(1)).alias("n_folds"))
    cv = rnd(safe_div(F.col("std_f1"), F.col("mean_f1")), 4)
    deg = F.col("first_f1") - F.col("last_f1")
    return s.select("n_folds", "mean_f1", "std_f1", cv.alias("cv_f1"), "first_f1", "last_f1",
                    rnd(deg, 4).alias("degradation"), "mean_recall",
                    (cv > CV_HIGH_VARIABILITY).alias("high_variability"),
                    ((F.col("n_folds") > 1) & (deg > CV_SEVERE_DEGRADATION)).alias("severe_degradation"),
                    (F.col("mean_recall") < CV_LOW_RECALL).alias("low_recall"))


def holdout_in_interval(summary: DataFrame, holdout: DataFrame,
                        metrics: Sequence[str] = ("f1", "recall", "precision")) -> DataFrame:
    """Hold-out metric inside mean ± std of the folds (inclusive), per metric,
    plus ``all_inside`` (true only if at least one metric was compared)."""
    h = holdout.unpivot([], list(metrics), "metric", "holdout")
    j = summary.select("metric", F.col("mean").alias("cv_mean"), F.col("std").alias("cv_std")).join(h, "metric")
    lo, hi = F.col("cv_mean") - F.col("cv_std"), F.col("cv_mean") + F.col("cv_std")
    inside = (F.col("holdout") >= lo) & (F.col("holdout") <= hi)
    per = j.where(F.col("holdout").isNotNull()).select(
        "metric", "cv_mean", "cv_std", rnd(lo, 4).alias("lower"), rnd(hi, 4).alias("upper"),
        "holdout", inside.alias("inside"))
    allin = per.agg(F.coalesce(F.bool_and("inside"), F.lit(False)).alias("all_inside"))
    return per.crossJoin(F.broadcast(allin))


def promotion_gate(candidate: DataFrame, current: DataFrame, keys: Sequence[str] = (),
                   min_recall: float = MIN_RECALL_GATE, ratio: float = GATE_F1_RATIO) -> DataFrame:
    """Promote when recall >= min_recall and (no current metrics or
    F1 >= ratio × current F1); evaluated for many segments at once.
    ``candidate``/``current`` carry ``keys…, f1, recall``."""
    k = list(keys)
    cur = current.select(*k, F.col("f1").alias("current_f1"))
    j = candidate.select(*k, F.col("f1").alias("candidate_f1"), F.col("recall").alias("candidate_recall"))
    j = j.join(cur, k, "left") if k else j.crossJoin(cur)
    promote = (F.when(F.col("candidate_recall") < min_recall, F.lit(False))
               .when(F.col("current_f1").isNull(), F.lit(True))
               .otherwise(F.col("candidate_f1") >= F.col("current_f1") * F.lit(ratio)))
    reason = (F.when(F.col("candidate_recall") < min_recall, F.lit("recall_below_minimum"))
              .when(F.col("current_f1").isNull(), F.lit("no_current_model"))
              .when(promote, F.lit("f1_within_tolerance")).otherwise(F.lit("f1_regression")))
    return j.select(*k, "candidate_f1", "candidate_recall", "current_f1", promote.alias("promote"),
                    reason.alias("reason"))


# --------------------------------------------------------------------------- bootstrap

def _bootstrap_counts(tp: int, fp: int, fn: int, tn: int, draws: int, seed: int) -> dict:
    """F1 over ``draws`` resamples of n rows with replacement.  F1 depends
    only on the four cells, so a resample is one multinomial draw of the
    cell counts — the same distribution as resampling rows, in O(1)."""
    n = tp + fp + fn + tn
    if n == 0:
        return dict(f1_mean=0.0, f1_std=0.0, f1_low=0.0, f1_high=0.0)
    rng = np.random.default_rng(seed)
    cells = rng.multinomial(n, np.array([tp, fp, fn, tn], dtype=float) / n, size=draws)
    den = 2 * cells[:, 0] + cells[:, 1] + cells[:, 2]
    f1 = np.where(den > 0, 2 * cells[:, 0] / np.maximum(den, 1), 0.0)
    return dict(f1_mean=round(float(f1.mean()), 4), f1_std=round(float(f1.std()), 4),
                f1_low=round(float(np.percentile(f1, 2.5)), 4),
                f1_high=round(float(np.percentile(f1, 97.5)), 4))


def bootstrap_f1(df: DataFrame, label: str, pred: str | Column,
                 group_cols: Sequence[str] | str | None = None,
                 draws: int = BOOTSTRAP_DRAWS, seed: int = SEED) -> DataFrame:
    """Bootstrap F1 interval per group: ``group…, f1_mean, f1_std, f1_low, f1_high``.

    Rows are reduced to one confusion row per group by a distributed
    aggregate; the resampling runs per group with ``applyInPandas`` on that
    single row, so no group's rows ever meet in one task."""
    g = _cols(group_cols)
    c = confusion(df, label, pred, g)
    if not g:
        c = c.withColumn("_all", F.lit(0))
        keys = ["_all"]
    else:
        keys = g

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        out = _bootstrap_counts(int(r.tp), int(r.fp), int(r.fn), int(r.tn), draws, seed)
        return pd.DataFrame([{**{k: r[k] for k in keys}, **out}])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields if f.name in keys]
                       + ["f1_mean double", "f1_std double", "f1_low double", "f1_high double"])
    out = c.groupBy(*keys).applyInPandas(fn, schema)
    return out.drop("_all") if not g else out
