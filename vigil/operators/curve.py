"""Threshold curves and threshold choice.

Kernel (``threshold_counts``): for every distinct score ``t`` the confusion
counts of the rule ``score >= t``.  The score column is first aggregated to
one row per distinct score (map-side combine, so a score value shared by a
third of the rows is one row after the partial aggregate), then turned into
running counts by the bucketed prefix sum in ``ordered.running_sums``.
Everything else — ROC/PR points, AUC, the fixed grid, best-F1, max-recall,
min-cost and fairness-constrained thresholds — is a projection, a filter or a
top-1 over that table, never a rows × thresholds product.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ordered import _cols, count_less, ranges_for, running_sums, safe_div
from vigil.session import written

# fixed values of the reference configuration
DEFAULT_THRESHOLD = 0.5072
REVIEW_MARGIN = 0.02
MIN_PRECISION = 0.5
MIN_RECALL = 0.6
COST_FN = 3.0
COST_FP = 1.0
MAX_FPR_GAP = 10.0
MAX_FNR_GAP = 10.0
MAX_FPR = 40.0
MAX_FNR = 10.0
F1_EPS = 1e-9


def _label(label: str) -> Column:
    return F.col(label).cast("long")


def score_counts(df: DataFrame, label: str, score: str,
                 group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """(group…, score) -> pos, neg; rows with a null score are ignored."""
    g = _cols(group_cols)
    y = _label(label)
    return (df.where(F.col(score).isNotNull())
            .groupBy(*g, F.col(score).cast("double").alias("threshold"))
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def threshold_counts(df: DataFrame, label: str, score: str,
                     group_cols: Sequence[str] | str | None = None,
                     extra_thresholds: Sequence[float] = (), index: str | None = None,
                     count: str | None = None, lead: bool = False) -> DataFrame:
    """``group…, threshold, pos, neg, tp, fp, fn, tn, n_pos, n_neg`` with
    tp/fp counting rows whose score >= threshold.  ``extra_thresholds`` adds
    candidate thresholds that are not scores (they carry pos = neg = 0).
    From the same pass: ``index`` (0-based, descending threshold), ``count``
    (distinct thresholds per group) and, with ``lead``, ``pos_next`` /
    ``neg_next`` of the next lower threshold."""
    g = _cols(group_cols)
    counts = score_counts(df, label, score, g)
    if extra_thresholds:
        if g:
            keys = counts.select(*g).distinct()
            extra = keys.select(*g, F.explode(F.array(*[F.lit(float(t)) for t in extra_thresholds]))
                                .alias("threshold"))
        else:
            extra = counts.sparkSession.createDataFrame(
                [(float(t),) for t in extra_thresholds], "threshold double")
        extra = extra.select(*g, "threshold", F.lit(0).cast("long").alias("pos"),
                             F.lit(0).cast("long").alias("neg"))
        counts = (counts.unionByName(extra).groupBy(*g, "threshold")
                  .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    cum = running_sums(counts, "threshold", ["pos", "neg"], g, descending=True, totals=True,
                       index=index, count=count, lead_cols=["pos", "neg"] if lead else ())
    extra_out = [c for c in (index, count) if c] + (["pos_next", "neg_next"] if lead else [])
    return cum.select(*g, "threshold", "pos", "neg", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"),
                      (F.col("pos_tot") - F.col("pos_cum")).alias("fn"),
                      (F.col("neg_tot") - F.col("neg_cum")).alias("tn"),
                      F.col("pos_tot").alias("n_pos"), F.col("neg_tot").alias("n_neg"), *extra_out)


def precision_col() -> Column:
    return safe_div(F.col("tp"), F.col("tp") + F.col("fp"))


def recall_col(curve_convention: bool = False) -> Column:
    """tp / positives; with ``curve_convention`` a class without positives has
    recall 1 (precision-recall curve convention), else 0."""
    return safe_div(F.col("tp"), F.col("n_pos"), 1.0 if curve_convention else 0.0)


def f1_from_counts() -> Column:
    """F1 = 2tp / (2tp + fp + fn), 0 when undefined."""
    return safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def f1_smoothed(p: Column, r: Column) -> Column:
    """Curve-based F1 used for threshold choice: 2PR / (P + R + 1e-9)."""
    return (F.lit(2.0) * p * r) / (p + r + F.lit(F1_EPS))


def with_curve_metrics(curve: DataFrame) -> DataFrame:
    """precision, recall (curve convention) and smoothed F1 per threshold."""
    return (curve.withColumns({"precision": precision_col(), "recall": recall_col(True)})
            .withColumn("f1", f1_smoothed(F.col("precision"), F.col("recall"))))


# --------------------------------------------------------------------------- AUC / curves

def roc_auc(df: DataFrame, label: str, score: str,
            group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """Mann–Whitney AUC (ties count 1/2) per group; null when one class is absent.

    AUC = Σ_s pos_s · (negatives below s + neg_s / 2) / (P · N), one aggregate
    over the running counts.
    """
    g = _cols(group_cols)
    return threshold_counts(df, label, score, g).groupBy(*g).agg(auc_of_counts().alias("auc"))


def auc_of_counts() -> Column:
    """``roc_auc`` as an aggregate of ``threshold_counts`` rows, for a curve that is read for more than its AUC."""
    below = F.col("n_neg") - F.col("fp")
    term = F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2.0)
    p, n = F.first("n_pos"), F.first("n_neg")
    return F.when((p > 0) & (n > 0), F.sum(term) / (p.cast("double") * n.cast("double")))


def roc_curve(df: DataFrame, label: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """ROC points ``threshold, fpr, tpr`` (threshold null for the origin).

    One point per distinct score, descending, preceded by (0, 0); with
    ``drop_intermediate`` a point is dropped when it is collinear with both
    neighbours (same positive and negative step as the next point), the first
    and last points always kept.  Empty when a class is absent.
    """
    c = threshold_counts(df, label, score, index="i", count="n_pts", lead=drop_intermediate)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pts = c.where(both)
    if drop_intermediate:
        keep = ((F.col("i") == 0) | (F.col("i") == F.col("n_pts") - 1) | (F.col("n_pts") <= 2)
                | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")))
        pts = pts.where(keep)
    pt = F.struct(F.col("threshold").alias("threshold"),
                  (F.col("fp") / F.col("n_neg")).alias("fpr"), (F.col("tp") / F.col("n_pos")).alias("tpr"))
    origin = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                      F.lit(0.0).alias("tpr"))
    # the origin is emitted next to the first point (no second branch over the curve)
    return pts.select(F.explode(F.when(F.col("i") == 0, F.array(origin, pt)).otherwise(F.array(pt)))
                      .alias("_p")).select("_p.*")


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``threshold, precision, recall`` per distinct score + final (null, 1, 0)."""
    c = with_curve_metrics(threshold_counts(df, label, score, index="i"))
    pt = F.struct(F.col("threshold").alias("threshold"), F.col("precision").alias("precision"),
                  F.col("recall").alias("recall"))
    final = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return c.select(F.explode(F.when(F.col("i") == 0, F.array(pt, final)).otherwise(F.array(pt)))
                    .alias("_p")).select("_p.*")


def _edges(n_bins: int) -> list[float]:
    """Uniform bin edges on [0, 1] computed as k·(1/n), last edge exactly 1."""
    step = 1.0 / n_bins
    return [k * step for k in range(n_bins)] + [1.0]


def calibration_curve(df: DataFrame, label: str, score: str, n_bins: int = 10) -> DataFrame:
    """``bin, mean_predicted, fraction_positive, n``: uniform right-closed bins
    (a score on an inner edge falls in the lower bin), empty bins omitted,
    empty result when one class is absent."""
    p = F.col(score).cast("double")
    b = count_less(_edges(n_bins)[1:-1], p)
    binned = df.where(F.col(score).isNotNull()).select(b.alias("bin"), p.alias("_p"),
                                                      _label(label).alias("_y"))
    agg = binned.groupBy("bin").agg(F.avg("_p").alias("mean_predicted"),
                                    F.avg("_y").alias("fraction_positive"),
                                    F.count(F.lit(1)).alias("n"),
                                    F.sum("_y").alias("_pos"))
    # both classes present overall (sum of per-bin positives strictly between 0 and n)
    tot = agg.agg(F.sum("_pos").alias("_tp"), F.sum("n").alias("_tn"))
    return (agg.crossJoin(F.broadcast(tot)).where((F.col("_tp") > 0) & (F.col("_tp") < F.col("_tn")))
            .drop("_pos", "_tp", "_tn"))


def score_histogram(df: DataFrame, label: str, score: str, n_bins: int = 20) -> DataFrame:
    """Class-conditional histogram on [0, 1]: ``bin, bin_lo, bin_hi, positive,
    negative``; left-closed bins, last bin closed, scores outside [0, 1]
    ignored, every bin present (the bin domain is generated)."""
    edges = _edges(n_bins)
    p = F.col(score).cast("double")
    y = _label(label)
    counted = (df.where(p.between(0.0, 1.0))
               .select(count_less(edges[1:-1], p, inclusive=True).alias("bin"), y.alias("_y"))
               .groupBy("bin").agg(F.sum("_y").alias("positive"),
                                   F.sum(F.lit(1) - F.col("_y")).alias("negative")))
    domain = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(n_bins)], "bin int, bin_lo double, bin_hi double")
    return (domain.join(F.broadcast(counted), "bin", "left")
            .select("bin", "bin_lo", "bin_hi",
                    F.coalesce("positive", F.lit(0)).cast("long").alias("positive"),
                    F.coalesce("negative", F.lit(0)).cast("long").alias("negative")))


def threshold_grid(df: DataFrame, label: str, score: str, n: int = 50) -> DataFrame:
    """Fixed grid of ``n`` thresholds evenly on [0, 1]: recall, precision, F1.

    Each row is assigned the index of the largest grid point <= its score;
    the ≤ n+1 bucket rows are expanded to the grid points they count for.
    """
    step = 1.0 / (n - 1)
    grid = [k * step for k in range(n - 1)] + [1.0]
    p = F.col(score).cast("double")
    y = _label(label)
    b = (df.where(p.isNotNull())
         .select((count_less(grid, p, inclusive=True) - 1).alias("_k"), y.alias("_y"))
         .groupBy("_k").agg(F.sum("_y").alias("_pos"), F.sum(F.lit(1) - F.col("_y")).alias("_neg")))
    spread = (b.where(F.col("_k") >= 0)
              .select(F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("k"), "_pos", "_neg")
              .groupBy("k").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp")))
    domain = df.sparkSession.createDataFrame([(k, grid[k]) for k in range(n)], "k int, threshold double")
    tot = b.agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    c = (domain.join(F.broadcast(spread), "k", "left").crossJoin(F.broadcast(tot))  # one row
         .select("k", "threshold", F.coalesce("tp", F.lit(0)).alias("tp"),
                 F.coalesce("fp", F.lit(0)).alias("fp"), "n_pos", "n_neg"))
    c = c.withColumn("fn", F.col("n_pos") - F.col("tp"))
    return c.select("threshold", recall_col().alias("recall"), precision_col().alias("precision"),
                    f1_from_counts().alias("f1"))


# --------------------------------------------------------------------------- threshold choice

def _with_default(best: DataFrame, default_row: dict) -> DataFrame:
    """Append a fallback row with lower priority and keep the first."""
    spark = best.sparkSession
    cols = best.columns
    fallback = spark.createDataFrame([tuple(default_row.get(c) for c in cols)], best.schema)
    return (best.withColumn("_prio", F.lit(0))
            .unionByName(fallback.withColumn("_prio", F.lit(1)))
            .orderBy("_prio").limit(1).drop("_prio"))


def _plain_curve(df: DataFrame, label: str, score: str, extra: Sequence[float] = ()) -> DataFrame:
    c = with_curve_metrics(threshold_counts(df, label, score, extra_thresholds=extra))
    nul = F.lit(None).cast("double")
    return c.select("*", ((F.col("pos") + F.col("neg")) > 0).alias("is_score"),
                    *[nul.alias(x) for x in ("gap_fpr", "gap_fnr", "max_fpr", "max_fnr")])


def best_f1_threshold(df: DataFrame, label: str, score: str,
                      default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Threshold maximising 2PR/(P+R+1e-9) over the distinct scores, the lowest
    on ties; ``default`` when there is no score.  Columns: threshold,
    precision, recall, f1."""
    best = pick_best_f1(_plain_curve(df, label, score)).select("threshold", "precision", "recall", "f1")
    return _with_default(best, {"threshold": default})


def max_recall_threshold(df: DataFrame, label: str, score: str,
                         min_precision: float = MIN_PRECISION,
                         default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Highest recall with precision >= ``min_precision`` (then F1, then the
    lowest threshold); none qualifies -> the lowest score."""
    best = pick_max_recall(_plain_curve(df, label, score), min_precision).select(
        "threshold", "precision", "recall", "f1", "constraint_met")
    return _with_default(best, {"threshold": default, "constraint_met": False})


def min_cost_threshold(df: DataFrame, label: str, score: str, cost_fn: float = COST_FN,
                       cost_fp: float = COST_FP, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Candidates = distinct scores ∪ {default}; minimise cost_fn·FN + cost_fp·FP,
    lowest threshold on ties.  Columns: threshold, cost, fn, fp."""
    return pick_min_cost(_plain_curve(df, label, score, [default]), cost_fn, cost_fp).select(
        "threshold", "cost", "fn", "fp")


def _group_steps(known: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """How the groups' error rates change, and where they begin, from ``score_counts`` by group.

    One row per distinct score: over the groups with a row of that score, the
    highest FPR and lowest FNR at it (``up_fpr``, ``low_fnr``), and the lowest FPR
    and highest FNR just above it (``above_fpr``, ``above_fnr``).  One row of
    limits: the lowest FPR below all scores and the lowest FNR above them
    (``floor_fpr``, ``floor_fnr``; a group without negatives or positives has rate
    0), and the number of groups."""
    own = running_sums(known, "threshold", ["pos", "neg"], group, descending=True, totals=True)
    fpr = lambda fp: safe_div(fp, F.col("neg_tot")) * F.lit(100.0)
    fnr = lambda tp: safe_div(F.col("pos_tot") - tp, F.col("pos_tot")) * F.lit(100.0)
    steps = own.groupBy("threshold").agg(
        F.max(fpr(F.col("neg_cum"))).alias("up_fpr"), F.min(fnr(F.col("pos_cum"))).alias("low_fnr"),
        F.min(fpr(F.col("neg_cum") - F.col("neg"))).alias("above_fpr"), F.max(fnr(F.col("pos_cum") - F.col("pos"))).alias("above_fnr"))
    rate = lambda n: F.when(F.col(n) > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    limits = known.groupBy(group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).agg(
        F.min(rate("n")).alias("floor_fpr"), F.min(rate("p")).alias("floor_fnr"), F.count(F.lit(1)).alias("n_groups"))
    return steps, limits


def fairness_curve(df: DataFrame, label: str, score: str, group: str | None,
                   extra_thresholds: Sequence[float] = ()) -> DataFrame:
    """One row per distinct score (plus extra candidates): running counts,
    curve metrics and, with a group column, FPR/FNR gaps and maxima across
    groups.  Every threshold choice below is a top-1 over this table.

    Any number of groups: a group's FPR only rises and its FNR only falls as the
    threshold goes down, so the highest FPR over groups is a running maximum over
    the (group, score) rows passed on the way down, and the lowest FPR a running
    minimum, on the way up, of the rates that groups change to; the FNR likewise.
    No score x group product is made, and no group's table reaches the driver."""
    if group is None:
        counts = score_counts(df, label, score)
    else:  # one scan: the overall counts are sums of the groups', the null group's included
        every = written(score_counts(df, label, score, group), "score-counts")
        counts = every.groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    if extra_thresholds:
        extra = df.sparkSession.createDataFrame([(float(t), 0, 0) for t in extra_thresholds], "threshold double, pos long, neg long")
        counts = counts.unionByName(extra).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.withColumn("is_score", (F.col("pos") + F.col("neg")) > 0)
    runs, ranges = {}, ranges_for(counts)  # the groups' steps add columns, not rows
    if group is not None:
        steps, limits = _group_steps(every.where(F.col(group).isNotNull()), group)
        counts = counts.join(steps, "threshold", "left")
        runs = {"run_up": ("up_fpr", "max", "upto"), "run_low": ("low_fnr", "min", "upto"),
                "run_fpr": ("above_fpr", "min", "after"), "run_fnr": ("above_fnr", "max", "after")}
    cum = running_sums(counts, "threshold", ["pos", "neg"], descending=True, totals=True, buckets=ranges, extremes=runs)
    cum = (cum.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp", "pos_tot": "n_pos", "neg_tot": "n_neg"})
           .withColumn("fn", F.col("n_pos") - F.col("tp")))
    c = with_curve_metrics(cum)
    if group is None:
        nul = F.lit(None).cast("double")
        return c.select("*", nul.alias("max_fpr"), nul.alias("max_fnr"), nul.alias("gap_fpr"), nul.alias("gap_fnr"))
    c = c.crossJoin(F.broadcast(limits))  # one row
    some = lambda x: F.when(F.col("n_groups") > 0, x)
    zero = F.lit(0.0)
    max_fpr, max_fnr = F.coalesce("run_up", zero), F.coalesce("run_fnr", zero)
    return c.withColumns({"max_fpr": some(max_fpr), "max_fnr": some(max_fnr),
                          "gap_fpr": some(max_fpr - F.least("run_fpr", "floor_fpr")), "gap_fnr": some(max_fnr - F.least("run_low", "floor_fnr"))})


_PICK_COLS = ["threshold", "tp", "fp", "fn", "n_pos", "precision", "recall", "f1",
              "gap_fpr", "gap_fnr", "max_fpr", "max_fnr"]


def _row() -> Column:
    return F.struct(*[F.col(c) for c in _PICK_COLS])


# Each pick is an arg-max over a lexicographic struct key (partial aggregation,
# no sort of the curve); the last key component −threshold makes it unique.

def _key_best_f1() -> Column:
    return F.when(F.col("is_score"), F.struct(F.col("f1").alias("f1"), (-F.col("threshold")).alias("t")))


def _key_max_recall(min_precision: float) -> Column:
    ok = F.col("precision") >= F.lit(min_precision)
    return F.when(F.col("is_score"), F.struct(
        ok.cast("int").alias("ok"), F.when(ok, F.col("recall")).alias("r"), F.when(ok, F.col("f1")).alias("f"),
        (-F.col("threshold")).alias("t")))


def _key_min_cost(cost_fn: float, cost_fp: float) -> Column:
    return F.struct((F.lit(cost_fn) * F.col("fn") + F.lit(cost_fp) * F.col("fp")).alias("cost"),
                    F.col("threshold").alias("t"))


def _key_fair(min_recall, min_precision, max_fpr_gap, max_fnr_gap, max_fpr, max_fnr) -> Column:
    feasible = (F.col("is_score") & (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)
                & (F.col("gap_fpr") <= max_fpr_gap) & (F.col("gap_fnr") <= max_fnr_gap)
                & (F.col("max_fpr") <= max_fpr) & (F.col("max_fnr") <= max_fnr))
    return F.when(feasible, F.struct(F.col("recall").alias("r"), (-F.col("gap_fpr")).alias("g"),
                                     F.col("precision").alias("p"), (-F.col("threshold")).alias("t")))


def _unpack(col: str, extra: dict | None = None) -> list[Column]:
    return [F.col(f"{col}.{c}").alias(c) for c in _PICK_COLS] + [v.alias(k) for k, v in (extra or {}).items()]


def pick_best_f1(c: DataFrame) -> DataFrame:
    return c.agg(F.max_by(_row(), _key_best_f1()).alias("_p")).where(F.col("_p").isNotNull()).select(*_unpack("_p"))


def pick_max_recall(c: DataFrame, min_precision: float = MIN_PRECISION) -> DataFrame:
    k = _key_max_recall(min_precision)
    return (c.agg(F.max_by(_row(), k).alias("_p"), F.max(k).alias("_k")).where(F.col("_p").isNotNull())
            .select(*_unpack("_p", {"constraint_met": F.col("_k").getField("ok") == 1})))


def pick_min_cost(c: DataFrame, cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    k = _key_min_cost(cost_fn, cost_fp)
    return (c.agg(F.min_by(_row(), k).alias("_p"), F.min(k).alias("_k")).where(F.col("_p").isNotNull())
            .select(*_unpack("_p", {"cost": F.col("_k").getField("cost")})))


def pick_fair(c: DataFrame, min_recall: float = MIN_RECALL, min_precision: float = MIN_PRECISION,
              max_fpr_gap: float = MAX_FPR_GAP, max_fnr_gap: float = MAX_FNR_GAP,
              max_fpr: float = MAX_FPR, max_fnr: float = MAX_FNR) -> DataFrame:
    """Feasible thresholds, then highest recall, smallest FPR gap, highest
    precision, lowest threshold; falls back to best F1 (``strategy = f1``).
    One aggregate computes both candidates."""
    a = c.agg(F.max_by(_row(), _key_fair(min_recall, min_precision, max_fpr_gap, max_fnr_gap, max_fpr,
                                         max_fnr)).alias("_fair"),
              F.max_by(_row(), _key_best_f1()).alias("_f1"))
    nul = F.lit(None).cast("double")
    fb = F.struct(*[F.col(f"_f1.{x}").alias(x) for x in _PICK_COLS[:8]], *[nul.alias(x) for x in _PICK_COLS[8:]])
    return (a.select(F.coalesce(F.col("_fair"), fb).alias("_p"),
                     F.when(F.col("_fair").isNotNull(), F.lit("fairness_f1")).otherwise(F.lit("f1")).alias("_s"))
            .where(F.col("_p").isNotNull()).select(*_unpack("_p", {"strategy": F.col("_s")})))


def fair_threshold(df: DataFrame, label: str, score: str, group: str,
                   min_recall: float = MIN_RECALL, min_precision: float = MIN_PRECISION,
                   max_fpr_gap: float = MAX_FPR_GAP, max_fnr_gap: float = MAX_FNR_GAP,
                   max_fpr: float = MAX_FPR, max_fnr: float = MAX_FNR,
                   default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Fairness-constrained threshold over the distinct scores.

    Constraints: recall >= min_recall, precision >= min_precision, FPR and FNR
    gaps across groups <= limits, worst-group FPR/FNR <= limits (percent
    points).  Among feasible thresholds: highest recall, then smallest FPR
    gap, then highest precision, then the lowest threshold.  When none is
    feasible the strategy falls back to best F1 and reports ``strategy = f1``;
    with no score at all the default threshold is returned.
    """
    c = fairness_curve(df, label, score, group)
    out = pick_fair(c, min_recall, min_precision, max_fpr_gap, max_fnr_gap, max_fpr, max_fnr).select(
        "threshold", "precision", "recall", "f1", "gap_fpr", "gap_fnr", "max_fpr", "max_fnr", "strategy")
    return _with_default(out, {"threshold": default, "strategy": "f1"})


#: What each strategy is chosen for, and what it gives up.
REASONS = {
    "recall": ("highest recall at the required precision, so that cases at risk are found early", "more false alarms"),
    "cost": ("lowest weighted cost of missed cases (weight {fn:g}) and false alarms (weight {fp:g})", "rests on the weights"),
    "fairness_f1": ("highest recall among thresholds within the limits on group gaps and error rates", "overall F1 may be lower"),
    "f1": ("best balance of precision and recall", "cases close to the threshold may be missed"),
}


def threshold_report(df: DataFrame, label: str, score: str, group: str, active: str = "fairness_f1",
                     default: float = DEFAULT_THRESHOLD, band: float = REVIEW_MARGIN) -> DataFrame:
    """``threshold_strategies`` with what a choice means: ``high_risk_estimated``
    (rows at or above the threshold), ``human_reviews`` (rows within ``band`` of
    it), ``justification`` and ``tradeoff``.  The row counts come from one pass over
    the scores with the four thresholds as literals."""
    rows = threshold_strategies(df, label, score, group, active, default).collect()  # four rows
    p = F.col(score).cast("double")
    aggs = [F.count_if(x) for r in rows for x in (p >= F.lit(r["threshold"]), F.abs(p - F.lit(r["threshold"])) <= F.lit(band))]
    counted = list(df.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first()) if rows else []
    spark, out = df.sparkSession, []
    for i, r in enumerate(rows):
        name = "f1" if r["strategy"] == "fairness_f1" and active == "fairness_f1" and not r["is_active"] else r["strategy"]
        why, cost = REASONS[name]
        out.append((*r, counted[2 * i], counted[2 * i + 1], why.format(fn=COST_FN, fp=COST_FP), cost))
    return spark.createDataFrame(out, "strategy string, threshold double, precision double, recall double, f1 double, is_active boolean, "
                                      "high_risk_estimated long, human_reviews long, justification string, tradeoff string")


def threshold_strategies(df: DataFrame, label: str, score: str, group: str,
                         active: str = "fairness_f1", default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """All four strategies side by side, each with the exact metrics of its
    threshold (rule ``score >= t``): ``strategy, threshold, precision,
    recall, f1, is_active``.  The active row is the configured strategy, or
    ``f1`` when the fairness search falls back.  One curve, one aggregate:
    the default threshold enters as an extra candidate for the cost strategy,
    and every pick is an arg-max over the same pass."""
    c = fairness_curve(df, label, score, group, extra_thresholds=[default])
    nul = F.lit(None).cast("double")
    a = c.agg(F.max_by(_row(), _key_best_f1()).alias("f1"),
              F.max_by(_row(), _key_max_recall(MIN_PRECISION)).alias("recall"),
              F.min_by(_row(), _key_min_cost(COST_FN, COST_FP)).alias("cost"),
              F.max_by(_row(), _key_fair(MIN_RECALL, MIN_PRECISION, MAX_FPR_GAP, MAX_FNR_GAP, MAX_FPR,
                                         MAX_FNR)).alias("_fair"))
    fair_ok = F.col("_fair").isNotNull()
    rows = F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(src).alias("p"))
                     for name, src in (("f1", "f1"), ("recall", "recall"), ("cost", "cost"))],
                   F.struct(F.lit("fairness_f1").alias("strategy"),
                            F.coalesce(F.col("_fair"), F.col("f1")).alias("p")))
    resolved = F.when(fair_ok, F.lit("fairness_f1")).otherwise(F.lit("f1"))
    chosen = F.lit(active) if active in ("recall", "cost", "f1") else resolved
    x = a.select(F.explode(rows).alias("r"), chosen.alias("_chosen"))
    x = x.select(F.col("r.strategy").alias("strategy"), "r.p.*", "_chosen")
    return x.select("strategy", "threshold", precision_col().alias("precision"), recall_col().alias("recall"),
                    f1_from_counts().alias("f1"), (F.col("strategy") == F.col("_chosen")).alias("is_active"))
