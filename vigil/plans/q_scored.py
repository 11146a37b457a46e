"""Evaluation and decision queries on the ``scored`` bindings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import decision as dec
from vigil.functions.numeric import rnd
from vigil.operators import curve, document, metrics, temporal
from vigil.plans.bindings import (SCORED_LABELS_SQL, SCORED_SQL, SCORED_TIES_SQL, VERSIONS_SCORED_SQL, scored, scored_labels,
                                  scored_ties, versions_scored, with_ctes)
from vigil.plans.registry import ORACLES, query
from vigil.sources import registry
from vigil.plans.sqlkit import confusion_sql, curve_ctes, curve_metrics, dbl, prf_sql

T = dec.DEFAULT_THRESHOLD
TS = dbl(T)
PRED = f"CAST(p >= {TS} AS INTEGER)"


def _pred(df):
    return df.withColumn("pred", metrics.predicted("p", T))


def _split(spark, d):
    s = temporal.temporal_split(scored(spark, d), "period")
    return s.where(F.col("role") == "train"), s.where(F.col("role") == "test")


SPLIT_SQL = """
split AS (SELECT *, CASE WHEN period = (SELECT max(period) FROM scored) THEN 'test' ELSE 'train' END AS role
          FROM scored),
train AS (SELECT * FROM split WHERE role = 'train'),
test AS (SELECT * FROM split WHERE role = 'test')"""


# --------------------------------------------------------------------------- E2–E4

@query("confusion_matrix", with_ctes(SCORED_SQL) + f"SELECT {confusion_sql('y', PRED)} FROM scored")
def confusion_matrix(spark, d):
    return metrics.confusion(scored(spark, d), "y", metrics.predicted("p", T))


@query("classification_metrics", with_ctes(SCORED_SQL, f"c AS (SELECT {confusion_sql('y', PRED)} FROM scored)")
       + f"SELECT tn, fp, fn, tp, {prf_sql()}, tn + fp + fn + tp AS support FROM c")
def classification_metrics(spark, d):
    return metrics.classification_metrics(scored(spark, d), "y", metrics.predicted("p", T))


@query("brier_score", with_ctes(SCORED_SQL) + "SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM scored")
def brier_score(spark, d):
    return metrics.brier_score(scored(spark, d), "y", "p").select(rnd("brier", 6).alias("brier"))


# --------------------------------------------------------------------------- curves

def _auc_sql(src: str, label: str) -> str:
    return f"""SELECT '{label}' AS dataset, round(
      CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
           THEN sum(pos * ((n_neg - fp) + neg / 2.0)) / (max(n_pos) * max(n_neg)) END, 6) AS auc
    FROM {src}"""


@query("roc_auc", with_ctes(SCORED_SQL, SCORED_TIES_SQL, SCORED_LABELS_SQL,
                            curve_ctes("scored", "c1"), curve_ctes("scored_ties", "c2"),
                            curve_ctes("scored_labels", "c3"))
       + " UNION ALL ".join([_auc_sql("c1", "scored"), _auc_sql("c2", "scored_ties"),
                             _auc_sql("c3", "scored_labels")]))
def roc_auc(spark, d):
    parts = [("scored", scored(spark, d)), ("scored_ties", scored_ties(spark, d)),
             ("scored_labels", scored_labels(spark, d))]
    out = None
    for name, df in parts:
        a = curve.roc_auc(df, "y", "p").select(F.lit(name).alias("dataset"), rnd("auc", 6).alias("auc"))
        out = a if out is None else out.unionByName(a)
    return out


ROC_SQL = with_ctes(SCORED_SQL, curve_ctes("scored"), """
pts AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS i,
               count(*) OVER () AS n_pts,
               lead(pos) OVER (ORDER BY threshold DESC) AS pos_next,
               lead(neg) OVER (ORDER BY threshold DESC) AS neg_next
        FROM curve)""") + """
SELECT threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM pts
WHERE n_pos > 0 AND n_neg > 0
  AND (i = 0 OR i = n_pts - 1 OR n_pts <= 2 OR pos_next <> pos OR neg_next <> neg)
UNION ALL
SELECT NULL, 0.0, 0.0 FROM pts WHERE i = 0 AND n_pos > 0 AND n_neg > 0"""


@query("roc_curve", ROC_SQL)
def roc_curve(spark, d):
    r = curve.roc_curve(scored(spark, d), "y", "p")
    return r.select("threshold", rnd("fpr", 6).alias("fpr"), rnd("tpr", 6).alias("tpr"))


@query("pr_curve", with_ctes(SCORED_SQL, curve_ctes("scored"), curve_metrics()) + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve_f
UNION ALL SELECT NULL, 1.0, 0.0 FROM (SELECT 1 FROM curve_f LIMIT 1)""")
def pr_curve(spark, d):
    r = curve.pr_curve(scored(spark, d), "y", "p")
    return r.select("threshold", rnd("precision", 6).alias("precision"), rnd("recall", 6).alias("recall"))


def _edges_list(n: int, inner: bool = True) -> str:
    e = curve._edges(n)
    e = e[1:-1] if inner else e
    return "[" + ", ".join(dbl(x) for x in e) + "]"


@query("calibration_curve", with_ctes(SCORED_SQL, f"""
b AS (SELECT CAST(len(list_filter({_edges_list(10)}, lambda e: e < p)) AS INTEGER) AS bin, p, y FROM scored
      WHERE p IS NOT NULL)""") + """
SELECT bin, round(avg(p), 4) AS mean_predicted, round(avg(y), 4) AS fraction_positive, count(*) AS n
FROM b WHERE (SELECT count(DISTINCT y) FROM b) >= 2 GROUP BY bin""")
def calibration_curve(spark, d):
    c = curve.calibration_curve(scored(spark, d), "y", "p")
    return c.select("bin", rnd("mean_predicted", 4).alias("mean_predicted"),
                    rnd("fraction_positive", 4).alias("fraction_positive"), "n")


@query("score_histogram", with_ctes(SCORED_SQL, f"""
b AS (SELECT CAST(len(list_filter({_edges_list(20)}, lambda e: e <= p)) AS INTEGER) AS bin, y FROM scored
      WHERE p BETWEEN 0.0 AND 1.0),
dom AS (SELECT CAST(i AS INTEGER) AS bin, {_edges_list(20, False)}[i + 1] AS bin_lo,
               {_edges_list(20, False)}[i + 2] AS bin_hi FROM range(20) t(i))""") + """
SELECT dom.bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi,
       CAST(coalesce(sum(y), 0) AS BIGINT) AS positive, CAST(coalesce(sum(1 - y), 0) AS BIGINT) AS negative
FROM dom LEFT JOIN b ON dom.bin = b.bin GROUP BY dom.bin, bin_lo, bin_hi""")
def score_histogram(spark, d):
    h = curve.score_histogram(scored(spark, d), "y", "p")
    return h.select("bin", rnd("bin_lo", 6).alias("bin_lo"), rnd("bin_hi", 6).alias("bin_hi"),
                    "positive", "negative")


def _grid_sql(n: int = 50) -> str:
    g = [k * (1.0 / (n - 1)) for k in range(n - 1)] + [1.0]
    return "[" + ", ".join(dbl(x) for x in g) + "]"


@query("threshold_grid", with_ctes(SCORED_SQL, f"""
grid AS (SELECT unnest({_grid_sql()}) AS threshold),
c AS (SELECT g.threshold, count(*) FILTER (WHERE s.p >= g.threshold AND s.y = 1) AS tp,
             count(*) FILTER (WHERE s.p >= g.threshold AND s.y = 0) AS fp,
             count(*) FILTER (WHERE s.p < g.threshold AND s.y = 1) AS fn
      FROM grid g, scored s WHERE s.p IS NOT NULL GROUP BY g.threshold)""") + f"""
SELECT round(threshold, 6) AS threshold, {prf_sql(digits=6)} FROM c""")
def threshold_grid(spark, d):
    g = curve.threshold_grid(scored(spark, d), "y", "p")
    return g.select(*[rnd(c, 6).alias(c) for c in ("threshold", "recall", "precision", "f1")])


@query("threshold_curve", with_ctes(SCORED_SQL, curve_ctes("scored"))
       + "SELECT threshold, tp, fp, fn, tn FROM curve")
def threshold_curve(spark, d):
    return curve.threshold_counts(scored(spark, d), "y", "p").select("threshold", "tp", "fp", "fn", "tn")


# --------------------------------------------------------------------------- threshold choice

def _r6(df, cols):
    return df.select(*[rnd(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("threshold_best_f1", with_ctes(SCORED_SQL, curve_ctes("scored"), curve_metrics()) + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM curve_f ORDER BY f1 DESC, threshold ASC LIMIT 1""")
def threshold_best_f1(spark, d):
    return _r6(curve.best_f1_threshold(scored(spark, d), "y", "p"), {"precision", "recall", "f1"})


@query("threshold_max_recall", with_ctes(SCORED_SQL, curve_ctes("scored"), curve_metrics()) + f"""
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       precision >= {dbl(curve.MIN_PRECISION)} AS constraint_met
FROM curve_f
ORDER BY CASE WHEN precision >= {dbl(curve.MIN_PRECISION)} THEN 0 ELSE 1 END,
         CASE WHEN precision >= {dbl(curve.MIN_PRECISION)} THEN recall END DESC NULLS LAST,
         CASE WHEN precision >= {dbl(curve.MIN_PRECISION)} THEN f1 END DESC NULLS LAST, threshold ASC
LIMIT 1""")
def threshold_max_recall(spark, d):
    return _r6(curve.max_recall_threshold(scored(spark, d), "y", "p"), {"precision", "recall", "f1"})


@query("threshold_min_cost", with_ctes(SCORED_SQL, curve_ctes("scored", extra=[T])) + """
SELECT threshold, CAST(3.0 * fn + 1.0 * fp AS DOUBLE) AS cost, fn, fp FROM curve ORDER BY cost ASC, threshold ASC
LIMIT 1""")
def threshold_min_cost(spark, d):
    c = curve.min_cost_threshold(scored(spark, d), "y", "p")
    return c.select("threshold", F.col("cost").cast("double").alias("cost"), "fn", "fp")


def _fair_ctes() -> str:
    return curve_ctes("scored") + "," + curve_metrics() + """,
grp_g AS (SELECT grp, CAST(p AS DOUBLE) AS threshold, CAST(sum(y) AS BIGINT) AS pos,
                 CAST(count(*) - sum(y) AS BIGINT) AS neg
          FROM scored WHERE p IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2),
grps AS (SELECT grp, sum(pos) AS gp, sum(neg) AS gn FROM grp_g GROUP BY grp),
dense AS (SELECT g.grp, c.threshold, coalesce(x.pos, 0) AS pos, coalesce(x.neg, 0) AS neg
          FROM curve_g c CROSS JOIN grps g
          LEFT JOIN grp_g x ON x.grp = g.grp AND x.threshold = c.threshold),
gcum AS (SELECT d.grp, d.threshold,
                sum(d.pos) OVER (PARTITION BY d.grp ORDER BY d.threshold DESC) AS tp,
                sum(d.neg) OVER (PARTITION BY d.grp ORDER BY d.threshold DESC) AS fp,
                gs.gp, gs.gn
         FROM dense d JOIN grps gs ON gs.grp = d.grp),
grates AS (SELECT threshold, grp,
                  CASE WHEN gn = 0 THEN 0.0 ELSE fp / gn END * 100.0 AS fpr,
                  CASE WHEN gp = 0 THEN 0.0 ELSE (gp - tp) / gp END * 100.0 AS fnr FROM gcum),
gaps AS (SELECT threshold, max(fpr) AS max_fpr, max(fnr) AS max_fnr,
                max(fpr) - min(fpr) AS gap_fpr, max(fnr) - min(fnr) AS gap_fnr FROM grates GROUP BY threshold),
feasible AS (SELECT f.threshold, f.precision, f.recall, f.f1, g.gap_fpr, g.gap_fnr, g.max_fpr, g.max_fnr
             FROM curve_f f JOIN gaps g ON g.threshold = f.threshold
             WHERE f.recall >= 0.6 AND f.precision >= 0.5 AND g.gap_fpr <= 10.0 AND g.gap_fnr <= 10.0
               AND g.max_fpr <= 40.0 AND g.max_fnr <= 10.0),
fair_pick AS (SELECT *, 'fairness_f1' AS strategy, 0 AS prio FROM feasible
              ORDER BY recall DESC, gap_fpr ASC, precision DESC, threshold ASC LIMIT 1),
f1_pick AS (SELECT threshold, precision, recall, f1, CAST(NULL AS DOUBLE) AS gap_fpr,
                   CAST(NULL AS DOUBLE) AS gap_fnr, CAST(NULL AS DOUBLE) AS max_fpr,
                   CAST(NULL AS DOUBLE) AS max_fnr, 'f1' AS strategy, 1 AS prio
            FROM curve_f ORDER BY f1 DESC, threshold ASC LIMIT 1),
fair AS (SELECT * FROM (SELECT * FROM fair_pick UNION ALL SELECT * FROM f1_pick) ORDER BY prio LIMIT 1)"""


@query("threshold_fair", with_ctes(SCORED_SQL, _fair_ctes()) + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(gap_fpr, 6) AS gap_fpr, round(gap_fnr, 6) AS gap_fnr, round(max_fpr, 6) AS max_fpr,
       round(max_fnr, 6) AS max_fnr, strategy FROM fair""")
def threshold_fair(spark, d):
    f = curve.fair_threshold(scored(spark, d), "y", "p", "grp")
    return _r6(f, {"precision", "recall", "f1", "gap_fpr", "gap_fnr", "max_fpr", "max_fnr"})


@query("threshold_strategies", with_ctes(SCORED_SQL, _fair_ctes(), f"""
picks AS (
  SELECT 'f1' AS strategy, threshold FROM curve_f ORDER BY f1 DESC, threshold ASC LIMIT 1),
picks_r AS (
  SELECT 'recall' AS strategy, threshold FROM curve_f
  ORDER BY CASE WHEN precision >= 0.5 THEN 0 ELSE 1 END,
           CASE WHEN precision >= 0.5 THEN recall END DESC NULLS LAST,
           CASE WHEN precision >= 0.5 THEN f1 END DESC NULLS LAST, threshold ASC LIMIT 1),
cost_rows AS (SELECT threshold FROM curve_g UNION SELECT {TS}),
cost_eval AS (SELECT c.threshold,
                     3.0 * count(*) FILTER (WHERE s.y = 1 AND s.p < c.threshold)
                     + 1.0 * count(*) FILTER (WHERE s.y = 0 AND s.p >= c.threshold) AS cost
              FROM cost_rows c, scored s GROUP BY c.threshold),
picks_c AS (SELECT 'cost' AS strategy, threshold FROM cost_eval ORDER BY cost ASC, threshold ASC LIMIT 1),
picks_f AS (SELECT 'fairness_f1' AS strategy, threshold FROM fair),
allp AS (SELECT * FROM picks UNION ALL SELECT * FROM picks_r UNION ALL SELECT * FROM picks_c
         UNION ALL SELECT * FROM picks_f),
m AS (SELECT a.strategy, a.threshold,
             count(*) FILTER (WHERE s.y = 1 AND s.p >= a.threshold) AS tp,
             count(*) FILTER (WHERE s.y = 0 AND s.p >= a.threshold) AS fp,
             count(*) FILTER (WHERE s.y = 1 AND s.p < a.threshold) AS fn
      FROM allp a, scored s WHERE s.p IS NOT NULL GROUP BY a.strategy, a.threshold)""") + f"""
SELECT strategy, threshold, {prf_sql()},
       strategy = (SELECT CASE WHEN strategy = 'fairness_f1' THEN 'fairness_f1' ELSE 'f1' END FROM fair)
         AS is_active
FROM m""")
def threshold_strategies(spark, d):
    s = curve.threshold_strategies(scored(spark, d), "y", "p", "grp")
    return s.select("strategy", "threshold", *[rnd(c, 4).alias(c) for c in ("precision", "recall", "f1")],
                    "is_active")


# --------------------------------------------------------------------------- fairness & groups

@query("fairness_gaps", with_ctes(SCORED_SQL, f"""
c AS (SELECT grp, {confusion_sql('y', PRED)} FROM scored WHERE grp IS NOT NULL GROUP BY grp),
r AS (SELECT grp, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END * 100.0 AS fpr,
             CASE WHEN fn + tp = 0 THEN 0.0 ELSE fn / (fn + tp) END * 100.0 AS fnr FROM c)""") + """
SELECT grp, round(fpr, 4) AS fpr, round(fnr, 4) AS fnr,
       round(max(fpr) OVER () - min(fpr) OVER (), 4) AS gap_fpr,
       round(max(fnr) OVER () - min(fnr) OVER (), 4) AS gap_fnr,
       round(max(fpr) OVER (), 4) AS max_fpr, round(max(fnr) OVER (), 4) AS max_fnr FROM r""")
def fairness_gaps(spark, d):
    f = metrics.fairness_gaps(scored(spark, d), "y", metrics.predicted("p", T), "grp")
    return f.select("grp", *[rnd(c, 4).alias(c) for c in
                             ("fpr", "fnr", "gap_fpr", "gap_fnr", "max_fpr", "max_fnr")])


@query("group_metrics", with_ctes(SCORED_SQL, f"""
long AS (SELECT 'grp' AS dimension, CAST(grp AS VARCHAR) AS value, y, {PRED} AS yh FROM scored
         UNION ALL SELECT 'status', CAST(status AS VARCHAR), y, {PRED} FROM scored),
c AS (SELECT dimension, value, {confusion_sql('y', 'yh')} FROM long WHERE value IS NOT NULL
      GROUP BY dimension, value)""") + f"""
SELECT dimension, value, {prf_sql()}, tn + fp + fn + tp AS support FROM c""")
def group_metrics(spark, d):
    return metrics.group_metrics(scored(spark, d), "y", metrics.predicted("p", T), ["grp", "status"])


@query("majority_baseline", with_ctes(SCORED_SQL, SPLIT_SQL, f"""
maj AS (SELECT CAST(y AS INTEGER) AS majority_class FROM train GROUP BY y ORDER BY count(*) DESC, y ASC LIMIT 1),
c AS (SELECT {confusion_sql('y', '(SELECT majority_class FROM maj)')} FROM test)""") + f"""
SELECT (SELECT majority_class FROM maj) AS majority_class, {prf_sql()} FROM c""")
def majority_baseline(spark, d):
    train, test = _split(spark, d)
    return metrics.majority_baseline(train, test, "y")


def _auc_grouped_sql(src: str, group: str) -> str:
    return (curve_ctes(src, "ac", group=group) + f""",
auc AS (SELECT {group}, CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
           THEN sum(pos * ((n_neg - fp) + neg / 2.0)) / (max(n_pos) * max(n_neg)) END AS auc
        FROM ac GROUP BY {group})""")


@query("overfit_gap", with_ctes(SCORED_SQL, SPLIT_SQL, f"""
c AS (SELECT role, {confusion_sql('y', PRED)} FROM split GROUP BY role),
m AS (SELECT role, {prf_sql()} FROM c)""", _auc_grouped_sql("split", "role")) + """
SELECT tr.f1 AS f1_train, tr.precision AS precision_train, tr.recall AS recall_train,
       round(atr.auc, 4) AS auc_train, te.f1 AS f1_test, round(ate.auc, 4) AS auc_test,
       round(tr.f1 - te.f1, 4) AS overfit_gap_f1
FROM m tr, m te, auc atr, auc ate
WHERE tr.role = 'train' AND te.role = 'test' AND atr.role = 'train' AND ate.role = 'test'""")
def overfit_gap(spark, d):
    s = temporal.temporal_split(scored(spark, d), "period")
    m = metrics.classification_metrics(s, "y", metrics.predicted("p", T), "role")
    a = curve.roc_auc(s, "y", "p", "role")
    j = m.join(a, "role")
    tr = j.where(F.col("role") == "train").select(
        F.col("f1").alias("f1_train"), F.col("precision").alias("precision_train"),
        F.col("recall").alias("recall_train"), rnd("auc", 4).alias("auc_train"))
    te = j.where(F.col("role") == "test").select(F.col("f1").alias("f1_test"),
                                                 rnd("auc", 4).alias("auc_test"))
    return tr.crossJoin(te).withColumn("overfit_gap_f1", rnd(F.col("f1_train") - F.col("f1_test"), 4))


# --------------------------------------------------------------------------- decisions

MARGINS = {"1-URGENT": 0.03, "2-HIGH": 0.02}


@query("score_decision", with_ctes(SCORED_SQL, VERSIONS_SCORED_SQL, f"""
r AS (SELECT s.*, coalesce(h.version, 'unknown') AS model_version, coalesce(h.risk_threshold, {TS}) AS t
      FROM scored s LEFT JOIN held h ON s.period >= h.valid_from AND (h.valid_to IS NULL OR s.period < h.valid_to)),
x AS (SELECT id, p, t, model_version, CAST(p >= t AS INTEGER) AS prediction,
             CASE trim(grp) WHEN '1-URGENT' THEN 0.03 WHEN '2-HIGH' THEN 0.02 ELSE 0.02 END AS m FROM r)""")
       + """
SELECT id, round(p, 4) AS probability, prediction, model_version, t AS risk_threshold,
       CASE WHEN prediction = 1 THEN 'high risk' ELSE 'low risk' END AS risk_label,
       CASE WHEN p < 0.3 THEN 'low' WHEN p < t THEN 'medium' ELSE 'high' END AS segment,
       coalesce(m > 0 AND p >= greatest(0.0, t - m) AND p <= least(1.0, t + m), false) AS review
FROM x""")
def score_decision(spark, d):
    """Each row by the model version in force in its period."""
    s = registry.in_force(scored(spark, d), "period", versions_scored(spark, d))
    t = F.col("risk_threshold")
    pred = dec.decision("p", t)
    m = dec.margin_for("grp", MARGINS)
    return s.select("id", rnd("p", 4).alias("probability"), pred.alias("prediction"), "model_version", "risk_threshold",
                    dec.risk_label(pred).alias("risk_label"), dec.segment("p", t).alias("segment"),
                    dec.review_band("p", t, m).alias("review"))


@query("promotion_gate", with_ctes(SCORED_SQL, SPLIT_SQL, f"""
c AS (SELECT grp, role, {confusion_sql('y', PRED)} FROM split GROUP BY grp, role),
m AS (SELECT grp, role, {prf_sql()} FROM c)""") + """
SELECT cand.grp, cand.f1 AS candidate_f1, cand.recall AS candidate_recall, cur.f1 AS current_f1,
       CASE WHEN cand.recall < 0.6 THEN false WHEN cur.f1 IS NULL THEN true
            ELSE cand.f1 >= cur.f1 * 0.95 END AS promote,
       CASE WHEN cand.recall < 0.6 THEN 'recall_below_minimum' WHEN cur.f1 IS NULL THEN 'no_current_model'
            WHEN cand.f1 >= cur.f1 * 0.95 THEN 'f1_within_tolerance' ELSE 'f1_regression' END AS reason
FROM m cand LEFT JOIN m cur ON cur.grp = cand.grp AND cur.role = 'train'
WHERE cand.role = 'test'""")
def promotion_gate(spark, d):
    s = temporal.temporal_split(scored(spark, d), "period")
    m = metrics.classification_metrics(s, "y", metrics.predicted("p", T), ["grp", "role"])
    cand = m.where(F.col("role") == "test").select("grp", "f1", "recall")
    cur = m.where(F.col("role") == "train").select("grp", "f1", "recall")
    return metrics.promotion_gate(cand, cur, ["grp"])


# --------------------------------------------------------------------------- temporal CV (scores given)

def cv_metrics(spark, d):
    """Per expanding-window fold: F1-best threshold on the validation period,
    then its confusion metrics and AUC, all from one curve."""
    s = scored(spark, d)
    val = temporal.validation_rows(s, "period")
    c = curve.with_curve_metrics(curve.threshold_counts(val, "y", "p", "fold"))
    best = c.groupBy("fold").agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "tn"),
                                          F.struct(F.col("f1"), -F.col("threshold"))).alias("b"),
                                 curve.auc_of_counts().alias("auc"))
    best = best.select("fold", "b.*", "auc")
    sizes = temporal.fold_sums(s, "period", {"size": F.lit(1)}).select("fold", "val_period", "train_size", "val_size")
    return (best.join(sizes, "fold")
            .select("fold", "val_period", rnd("threshold", 4).alias("threshold"),
                    *metrics.prf(F.col("tp"), F.col("fp"), F.col("fn")),
                    rnd("auc", 4).alias("auc"), "train_size", "val_size"))


CV_CTES = """
periods AS (SELECT period, row_number() OVER (ORDER BY period) AS pi FROM (SELECT DISTINCT period FROM scored
            WHERE period IS NOT NULL)),
val AS (SELECT s.*, CAST(pi - 1 AS INTEGER) AS fold FROM scored s JOIN periods USING (period) WHERE pi >= 2),""" + \
    curve_ctes("val", "vc", group="fold") + """,
vm AS (SELECT *, CASE WHEN n_pos = 0 THEN 1.0 ELSE tp / n_pos END AS recall_c,
              CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision_c FROM vc),
vf AS (SELECT *, (2.0 * precision_c * recall_c) / (precision_c + recall_c + 1e-9) AS f1_c FROM vm),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1_c DESC, threshold ASC) AS rn
                        FROM vf) WHERE rn = 1),
vauc AS (SELECT fold, CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
           THEN sum(pos * ((n_neg - fp) + neg / 2.0)) / (max(n_pos) * max(n_neg)) END AS auc FROM vc GROUP BY fold),
psize AS (SELECT period, pi, count(*) AS n FROM scored JOIN periods USING (period) GROUP BY period, pi),
sizes AS (SELECT p.pi, p.period, p.n, sum(q.n) AS cum FROM psize p JOIN psize q ON q.pi <= p.pi
          GROUP BY p.pi, p.period, p.n),
cv AS (SELECT b.fold, vs.period AS val_period, round(b.threshold, 4) AS threshold,
              """ + prf_sql() + """, round(a.auc, 4) AS auc, CAST(ts.cum AS BIGINT) AS train_size,
              vs.n AS val_size
       FROM best b JOIN vauc a ON a.fold = b.fold JOIN sizes ts ON ts.pi = b.fold
       JOIN sizes vs ON vs.pi = b.fold + 1)"""


@query("cv_metrics_by_fold", with_ctes(SCORED_SQL, CV_CTES) + "SELECT * FROM cv")
def cv_metrics_by_fold(spark, d):
    return cv_metrics(spark, d)


FOLD_SUMMARY_CTES = """
cvl AS (SELECT 'recall' AS metric, recall AS v FROM cv UNION ALL SELECT 'precision', precision FROM cv
        UNION ALL SELECT 'f1', f1 FROM cv UNION ALL SELECT 'auc', auc FROM cv),
fs AS (SELECT metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min,
              round(max(v), 4) AS max, round(max(v) - min(v), 4) AS gap
       FROM cvl WHERE v IS NOT NULL GROUP BY metric)"""


@query("fold_summary", with_ctes(SCORED_SQL, CV_CTES, FOLD_SUMMARY_CTES) + "SELECT * FROM fs")
def fold_summary(spark, d):
    return metrics.fold_summary(cv_metrics(spark, d))


@query("fold_stability", with_ctes(SCORED_SQL, CV_CTES, """
s AS (SELECT round(avg(f1), 4) AS mean_f1, round(stddev_pop(f1), 4) AS std_f1, round(avg(recall), 4) AS mean_recall,
             arg_min(f1, fold) AS first_f1, arg_max(f1, fold) AS last_f1, count(*) AS n_folds FROM cv)""") + """
SELECT n_folds, mean_f1, std_f1,
       round(CASE WHEN mean_f1 = 0 THEN 0.0 ELSE std_f1 / mean_f1 END, 4) AS cv_f1,
       first_f1, last_f1, round(first_f1 - last_f1, 4) AS degradation, mean_recall,
       round(CASE WHEN mean_f1 = 0 THEN 0.0 ELSE std_f1 / mean_f1 END, 4) > 0.15 AS high_variability,
       n_folds > 1 AND first_f1 - last_f1 > 0.15 AS severe_degradation,
       mean_recall < 0.7 AS low_recall
FROM s""")
def fold_stability(spark, d):
    return metrics.fold_stability(cv_metrics(spark, d))


@query("holdout_in_interval", with_ctes(SCORED_SQL, SPLIT_SQL, CV_CTES, FOLD_SUMMARY_CTES, f"""
hc AS (SELECT {confusion_sql('y', PRED)} FROM test),
h AS (SELECT {prf_sql()} FROM hc),
hl AS (SELECT 'f1' AS metric, f1 AS holdout FROM h UNION ALL SELECT 'recall', recall FROM h
       UNION ALL SELECT 'precision', precision FROM h),
per AS (SELECT fs.metric, fs.mean AS cv_mean, fs.std AS cv_std, round(fs.mean - fs.std, 4) AS lower,
               round(fs.mean + fs.std, 4) AS upper, hl.holdout,
               hl.holdout >= fs.mean - fs.std AND hl.holdout <= fs.mean + fs.std AS inside
        FROM fs JOIN hl ON hl.metric = fs.metric WHERE hl.holdout IS NOT NULL)""") + """
SELECT per.*, (SELECT coalesce(bool_and(inside), false) FROM per) AS all_inside FROM per""")
def holdout_in_interval(spark, d):
    summary = metrics.fold_summary(cv_metrics(spark, d))
    _, test = _split(spark, d)
    h = metrics.classification_metrics(test, "y", metrics.predicted("p", T)).select("f1", "recall", "precision")
    return metrics.holdout_in_interval(summary, h)


IMPORTANCE_FEATURES = {"p": "p", "period": "period", "key_mod": "id % 100", "cust": "cust"}


@query("importance_ranking", with_ctes(SCORED_SQL, "imp AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS feature, round(abs(corr(CAST({v} AS DOUBLE), CAST(y AS DOUBLE))), 4) AS importance "
    f"FROM scored" for k, v in IMPORTANCE_FEATURES.items()) + ")") + """
SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature ASC) AS INTEGER) AS rank
FROM imp ORDER BY rank LIMIT 20""")
def importance_ranking(spark, d):
    s = scored(spark, d).select("y", "p", "period", (F.col("id") % 100).alias("key_mod"), "cust")
    long = s.select(F.col("y").cast("double").alias("y"),
                    *[F.col(c).cast("double").alias(c) for c in IMPORTANCE_FEATURES]) \
        .unpivot(["y"], list(IMPORTANCE_FEATURES), "feature", "v")
    imp = long.groupBy("feature").agg(rnd(F.abs(F.corr("v", "y")), 4).alias("importance"))
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # one row per feature
    return (imp.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= 20))


#: Section -> (query key, column of the place, columns), for the document's SQL.
DOCUMENT_PARTS = {
    "confusion_matrix": ("classification_metrics", None, ["tn", "fp", "fn", "tp"]),
    "holdout": ("classification_metrics", None, ["recall", "precision", "f1", "support"]),
    "roc_curve": ("roc_curve", "threshold", ["fpr", "tpr"]),
    "pr_curve": ("pr_curve", "threshold", ["precision", "recall"]),
    "calibration_curve": ("calibration_curve", "bin", ["mean_predicted", "fraction_positive", "n"]),
    "score_distribution": ("score_histogram", "bin", ["bin_lo", "bin_hi", "positive", "negative"]),
    "threshold_tradeoff": ("threshold_grid", "threshold", ["recall", "precision", "f1"]),
}


def _document_sql() -> str:
    rows = [f"SELECT '{s}' AS section, CAST({at or 'NULL'} AS DOUBLE) AS at, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM ({ORACLES[key]})"
            for s, (key, at, cols) in DOCUMENT_PARTS.items() for c in cols]
    rows += [f"SELECT 'holdout', NULL, 'auc', auc FROM ({ORACLES['roc_auc']}) WHERE dataset = 'scored'",
             f"SELECT 'holdout', NULL, 'brier', brier FROM ({ORACLES['brier_score']})"]
    rows += [f"SELECT 'fairness', NULL, '{c}', max({c}) FROM ({ORACLES['fairness_gaps']})" for c in ("gap_fpr", "gap_fnr", "max_fpr", "max_fnr")]
    return "\nUNION ALL ".join(rows)


@query("evaluation_document", _document_sql())
def evaluation_document(spark, d):
    """The whole metrics document of the scored rows, as the metrics sink gets it; calibration means as reported (4 dp)."""
    doc = document.evaluation_document(scored(spark, d), "y", "p", "grp", T)
    four = F.col("section") == "calibration_curve"
    return doc.withColumn("value", F.when(four, rnd("value", 4)).otherwise(F.col("value")))
