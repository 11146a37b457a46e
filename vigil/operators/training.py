"""End-to-end training job (label -> lag features -> leakage guard ->
temporal split -> training statistics -> feature pipeline -> weighted
forest -> threshold strategy -> metrics -> promotion gate) on DataFrames.

The driver holds only one-row results (threshold, gate verdict); scored
tables are written once and reused by every metric.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import curve, document, features, metrics, ml, split, temporal
from vigil.session import checkpoint_dir, written

# fixed values of the reference configuration
LEAKING_COLUMNS = ["INDE", "PEDRA", "DEFASAGEM", "NOTA_PORT", "NOTA_MAT", "NOTA_ING"]


def train_and_evaluate(panel: DataFrame, spec: Mapping, n_trees: int = ml.N_TREES,
                       max_depth: int = ml.MAX_DEPTH, strategy: str = "fairness_f1",
                       current_f1: float | None = None, threshold_source: str = "validation") -> tuple[DataFrame, object]:
    """Returns (metrics long table ``metric, value``, fitted model); the table also holds the
    evaluation document of the test rows (``document.evaluation_document``) under
    ``section:place:name``.

    A quarter of the training keys is held out by hash: a forest fitted on the
    rest scores it, and on these scores the calibration (by Brier) and, with
    ``threshold_source="validation"``, the threshold are chosen, so that the test
    rows only report.  ``"test"`` picks the threshold on the test rows.  The
    returned forest is refitted on all training rows.

    ``spec`` keys: key, period, label_gap / label_index / label_tier, lag_cols,
    leak_cols, start, age, group (sensitive, fairness only), code.
    """
    p = features.derive_label(panel, spec.get("label_gap"), spec.get("label_index"), spec.get("label_tier"),
                              out="label")
    p = temporal.lag_features(p, spec["key"], spec["period"], spec["lag_cols"])
    p = features.drop_present(p, list(spec.get("leak_cols", [])) + LEAKING_COLUMNS)
    spark = panel.sparkSession
    checkpoint_dir(spark)
    # lineage cuts: the statistics and the features read the lagged panel, every fit and metric the tables made of it
    p = temporal.temporal_split(written(p, "panel"), spec["period"])
    train_raw = p.where(F.col("role") == "train")
    # one-row result: materialise it so later plans do not recompute the medians
    stats = features.train_statistics(train_raw, spec["start"], spec["age"], spec["period"])
    stats = spark.createDataFrame([stats.first()], stats.schema)
    priors = [f"{c}_prev" for c in spec["lag_cols"]]
    fspec = {"period": spec["period"], "start": spec["start"], "age": spec["age"], "tenure": "tenure",
             "priors": priors, "flag": "is_new", "group": spec.get("group"), "code": spec.get("code"),
             "keep": [spec["key"], spec["period"], "role", "label", spec.get("group_raw", spec.get("group"))]}
    fspec["keep"] = [c for c in dict.fromkeys(fspec["keep"]) if c and c != spec.get("group")]
    prepared = written(features.process_features(p, fspec, stats=stats), "prepared")
    numeric = [spec["age"], "tenure", *priors, "is_new"]
    categorical = [c for c in [spec.get("code")] if c]
    train = written(ml.balanced_weights(prepared.where(F.col("role") == "train"), "label", spec.get("group")), "train")
    if threshold_source not in ("validation", "test"):
        raise ValueError(f"threshold_source: {threshold_source!r}")
    inner = split.hash_split(train, spec["key"], 75, role="_inner")
    first = ml.fit(inner.where(F.col("_inner") == "train"), numeric, categorical, "label", "weight", n_trees=n_trees, max_depth=max_depth)
    raw_val = written(ml.score(first, inner.where(F.col("_inner") == "test"), categorical), "validation")
    size = raw_val.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    method = "none"
    if size["k"] >= 2 and size["n"] >= ml.CALIBRATION_MIN_ROWS:
        cands = ml.calibration_candidates(raw_val, "label", "p", spec["key"])
        method = ml.choose_calibration(cands, int(size["n"]), int(size["k"])).where("chosen").first()["candidate"]
    calibrated = lambda df: ml.apply_calibration(method, raw_val, df, "label", "p", spec["key"])
    model = ml.fit(train, numeric, categorical, "label", "weight", n_trees=n_trees, max_depth=max_depth)
    scored = written(calibrated(ml.score(model, prepared, categorical)), "scored")
    test = scored.where(F.col("role") == "test")
    tr = scored.where(F.col("role") == "train")
    chosen_on = test if threshold_source == "test" or not size["n"] else written(calibrated(raw_val), "chosen-on")
    grp = spec.get("group")
    if strategy == "fairness_f1" and grp:
        pick = curve.fair_threshold(chosen_on, "label", "p", grp)
    elif strategy == "recall":
        pick = curve.max_recall_threshold(chosen_on, "label", "p").withColumn("strategy", F.lit("recall"))
    elif strategy == "cost":
        pick = curve.min_cost_threshold(chosen_on, "label", "p").withColumn("strategy", F.lit("cost"))
    else:
        pick = curve.best_f1_threshold(chosen_on, "label", "p").withColumn("strategy", F.lit("f1"))
    picked = pick.select("threshold", "strategy").first()
    t = float(picked["threshold"])
    pred = metrics.predicted("p", t)
    m_test = metrics.classification_metrics(test, "label", pred).first()
    m_train = metrics.classification_metrics(tr, "label", pred).first()
    auc = curve.roc_auc(scored, "label", "p", "role").collect()
    auc = {r["role"]: r["auc"] for r in auc}
    brier = metrics.brier_score(test, "label", "p").first()["brier"]
    base = metrics.majority_baseline(tr, test, "label").first()
    promote = (m_test["recall"] >= metrics.MIN_RECALL_GATE and
               (current_f1 is None or m_test["f1"] >= current_f1 * metrics.GATE_F1_RATIO))
    rows = [("threshold", t), ("recall", m_test["recall"]), ("precision", m_test["precision"]),
            ("f1", m_test["f1"]), ("auc", auc.get("test")), ("brier", brier),
            ("tn", m_test["tn"]), ("fp", m_test["fp"]), ("fn", m_test["fn"]), ("tp", m_test["tp"]),
            ("train_recall", m_train["recall"]), ("train_precision", m_train["precision"]), ("train_f1", m_train["f1"]), ("train_auc", auc.get("train")),
            ("overfit_gap_f1", round(m_train["f1"] - m_test["f1"], 4)),
            ("baseline_f1", base["f1"]), ("baseline_recall", base["recall"]),
            ("baseline_precision", base["precision"]), ("promote", float(promote)),
            ("train_rows", m_train["support"]), ("test_rows", m_test["support"]), ("validation_rows", size["n"]),
            (f"calibration:{method}", 1.0), (f"threshold_source:{threshold_source}", 1.0), (f"strategy:{picked['strategy']}", 1.0)]
    interval = metrics.bootstrap_f1(test, "label", pred).first()
    rows += [(c, interval[c]) for c in ("f1_mean", "f1_std", "f1_low", "f1_high")]
    if grp:
        for r in metrics.group_metrics(test, "label", pred, [grp]).collect():
            rows += [(f"group:{r['value']}:{c}", r[c]) for c in ("recall", "precision", "f1", "support")]
    rows += [(f"importance:{n}", v) for n, v in ml.feature_importance(model, numeric, categorical)]
    out = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "metric string, value double")
    # curves, distributions and trade-offs of the test rows: a few values a section and distinct score
    doc = written(document.evaluation_document(test, "label", "p", grp, t, train=tr), "document")
    name = F.concat_ws(":", "section", F.col("at").cast("string"), "name")
    return out.unionByName(doc.select(name.alias("metric"), "value")), model


def cross_validate(panel: DataFrame, spec: Mapping, n_trees: int = ml.N_TREES,
                   max_depth: int = ml.MAX_DEPTH) -> DataFrame:
    """Expanding-window temporal CV with a model per fold.

    Label, lags and the leakage guard run once (lineage cut by a reliable
    checkpoint).  For each fold — one row of the fold table, so the loop
    length is the number of periods − 1 — statistics come from the fold's
    training periods only, the forest is fitted (distributed), the F1-best
    threshold is chosen on the validation period and its metrics and AUC are
    recorded.  Folds are selected by period predicates, never by position.
    Output: ``fold, train_max, val_period, threshold, recall, precision, f1,
    auc, train_size, val_size``."""
    spark = panel.sparkSession
    checkpoint_dir(spark)
    per = spec["period"]
    p = features.derive_label(panel, spec.get("label_gap"), spec.get("label_index"), spec.get("label_tier"),
                              out="label")
    p = temporal.lag_features(p, spec["key"], per, spec["lag_cols"])
    p = features.drop_present(p, list(spec.get("leak_cols", [])) + LEAKING_COLUMNS).checkpoint(eager=True)
    priors = [f"{c}_prev" for c in spec["lag_cols"]]
    numeric = [spec["age"], "tenure", *priors, "is_new"]
    categorical = [c for c in [spec.get("code")] if c]
    fspec = {"period": per, "start": spec["start"], "age": spec["age"], "tenure": "tenure", "priors": priors,
             "flag": "is_new", "group": spec.get("group"), "code": spec.get("code"),
             "keep": [spec["key"], per, "label"]}
    rows = []
    for f in temporal.fold_table(p, per).orderBy("fold").collect():
        train = p.where(F.col(per) <= f["train_max"])
        val = p.where(F.col(per) == f["val_period"])
        st = features.train_statistics(train, spec["start"], spec["age"], per)
        st = spark.createDataFrame([st.first()], st.schema)
        tr = ml.balanced_weights(features.process_features(train, fspec, stats=st), "label", spec.get("group"))
        model = ml.fit(tr, numeric, categorical, "label", "weight", n_trees=n_trees, max_depth=max_depth)
        sc = ml.score(model, features.process_features(val, fspec, stats=st), categorical).persist()
        try:
            t = float(curve.best_f1_threshold(sc, "label", "p").first()["threshold"])
            m = metrics.classification_metrics(sc, "label", metrics.predicted("p", t)).first()
            auc = curve.roc_auc(sc, "label", "p").first()["auc"]
            rows.append((int(f["fold"]), int(f["train_max"]), int(f["val_period"]), round(t, 4), m["recall"],
                         m["precision"], m["f1"], None if auc is None else round(float(auc), 4),
                         int(train.count()), int(m["support"])))
        finally:
            sc.unpersist()
    return spark.createDataFrame(rows, "fold int, train_max int, val_period int, threshold double, recall double, "
                                       "precision double, f1 double, auc double, train_size long, val_size long")
