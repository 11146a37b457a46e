import tempfile

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import metrics, ml, split, training
from vigil.sources import artifacts

SPEC = {"key": "entity_id", "period": "period", "label_gap": None, "label_index": "idx",
        "lag_cols": ["idx", "act"], "leak_cols": ["idx", "bal"], "start": "start_period", "age": "age",
        "group": "grp_class", "code": "code"}


def _panel(spark, d):
    from vigil.plans.bindings import panel
    return panel(spark, d).withColumn("grp_class", F.col("grp")).withColumn("code", F.col("grp"))


def test_cross_validate_folds_and_no_leakage(spark, small_dir):
    p = _panel(spark, small_dir)
    folds = training.cross_validate(p, SPEC, n_trees=5, max_depth=3)
    rows = folds.collect()
    n_periods = p.select("period").distinct().count()
    assert len(rows) == n_periods - 1
    assert all(r["train_max"] < r["val_period"] for r in rows)
    assert all(0.0 <= r["f1"] <= 1.0 for r in rows)
    s = {r["metric"] for r in metrics.fold_summary(folds).collect()}
    assert {"recall", "precision", "f1"} <= s


def test_train_promote_and_load(spark, small_dir):
    out, model = training.train_and_evaluate(_panel(spark, small_dir), SPEC, n_trees=5, max_depth=3)
    m = {r["metric"]: r["value"] for r in out.collect()}
    assert 0.0 <= m["threshold"] <= 1.0 and m["train_rows"] > 0 and m["test_rows"] > 0
    assert m["validation_rows"] > 0 and m["threshold_source:validation"] == 1.0
    assert m["tn"] + m["fp"] + m["fn"] + m["tp"] == m["test_rows"] and m["f1_low"] <= m["f1_high"]
    assert sum(k.startswith("calibration:") for k in m) == 1 and any(k.startswith("group:") for k in m)
    base, reg = tempfile.mkdtemp(prefix="vigil-models-"), tempfile.mkdtemp(prefix="vigil-reg-") + "/registry"
    assert artifacts.current_model(spark, reg) == (None, None)
    v = artifacts.promote_model(model, base, reg, m["f1"], m["recall"], version="v2024.01.01")
    loaded, info = artifacts.current_model(spark, reg)
    assert info["version"] == v and loaded is not None


def test_statistics_roundtrip_and_unreadable(spark):
    d = tempfile.mkdtemp(prefix="vigil-stats-")
    st = spark.createDataFrame([(2021, 10)], artifacts.STATS_SCHEMA)
    artifacts.write_statistics(st, f"{d}/stats")
    assert artifacts.read_statistics(spark, f"{d}/stats").first()["median_start"] == 2021
    assert artifacts.read_statistics(spark, f"{d}/missing").count() == 0


def test_stratified_split_exact_per_class(spark, small_dir):
    from vigil.plans.bindings import scored
    s = split.stratified_split(scored(spark, small_dir), "y", "id")
    per = {(r["y"], r["role"]): r["n"] for r in s.groupBy("y", "role").count().withColumnRenamed("count", "n").collect()}
    for y in (0, 1):
        n = per.get((y, "train"), 0) + per.get((y, "test"), 0)
        assert per.get((y, "train"), 0) == int(n * 0.8)


def test_calibration_choice_shape(spark, small_dir):
    from vigil.plans.bindings import scored
    s = scored(spark, small_dir)
    c = ml.choose_calibration(ml.calibration_candidates(s, "y", "p", "id"), s.count(), 2).collect()
    assert {r["candidate"] for r in c} == {"none", "sigmoid", "isotonic"} and sum(r["chosen"] for r in c) == 1
    tiny = ml.choose_calibration(ml.calibration_candidates(s, "y", "p", "id"), 10, 2).collect()
    assert [r["candidate"] for r in tiny if r["chosen"]] == ["none"]


def test_document_has_every_section_and_reaches_the_sink(spark, small_dir):
    from vigil.operators import curve, document
    from vigil.plans.bindings import scored
    d = scored(spark, small_dir)
    doc = document.evaluation_document(d, "y", "p", "grp", 0.5, train=d)
    rows = doc.collect()
    by = {}
    for r in rows:
        by.setdefault(r["section"], []).append(r)
    assert {"confusion_matrix", "holdout", "roc_curve", "pr_curve", "calibration_curve", "score_distribution", "threshold_tradeoff", "fairness", "train"} == set(by)
    assert len(by["threshold_tradeoff"]) == 150 and len(by["score_distribution"]) == 80 and len(by["fairness"]) == 4
    assert next(r["value"] for r in by["train"] if r["name"] == "overfit_gap_f1") == 0.0
    assert sum(r["value"] for r in by["confusion_matrix"]) == d.count()
    path = tempfile.mkdtemp(prefix="vigil-doc-") + "/metrics"
    why, cost = curve.REASONS["cost"]
    artifacts.append_metrics(document.with_version(doc, "v1", {"strategy": "cost", "justification": why, "tradeoff": cost}), path)
    artifacts.append_metrics(document.with_version(doc, "v2"), path)
    back = spark.read.parquet(path)
    assert {r["version"]: r["count"] for r in back.groupBy("version").count().collect()} == {"v1": len(rows) + 3, "v2": len(rows)}
    assert back.where("version = 'v1' and name = 'strategy'").first()["text"] == "cost"


def test_isotonic_candidates_see_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(ml, "ISOTONIC_MAX_ROWS", 300)
    df = spark.range(3000).select("id", (F.rand(1) < 0.5).cast("int").alias("y"), F.rand(2).alias("p"))
    assert 200 < ml._bounded(df, "id").count() < 400
    assert {r["candidate"] for r in ml.calibration_candidates(df, "y", "p", "id").collect()} == {"none", "sigmoid", "isotonic"}


def _pooled(p, y):
    """Isotonic fit of all points by pooling adjacent violators: (score, value) per point, ascending."""
    at = sorted(set(p))
    sums = [[sum(b for a, b in zip(p, y) if a == v), sum(a == v for a in p), 1] for v in at]
    blocks = []
    for s in sums:
        blocks.append(s)
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return at, [b[0] / b[1] for b in blocks for _ in range(b[2])]


def test_isotonic_fits_take_every_row(spark, monkeypatch):
    monkeypatch.setattr(ml, "ISOTONIC_MAX_ROWS", 100)  # a bound that a fit on a share of the rows would keep
    monkeypatch.setattr(ml, "ISOTONIC_TASK_ROWS", 300, raising=False)
    df = spark.range(1500).select("id", F.round(F.rand(2), 3).alias("p")).withColumn("y", (F.rand(1) < F.col("p")).cast("int")).cache()
    df.count()
    parts = {r: [(x["p"], x["y"]) for x in split.hash_split(df, "id", 80, ml.SEED).where(F.col("role") == r).collect()] for r in ("train", "test")}
    at, value = _pooled(*zip(*parts["train"]))
    want = sum((np.interp(p, at, value) - y) ** 2 for p, y in parts["test"]) / len(parts["test"])
    got = {r["candidate"]: r["brier"] for r in ml.calibration_candidates(df, "y", "p", "id").collect()}
    assert abs(got["isotonic"] - want) < 1e-9
    at, value = _pooled(*zip(*[(r["p"], r["y"]) for r in df.collect()]))
    fitted = dict(zip(at, value))
    out = ml.apply_calibration("isotonic", df, df.select("id", "p", F.col("p").alias("was")), "y", "p", "id").collect()
    assert len(out) == 1500 and all(abs(r["p"] - fitted[r["was"]]) < 1e-9 for r in out)
