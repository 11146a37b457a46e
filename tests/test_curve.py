import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators import curve, metrics
from vigil.operators.ordered import count_below, count_less, cut_points, exact_quantiles, ranges_for, running_sums


def _df(spark, y, p, g=None):
    if g is None:
        return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    return spark.createDataFrame([(int(a), float(b), c) for a, b, c in zip(y, p, g)], "y int, p double, g string")


def test_histogram_grid_confusion_shapes(spark):
    d = _df(spark, [0, 1, 0, 1, 1, 0], [.1, .9, .2, .8, .7, .3])
    h = curve.score_histogram(d, "y", "p").collect()
    assert len(h) == 20 and sum(r["positive"] for r in h) == 3 and sum(r["negative"] for r in h) == 3
    assert curve.threshold_grid(d, "y", "p").count() == 50
    c = metrics.confusion(d, "y", metrics.predicted("p", 0.5)).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (3, 0, 0, 3)


def test_max_recall_threshold_by_hand(spark):
    d = _df(spark, [1, 1, 1, 0, 0, 0], [.9, .7, .6, .55, .4, .1])
    assert curve.max_recall_threshold(d, "y", "p", min_precision=0.4).first()["threshold"] == 0.6


def test_min_cost_threshold_by_hand(spark):
    d = _df(spark, [1, 1, 0, 0], [.8, .45, .4, .35])
    r = curve.min_cost_threshold(d, "y", "p", cost_fn=4, cost_fp=1).first()
    assert r["threshold"] == 0.45 and r["cost"] == 0


def test_auc_by_hand_and_single_class(spark):
    d = _df(spark, [0, 1, 1, 0, 1, 1, 0, 0], [.1, .9, .8, .2, .7, .4, .3, .6])
    assert curve.roc_auc(d, "y", "p").first()["auc"] == pytest.approx(0.9375)
    one = _df(spark, [1, 1], [.2, .3])
    assert curve.roc_auc(one, "y", "p").first()["auc"] is None
    assert curve.roc_curve(one, "y", "p").count() == 0


def test_auc_matches_spark_evaluator_with_ties(spark, small_dir):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from vigil.plans.bindings import scored_ties
    d = scored_ties(spark, small_dir)
    ours = curve.roc_auc(d, "y", "p").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", metricName="areaUnderROC")
    theirs = ev.evaluate(d.withColumn("y", F.col("y").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-6)


def _np_roc(y, p):
    """Plain numpy ROC with intermediate-point dropping (the reference rule)."""
    order = np.argsort(-p, kind="mergesort")
    y, p = y[order], p[order]
    idx = np.where(np.diff(p))[0]
    thr = np.r_[idx, y.size - 1]
    tps = np.cumsum(y)[thr]
    fps = 1 + thr - tps
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps = fps[keep], tps[keep]
    return sorted(zip(np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_roc_curve_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    ours = sorted((r["fpr"], r["tpr"]) for r in curve.roc_curve(_df(spark, y, p), "y", "p").collect())
    exp = _np_roc(y, p)
    assert len(ours) == len(exp)
    assert np.allclose(np.array(ours), np.array(exp))


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 20])   # one range per group / many ranges
def test_running_sums_match_naive_window(spark, rows_per_bucket):
    rng = np.random.default_rng(7)
    data = [(str(g), float(v), int(c)) for g, v, c in zip(rng.integers(0, 3, 500), rng.normal(size=500),
                                                          rng.integers(0, 5, 500))]
    df = spark.createDataFrame(data, "g string, v double, c long")
    fast = running_sums(df, "v", ["c"], "g", descending=True, buckets=16, rows_per_bucket=rows_per_bucket,
                        totals=True, index="i", count="n", lead_cols=["c"])
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    naive = df.select("g", "v", F.sum("c").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("ref"),
                      F.sum("c").over(Window.partitionBy("g")).alias("tot"),
                      (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("g")).alias("n"),
                      F.lead("c").over(w).alias("nxt"))
    a = sorted(tuple(r) for r in fast.select("g", "v", "c_cum", "c_tot", "i", "n", "c_next").collect())
    b = sorted(tuple(r) for r in naive.collect())
    assert a == b


def test_cut_points_balance_a_skewed_distribution(spark):
    # one huge outlier: equal-width ranges would put every other value in one range
    vals = [float(x) for x in range(2000)] + [1e15]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    cuts = cut_points(df, F.col("v"), [], 16, 100).first()["_cuts"]
    assert len(cuts) == 15 and cuts == sorted(cuts)
    sized = (count_below(df.crossJoin(F.broadcast(spark.createDataFrame([(cuts,)], "_cuts array<double>"))),
                         F.col("v"), "_cuts", 15, "_b").groupBy("_b").count().collect())
    sizes = [r["count"] for r in sized]
    assert len(sizes) == 16 and max(sizes) <= 2 * len(vals) / 16


@pytest.mark.parametrize("small_groups", [True, False])
def test_exact_quantiles_match_percentile(spark, small_groups):
    rng = np.random.default_rng(3)
    data = [([None, "0", "1"][g], float(v)) for g, v in zip(rng.integers(0, 3, 600), rng.normal(size=600) * 7.3)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    ours = {(r["g"], r["q"]): r["value"] for r in
            exact_quantiles(df, "v", probs, "g", small_groups=small_groups).collect()}
    ref = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in probs])).alias("qs")).collect()
    for r in ref:
        for q, v in zip(probs, r["qs"]):
            assert ours[(r["g"], q)] == v
    assert len(ours) == 3 * len(probs)


def test_exact_quantiles_of_many_distinct_values(spark):
    df = spark.range(150_000).select((F.col("id") * 7919 % 150_001 / 3.7).alias("v"))
    probs = [0.1, 0.5, 0.999]
    ours = {r["q"]: r["value"] for r in exact_quantiles(df, "v", probs).collect()}
    ref = df.agg(F.percentile("v", F.array(*map(F.lit, probs)))).first()[0]
    assert [ours[q] for q in probs] == ref


def test_fair_threshold_feasible_and_fallback(spark):
    y = [1, 1, 1, 1, 0, 0, 0, 0]
    p = [.9, .8, .7, .6, .5, .4, .3, .2]
    g = ["a", "b", "a", "b", "a", "b", "a", "b"]
    r = curve.fair_threshold(_df(spark, y, p, g), "y", "p", "g").first()
    assert r["strategy"] == "fairness_f1" and r["threshold"] == 0.6 and r["recall"] == 1.0
    impossible = curve.fair_threshold(_df(spark, y, p, g), "y", "p", "g", min_recall=1.1).first()
    assert impossible["strategy"] == "f1"


def test_thresholds_in_unit_interval(spark, small_dir):
    from vigil.plans.bindings import scored
    d = scored(spark, small_dir)
    for fn in (curve.best_f1_threshold, curve.max_recall_threshold, curve.min_cost_threshold):
        t = fn(d, "y", "p").first()["threshold"]
        assert 0.0 <= t <= 1.0
    s = curve.threshold_strategies(d, "y", "p", "grp").collect()
    assert len(s) == 4 and sum(r["is_active"] for r in s) == 1


def test_count_less_matches_filter_size(spark):
    rng = np.random.default_rng(11)
    cuts = sorted(np.round(rng.random(7), 1).tolist())          # with repeats
    data = [(float(v), cuts[: int(k)]) for v, k in zip(np.round(rng.random(200), 1), rng.integers(0, 8, 200))]
    df = spark.createDataFrame(data, "v double, arr array<double>")
    lit_arr = F.array(*[F.lit(c) for c in cuts])
    got = df.select(
        count_less(cuts, F.col("v")).alias("a"), F.size(F.filter(lit_arr, lambda e: e < F.col("v"))).alias("ea"),
        count_less(cuts, F.col("v"), inclusive=True).alias("b"),
        F.size(F.filter(lit_arr, lambda e: e <= F.col("v"))).alias("eb"),
        count_less(F.col("arr"), F.col("v"), n=7).alias("c"),
        F.size(F.filter("arr", lambda e: e < F.col("v"))).alias("ec")).collect()
    assert all(r["a"] == r["ea"] and r["b"] == r["eb"] and r["c"] == r["ec"] for r in got)


@pytest.mark.parametrize("buckets", [1, 16, 3000])
def test_running_extremes_match_naive_window(spark, buckets):
    """Any number of ranges: one, approximate quantiles, or Spark's own range partitions."""
    rng = np.random.default_rng(9)
    values = rng.permutation(800)[:500]
    df = spark.createDataFrame([(str(v % 3), float(v), int(c), None if v % 7 == 0 else float(c))
                                for v, c in zip(values, rng.integers(0, 50, 500))], "g string, v double, c long, x double")
    got = running_sums(df, "v", ["c"], "g", descending=True, buckets=buckets, rows_per_bucket=20, totals=True, index="i", lead_cols=["c"],
                       extremes={"hi": ("x", "max", "upto"), "lo": ("x", "min", "after")})
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    want = df.select("g", "v", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("c").over(Window.partitionBy("g")),
                     F.row_number().over(w) - 1, F.lead("c").over(w), F.max("x").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                     F.min("x").over(w.rowsBetween(1, Window.unboundedFollowing)))
    assert sorted(map(tuple, got.select("g", "v", "c_cum", "c_tot", "i", "c_next", "hi", "lo").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_number_of_ranges_follows_the_size(spark, tmp_path):
    df = spark.range(20_000).select(F.rand(1).alias("v"))
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert ranges_for(t) == 1
    assert ranges_for(t, rows_per_bucket=1000) == 1024
    assert ranges_for(t, rows_per_bucket=10) > 1024


def test_many_ranges_are_made_by_the_counted_rows(spark):
    """Where the bound of the size asks for many ranges, the plan holds no cut points and is cut from what came before."""
    df = spark.createDataFrame([(i % 3 or None, float(i * 7 % 500), i % 5) for i in range(500)], "g int, v double, c long")
    got = running_sums(df, "v", ["c"], "g", descending=True, totals=True, index="i", rows_per_bucket=100, buckets=1024)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and "LogicalRDD" not in plan
    want = running_sums(df, "v", ["c"], "g", descending=True, totals=True, index="i", buckets=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_fold_metrics_read_one_curve(spark, small_dir, monkeypatch):
    from vigil.plans import q_scored

    calls, counts = [], curve.threshold_counts
    monkeypatch.setattr(curve, "threshold_counts", lambda *a, **k: calls.append(a) or counts(*a, **k))
    q_scored.cv_metrics(spark, small_dir)
    assert len(calls) == 1


def _naive_rates(data, t):
    out = []
    for g in sorted({g for _, _, g in data if g is not None}):
        pos = [p for y, p, x in data if x == g and y == 1 and p is not None]
        neg = [p for y, p, x in data if x == g and y == 0 and p is not None]
        out.append((100 * sum(p >= t for p in neg) / len(neg) if neg else 0.0, 100 * sum(p < t for p in pos) / len(pos) if pos else 0.0))
    return max(a for a, _ in out), max(b for _, b in out), max(a for a, _ in out) - min(a for a, _ in out), max(b for _, b in out) - min(b for _, b in out)


def test_fairness_curve_by_group_rates(spark):
    """Groups with one class only, a null group, null scores and a candidate that is no score."""
    rng = np.random.default_rng(4)
    groups = ["a", "b", "c", "d", None]
    data = [(int(y), None if i % 41 == 0 else round(float(p), 2), groups[g]) for i, (y, p, g) in enumerate(zip(rng.integers(0, 2, 400), rng.random(400), rng.integers(0, 5, 400)))]
    data = [(1 if g == "c" else 0 if g == "d" else y, p, g) for y, p, g in data]
    df = spark.createDataFrame(data, "y int, p double, g string")
    got = curve.fairness_curve(df, "y", "p", "g", extra_thresholds=[0.5072, 2.0, -1.0]).collect()
    assert len(got) == len({p for _, p, _ in data if p is not None}) + 3
    for r in got:
        want = _naive_rates(data, r["threshold"])
        assert [r["max_fpr"], r["max_fnr"], r["gap_fpr"], r["gap_fnr"]] == pytest.approx(want), r["threshold"]


def test_fair_threshold_with_many_groups(spark):
    """50 000 groups of two rows each: no column per group, nothing collected."""
    n = 50_000
    df = spark.range(2 * n).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 2).cast("long").alias("g"),
                                   (F.when(F.col("id") % 2 == 1, 0.6).otherwise(0.1) + (F.col("id") % 300) / 1000).alias("p"))
    r = curve.fair_threshold(df, "y", "p", "g").first()
    assert r["strategy"] == "fairness_f1" and r["recall"] == 1.0 and r["max_fnr"] == 0.0
    assert 0.399 < r["threshold"] <= 0.601 and r["gap_fpr"] == 0.0


def test_threshold_report(spark, small_dir):
    from vigil.plans.bindings import scored
    d = scored(spark, small_dir)
    rows = curve.threshold_report(d, "y", "p", "grp").collect()
    p = [r["p"] for r in d.select("p").collect()]
    assert {r["strategy"] for r in rows} == {"f1", "recall", "cost", "fairness_f1"}
    for r in rows:
        assert r["high_risk_estimated"] == sum(x >= r["threshold"] for x in p)
        assert r["human_reviews"] == sum(abs(x - r["threshold"]) <= curve.REVIEW_MARGIN for x in p)
        assert r["justification"] and r["tradeoff"]
    assert "3" in next(r for r in rows if r["strategy"] == "cost")["justification"]
