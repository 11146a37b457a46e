import pytest
from pyspark.sql import functions as F

from vigil.functions import decision as dec
from vigil.operators import contract, metrics


def test_group_weights_leave_the_rows_where_they_are(spark):
    """Few groups: a join dealt out by the group would leave the rows in as many tasks."""
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(40)], "k int, g string")
    got = metrics.group_weights(df, "g")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r["g"], round(r["weight"], 6)) for r in got.collect()} == {(None, 1.333333), ("a", 1.333333), ("b", 0.666667)}


def test_fold_summary_and_nulls(spark):
    folds = spark.createDataFrame([(1, .80, .75, .77, .85), (2, .82, .78, .80, .87), (3, .78, .76, .77, None)],
                                  "fold int, recall double, precision double, f1 double, auc double")
    s = {r["metric"]: r for r in metrics.fold_summary(folds).collect()}
    assert s["recall"]["mean"] == 0.8 and s["auc"]["mean"] == 0.86
    assert s["f1"]["gap"] == 0.03 and s["recall"]["std"] == pytest.approx(0.0163, abs=1e-4)


def test_holdout_interval(spark):
    summary = spark.createDataFrame([("f1", .80, .05)], "metric string, mean double, std double")
    inside = spark.createDataFrame([(.79, None, None)], "f1 double, recall double, precision double")
    assert metrics.holdout_in_interval(summary, inside).first()["all_inside"] is True
    summary2 = spark.createDataFrame([("f1", .80, .02)], "metric string, mean double, std double")
    outside = spark.createDataFrame([(.50, None, None)], "f1 double, recall double, precision double")
    assert metrics.holdout_in_interval(summary2, outside).first()["all_inside"] is False


def test_promotion_gate_cases(spark):
    cand = spark.createDataFrame([("a", .76, .7), ("b", .70, .7), ("c", .9, .5), ("d", .5, .7)],
                                 "k string, f1 double, recall double")
    cur = spark.createDataFrame([("a", .8, .7), ("b", .8, .7), ("c", .1, .7)], "k string, f1 double, recall double")
    got = {r["k"]: r["promote"] for r in metrics.promotion_gate(cand, cur, ["k"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}


def test_bootstrap_ordering_and_empty(spark):
    y = [0, 1, 1, 0, 1, 0, 1, 0, 1, 0]
    yh = [0, 1, 1, 0, 1, 0, 0, 0, 1, 1]
    df = spark.createDataFrame(list(zip(y, yh)), "y int, yh int")
    r = metrics.bootstrap_f1(df, "y", "yh", draws=100).first()
    assert r["f1_low"] <= r["f1_mean"] <= r["f1_high"]
    assert metrics._bootstrap_counts(0, 0, 0, 0, 10, 1)["f1_mean"] == 0.0


def test_group_metrics_and_majority(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (0, 1, "a", None), (1, 0, "b", "x")],
                               "y int, yh int, g string, h string")
    gm = {(r["dimension"], r["value"]): r for r in metrics.group_metrics(df, "y", "yh", ["g", "h"]).collect()}
    assert gm[("g", "a")]["precision"] == 0.5 and gm[("g", "b")]["recall"] == 0.0
    assert ("h", None) not in gm and gm[("h", "x")]["support"] == 2
    train = spark.createDataFrame([(1,), (0,)], "y int")             # tie -> lowest class
    assert metrics.majority_class(train, "y").first()["majority_class"] == 0


def test_fairness_gaps(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, 0, "a"), (1, 0, "b"), (0, 0, "b")], "y int, yh int, g string")
    r = {x["g"]: x for x in metrics.fairness_gaps(df, "y", "yh", "g").collect()}
    assert r["a"]["fpr"] == 50.0 and r["b"]["fnr"] == 100.0 and r["a"]["gap_fpr"] == 50.0


def test_segments_review_and_drivers(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.29, 0.5), (0.30, 0.5), (0.65, 0.6), (0.65, 0.7)], "p double, t double")
    r = df.select(dec.decision("p", F.col("t")).alias("d"), dec.segment("p", F.col("t")).alias("s"),
                  dec.review_band("p", F.col("t"), 0.02).alias("rv")).collect()
    assert [x["d"] for x in r] == [1, 0, 0, 1, 0]
    assert [x["s"] for x in r] == ["high", "low", "medium", "high", "medium"]
    assert r[0]["rv"] is True and r[1]["rv"] is False
    m = spark.createDataFrame([("M",), ("Z",)], "g string").select(dec.margin_for("g", {"M": 0.03}).alias("m"))
    assert [x["m"] for x in m.collect()] == [0.03, 0.02]
    drv = spark.createDataFrame([(5.0, 6.0, 0, 3.0, 10)], "e double, i double, n int, t double, a int")
    assert drv.select(dec.risk_drivers("e", "i", "n", "t", "a").alias("d")).first()["d"] == [dec.DRIVER_NONE]
    drv2 = spark.createDataFrame([(1.0, 1.0, 1, 0.0, 16)], "e double, i double, n int, t double, a int")
    assert len(drv2.select(dec.risk_drivers("e", "i", "n", "t", "a").alias("d")).first()["d"]) == 3


def test_contract_checks(spark):
    df = spark.createDataFrame([("1", "x")], "RA string, B string")
    with pytest.raises(contract.ContractError) as e:
        contract.require_columns(df, ["RA", "AGE", "YEAR"])
    assert "AGE" in str(e.value) and "YEAR" in str(e.value)
    with pytest.raises(contract.ContractError):
        contract.require_non_empty(df.limit(0))
    rep = {r["column"]: r["n_lost"] for r in contract.coercion_loss_report(
        spark.createDataFrame([("1", "a"), ("x", None)], "a string, b string"), ["a", "b"]).collect()}
    assert rep == {"a": 1, "b": 1}
    rec = spark.createDataFrame([("", 30, 2015, "Outro", "A", "Esc", "1", None, 5.0)],
                                "key string, age int, start_year int, group string, klass string, "
                                "institution string, phase string, ref_year int, prior_index double")
    valid, bad = contract.validate_rows(rec, contract.request_rules())
    assert valid.count() == 0 and bad.first()["reasons"] == ["key_empty", "age_out_of_range"]
