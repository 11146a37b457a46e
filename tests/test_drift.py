import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import drift
from vigil.sources import files


def _one(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_psi_by_hand(spark):
    ref, cur = _one(spark, range(1, 11)), _one(spark, range(2, 12))
    r = drift.psi(ref, cur, ["x"], bins=5).first()
    # edges 1, 2.8, 4.6, 6.4, 8.2, 10; 11 is out of range and leaves the denominator
    assert r["n_edges"] == 6 and r["in_range_cur"] == 9
    assert r["psi_raw"] == pytest.approx(0.061613, abs=1e-6)


def test_psi_zero_on_identical_and_nonnegative(spark):
    ref = _one(spark, [1, 2, 2, 3, 5, 8, 13, 21, 34, 55])
    assert drift.psi(ref, ref, ["x"]).first()["psi_raw"] == 0.0
    cur = _one(spark, [1, 1, 1, 2, 2, 2, 3, 3, 3, 55])
    assert drift.psi(ref, cur, ["x"]).first()["psi_raw"] >= 0.0


def test_psi_degenerate_cases(spark):
    ref = _one(spark, [1] * 20 + [2])        # deciles collapse to 2 distinct edges -> 0
    assert drift.psi(ref, _one(spark, [5, 6]), ["x"]).first()["psi_raw"] == 0.0
    ref = _one(spark, range(10))
    out = drift.psi_table(ref, _one(spark, [100, 200]), ["x"]).first()
    assert out["psi"] is None and out["all_out_of_range"] and not out["drift_flag"]


def test_psi_grouped_equals_per_group(spark):
    ref = _one(spark, range(100))
    cur = spark.createDataFrame([(float(v), "a" if v % 2 else "b") for v in range(0, 150, 3)], "x double, g string")
    grouped = {r["g"]: r["psi_raw"] for r in drift.psi(ref, cur, ["x"], group_cols="g").collect()}
    for g in ("a", "b"):
        single = drift.psi(ref, cur.where(cur.g == g).drop("g"), ["x"]).first()["psi_raw"]
        assert grouped[g] == single


def test_rate_shift_by_formula(spark):
    ref = spark.createDataFrame([(0,), (0,), (0,), (1,)], "prediction int")
    cur = spark.createDataFrame([(1,), (1,), (1,), (1,)], "prediction int")
    r = drift.rate_shift(ref, cur).first()
    assert (r["reference_rate"], r["current_rate"], r["delta_pp"], r["change_pct"], r["shift_alert"]) == \
        (25.0, 100.0, 75.0, 300.0, True)


def test_missing_ratio(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert drift.missing_ratio(df).first()["missing_ratio"] == 0.75
    assert drift.missing_ratio(df.limit(0)).first()["missing_ratio"] == 0.0


def test_alerts_and_status(spark):
    from pyspark.sql import functions as F
    tbl = spark.createDataFrame([("a", 0.5, "increase", True), ("b", 0.1, "decrease_or_stable", False)],
                                "feature string, psi double, direction string, drift_flag boolean")
    al = drift.drift_alerts(tbl).collect()
    assert len(al) == 1 and "PSI=0.5000" in al[0]["message"] and "increase" in al[0]["message"]
    s = drift.drift_summary(tbl).first()
    assert s["avg_psi"] == 0.3 and s["n_drifted"] == 1
    one = spark.range(1)
    st = one.select(drift.drift_status_col(F.lit(0.3), F.lit(False)).alias("s")).first()["s"]
    assert st == "moderate"
    assert one.select(drift.drift_status_col(F.lit(0.1), F.lit(True)).alias("s")).first()["s"] == "critical"


def test_psi_tails_counts_out_of_range(spark):
    ref, cur = _one(spark, range(1, 11)), _one(spark, range(2, 12))
    plain = drift.psi(ref, cur, ["x"], bins=5).first()["psi_raw"]
    tails = drift.psi(ref, cur, ["x"], bins=5, tails=True).first()["psi_raw"]
    assert tails > plain > 0
    assert drift.psi(ref, ref, ["x"], tails=True).first()["psi_raw"] == 0.0


def test_psi_of_text_nan_and_missing_features(spark):
    ref = spark.createDataFrame([(str(i), float(i), float(i)) for i in range(50)], "a string, b double, c double")
    cur = spark.createDataFrame([("x" if i % 5 == 0 else str(i), float("nan") if i % 7 == 0 else float(i), None)
                                 for i in range(50)], "a string, b double, c double")
    p = {r["feature"]: r for r in drift.psi_table(ref, cur, ["a", "b", "c"]).collect()}
    assert set(p) == {"a", "b", "c"} and p["c"]["psi"] == 0.0 and p["c"]["current_mean"] is None
    numbers = [float(i) for i in range(50) if i % 5]
    assert p["a"]["current_mean"] == round(sum(numbers) / len(numbers), 4)
    assert p["b"]["current_mean"] is not None and p["b"]["psi"] < 0.1
    assert {r["feature"] for r in drift.psi_table(ref, cur, ["a", "b", "c"], top=2).collect()} == {"a", "b"}
    assert drift.missing_ratio(cur, ["b"]).first()["missing_ratio"] == round(8 / 50, 6)


def _log(spark):
    rows = [(i < 60, float(i % 17), None if i % 5 == 0 else i % 3, i, None if i == 99 else int(i % 4 == 0)) for i in range(100)]
    return spark.createDataFrame(rows, "is_ref boolean, x double, k int, at int, prediction int").withColumn("at", F.timestamp_seconds("at"))


def test_snapshot_is_one_scan_and_equals_the_parts(spark):
    log = _log(spark)
    got = drift.snapshot(log, "is_ref", ["x", "k"], cells=["x", "k"], time="at").first()
    valid = log.where("prediction is not null")
    ref, cur = valid.where("is_ref"), valid.where("not is_ref")
    p = drift.psi_table(ref, cur, ["x", "k"])
    shift = drift.rate_shift(ref, cur).first()
    parts = drift.drift_summary(p).first()
    assert (got["avg_psi"], got["n_drifted"]) == (parts["avg_psi"], parts["n_drifted"])
    assert [got[c] for c in ("reference_rate", "current_rate", "delta_pp", "change_pct", "shift_alert")] == list(shift)
    assert got["missing_ratio"] == drift.missing_ratio(cur, ["x", "k"]).first()[0]
    assert got["samples"] == cur.count() == 39 and got["status"] == "updated" and got["updated"]
    assert got["window_ts"] == cur.agg(F.max("at")).first()[0]
    assert [got["t1"], got["t2"]] == [r["feature"] for r in drift.top_features(p).orderBy("rank").collect()] and got["t3"] is None
    counts = drift.snapshot_counts(log, "is_ref", ["x", "k"], cells=["x"])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


@pytest.mark.parametrize("keep,status", [("is_ref", "empty_or_invalid_logs"), ("not is_ref", "reference_not_found"),
                                         ("is_ref or at >= timestamp_seconds(96)", "insufficient_samples"), ("true", "updated")])
def test_snapshot_guards(spark, keep, status):
    rows = _log(spark).where(keep)
    got = drift.snapshot(rows, "is_ref", ["x"], cells=["x"]).first()
    assert got["status"] == status and got["updated"] == (status == "updated")
    alone = drift.snapshot_status(spark, rows.where("is_ref"), rows.where("not is_ref")).first()
    assert (alone["status"], alone["samples"]) == (status, got["samples"])


def test_sources_that_are_not_there(spark, tmp_path):
    cur = _log(spark)
    none = files.open_if_there(spark, str(tmp_path / "none"))
    assert none is None
    assert drift.snapshot_status(spark, none, cur).first()["status"] == "reference_not_found"
    assert drift.snapshot_status(spark, cur, none).first()["status"] == "logs_not_found"


def test_distributions_and_bins(spark):
    ref, cur = _one(spark, range(1, 11)), _one(spark, range(2, 12))
    model = drift.psi_fit(ref, ["x"], bins=5)
    d = drift.psi_detail(model, cur).first()
    assert d["bins"] == [1.0, 2.8, 4.6, 6.4, 8.2, 10.0] and d["reference_distribution"] == [0.2] * 5
    assert d["current_distribution"] == [pytest.approx(x, abs=1e-6) for x in (1 / 9, 2 / 9, 2 / 9, 2 / 9, 2 / 9)]
    rows = drift.psi_distributions(model, cur).collect()
    assert len(rows) == 5 and sum(r["contribution"] for r in rows) == pytest.approx(d["psi"], abs=1e-5)
    flat = drift.psi_fit(_one(spark, [1] * 20 + [2]), ["x"])
    d = drift.psi_detail(flat, cur).first()
    assert (d["psi"], d["reference_distribution"], d["current_distribution"], d["bins"]) == (0.0, [], [], [1.0, 2.0])
    assert drift.psi_detail(drift.psi_fit(ref.limit(0), ["x"]), cur).first()["bins"] == []


def test_shares_come_from_the_quantiles(spark):
    """Repeated values, edges on and between values: equal to counting every value again."""
    rnd = random.Random(7)
    values = [rnd.choice([0.0, 0.1, 0.1, 2.5, rnd.random() * 5]) for _ in range(700)]
    model = drift.psi_fit(_one(spark, values), ["x"])
    e = model.edges["x"]
    want = [sum((v > a or (k == 0 and v == a)) and v <= b for v in values) / len(values) for k, (a, b) in enumerate(zip(e, e[1:]))]
    assert model.shares["x"] == pytest.approx(want) and model.mean["x"] == pytest.approx(sum(values) / len(values))
