from pyspark.sql import functions as F

from vigil.operators import temporal


def test_lag_previous_row_and_new_flag(spark):
    df = spark.createDataFrame([("1", 2022, 5.0), ("1", 2023, 6.0)], "RA string, YEAR int, INDE double")
    out = {r["YEAR"]: r for r in temporal.lag_features(df, "RA", "YEAR", ["INDE"]).collect()}
    assert out[2023]["INDE_prev"] == 5.0 and out[2023]["is_new"] == 0
    assert out[2022]["INDE_prev"] == 0.0 and out[2022]["is_new"] == 1


def test_lag_skips_gaps_and_compat_flag(spark):
    df = spark.createDataFrame([("1", 2020, 0.0), ("1", 2023, 6.0), ("2", 2023, 4.0)],
                               "RA string, YEAR int, INDE double")
    out = {(r["RA"], r["YEAR"]): r for r in
           temporal.lag_features(df, "RA", "YEAR", ["INDE"], compat_new_from="INDE").collect()}
    assert out[("1", 2023)]["INDE_prev"] == 0.0          # previous *row*, 2020
    assert out[("1", 2023)]["is_new"] == 1                # compat: a real 0 prior is flagged new
    assert out[("2", 2023)]["is_new"] == 1


def test_lag_without_period_is_unchanged(spark):
    df = spark.createDataFrame([("1", 5.0)], "RA string, INDE double")
    assert temporal.lag_features(df, "RA", "YEAR", ["INDE"]).columns == df.columns


def _hist(spark, data, schema="RA string, YEAR int, INDE string, IAA double"):
    return spark.createDataFrame(data, schema)


def _req(spark, data):
    return spark.createDataFrame(data, "rid int, RA string, YEAR int")


def test_asof_strict_and_null_period(spark):
    h = _hist(spark, [("1", 2022, "5", None), ("1", 2023, "6", None), ("1", 2024, "7", None)])
    r = _req(spark, [(1, "1", 2024), (2, "1", 2023), (3, "1", None), (4, "1", 2022)])
    out = {x["rid"]: x for x in temporal.asof_prior(r, h, "RA", "YEAR", "YEAR", ["YEAR", "INDE"]).collect()}
    assert out[1]["prior_INDE"] == 6.0 and out[1]["is_new"] == 0
    assert out[2]["prior_INDE"] == 5.0
    assert out[3]["prior_INDE"] == 7.0            # no period -> last row overall
    assert out[4]["prior_INDE"] == 0.0 and out[4]["is_new"] == 1


def test_asof_invalid_values_and_unknown_key(spark):
    h = _hist(spark, [("1", 2022, "x", None), ("1", 2023, "1.0", 2.0)])
    r = _req(spark, [(1, "1", 2023), (2, "999", 2023)])
    out = {x["rid"]: x for x in temporal.asof_prior(r, h, "RA", "YEAR", "YEAR", ["YEAR", "INDE", "IAA"]).collect()}
    assert out[1]["prior_INDE"] == 0.0 and out[1]["prior_IAA"] == 0.0 and out[1]["is_new"] == 0
    assert out[2]["is_new"] == 1 and out[2]["prior_INDE"] == 0.0


def test_asof_empty_store_is_cold_start(spark):
    h = _hist(spark, [])
    r = _req(spark, [(1, "1", 2023), (1, "1", 2023)])
    out = temporal.asof_prior(r, h, "RA", "YEAR", "YEAR", ["YEAR", "INDE"]).collect()
    assert len(out) == 2 and all(x["is_new"] == 1 for x in out)  # duplicates survive


def test_asof_matches_naive_theta_join(spark, small_dir):
    from vigil.plans.bindings import panel, requests
    p, r = panel(spark, small_dir), requests(spark, small_dir)
    fast = temporal.asof_prior(r, p, "entity_id", "period", "period", ["period", "idx"])
    naive = (r.alias("r").join(p.alias("p"), (F.col("r.entity_id") == F.col("p.entity_id"))
                               & (F.col("p.period") < F.col("r.period")), "left")
             .groupBy("request_id").agg(F.max("p.period").alias("prior_period")))
    a = {x["request_id"]: x["prior_period"] for x in fast.collect()}
    b = {x["request_id"]: x["prior_period"] for x in naive.collect()}
    assert a == b


def test_expanding_folds_no_leakage(spark):
    df = spark.createDataFrame([(y, i) for y in (2022, 2023, 2024) for i in range(100)], "YEAR int, i int")
    folds = temporal.expanding_folds(df, "YEAR")
    agg = {(r["fold"], r["role"]): (r["lo"], r["hi"], r["n"]) for r in
           folds.groupBy("fold", "role").agg(F.min("YEAR").alias("lo"), F.max("YEAR").alias("hi"),
                                             F.count("*").alias("n")).collect()}
    assert agg == {(1, "train"): (2022, 2022, 100), (1, "validation"): (2023, 2023, 100),
                   (2, "train"): (2022, 2023, 200), (2, "validation"): (2024, 2024, 100)}
    assert all(r["no_leakage"] for r in temporal.fold_integrity(folds, "YEAR").collect())


def test_single_period_gives_no_folds(spark):
    df = spark.createDataFrame([(2022, 1)], "YEAR int, i int")
    assert temporal.expanding_folds(df, "YEAR").count() == 0


def test_split_and_last_row(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, t int, v double")
    roles = {(r["k"], r["t"]): r["role"] for r in temporal.temporal_split(df, "t").collect()}
    assert roles == {("a", 1): "train", ("a", 2): "test", ("b", 1): "train"}
    last = {r["k"]: r["v"] for r in temporal.last_row_per_key(df, "k", "t", ["t", "v"]).collect()}
    assert last == {"a": 2.0, "b": 3.0}


def test_latest_valid_period(spark):
    df = spark.createDataFrame([(1999, 1), (2023, 2), (2030, 3)], "p int, x int")
    assert [r["x"] for r in temporal.latest_period_rows(df, "p").collect()] == [2]
    none_valid = spark.createDataFrame([(1999, 1), (1998, 2)], "p int, x int")
    assert temporal.latest_period_rows(none_valid, "p").count() == 2


def test_folds_without_copied_rows(spark):
    rows = [(e, y, float(e + y)) for e in range(20) for y in range(2018, 2024) if (e * y) % 3] + [(3, 2020, 1.0), (None, 2021, 2.0), (4, None, 3.0)]
    df = spark.createDataFrame(rows, "e int, y int, v double")
    folds = temporal.expanding_folds(df, "y")
    want = folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("e").alias("n_entities"), F.min("y").alias("min_period"),
                                             F.max("y").alias("max_period"))
    cols = ["fold", "role", "n_rows", "n_entities", "min_period", "max_period"]
    assert sorted(map(tuple, temporal.fold_report(df, "y", "e").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert sorted(map(tuple, temporal.fold_bounds(df, "y").collect())) == sorted(map(tuple, temporal.fold_integrity(folds, "y").collect()))
    sums = {r["fold"]: (r["train_v"], r["val_v"]) for r in temporal.fold_sums(df, "y", {"v": F.col("v")}).collect()}
    assert sums == {f: tuple(folds.where((F.col("fold") == f) & (F.col("role") == r)).agg(F.sum("v")).first()[0] for r in ("train", "validation")) for f in sums}
    val = temporal.validation_rows(df, "y")
    assert sorted(map(str, val.select("fold", "e", "y", "v").collect())) == sorted(map(str, folds.where("role = 'validation'").select("fold", "e", "y", "v").collect()))
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "p string, v int")
    assert [r["val_period"] for r in temporal.fold_sums(words, "p", {"v": F.col("v")}).orderBy("fold").collect()] == ["b", "c"]


def test_asof_time_line_over_ranges(spark):
    """Many requests and cells in one key, over several ranges; null keys, null and equal times, text keys."""
    hist = [("hot", t, float(t)) for t in range(0, 3000, 3)] + [("b", 5, 1.0), ("b", 9, None), (None, 1, 7.0), ("c", None, 4.0)]
    req = [(i, "hot", i) for i in range(3000)] + [(9000, "b", 5), (9001, "b", 6), (9002, "b", None), (9003, None, 4), (9004, "zz", 4), (9005, "c", 9), (9001, "b", 6)]
    h = spark.createDataFrame(hist, "k string, t int, v double").repartition(3)
    r = spark.createDataFrame(req, "rid int, k string, t int").repartition(3)
    got = sorted((x["rid"], x["prior_period"], x["prior_v"], x["is_new"]) for x in temporal.asof_prior(r, h, "k", "t", "t", ["t", "v"]).collect())

    def brute(k, t):
        cells = [(a, v) for key, a, v in hist if key == k and k is not None and a is not None and (t is None or a < t)]
        a, v = max(cells, key=lambda c: c[0]) if cells else (None, 0.0)
        return a, v if v is not None else 0.0, int(not cells)

    assert [x for x in got if x[1] is not None] == sorted(x for x in ((i, *brute(k, t)) for i, k, t in req) if x[1] is not None)
    assert len(got) == len(req)
