import pytest
from pyspark.sql import functions as F

from vigil.functions import clean
from vigil.operators import features as feat

SPEC = {"period": "YEAR", "start": "START", "age": "AGE", "tenure": "TENURE", "priors": ["PRIOR"],
        "flag": "NEW", "group": "GENDER", "code": "PHASE", "keep": []}


def _process(spark, rows, schema, stats=None, snapshot_year=None):
    df = spark.createDataFrame(rows, schema)
    st = spark.createDataFrame([stats], "median_start int, median_age int") if stats else None
    return feat.process_features(df, SPEC, stats=st, snapshot_year=snapshot_year).first()


def test_tenure_age_group_defaults(spark):
    r = _process(spark, [(2024, 2020, "11", None, "1A")], "YEAR int, START int, AGE string, GENDER string, PHASE string")
    assert r["TENURE"] == 4.0 and r["AGE"] == 11.0 and r["GENDER"] == "Outro"
    assert r["PRIOR"] == 0.0 and r["NEW"] == 0


def test_null_start_uses_training_median(spark):
    r = _process(spark, [(2024, None, 10)], "YEAR int, START int, AGE int", stats=(2019, 12))
    assert r["TENURE"] == 5.0


def test_missing_start_group_words_and_code(spark):
    r = _process(spark, [(2024, "menina", "fase 2b")], "YEAR int, GENDER string, PHASE string")
    assert r["TENURE"] == 0.0 and r["GENDER"] == "Feminino" and r["PHASE"] == "FASE2B"


def test_out_of_range_age_takes_median(spark):
    r = _process(spark, [(2024, 0)], "YEAR int, AGE int", stats=(2019, 13))
    assert r["AGE"] == 13.0


def test_labels_by_priority(spark):
    gap = spark.createDataFrame([(-1,), (0,), (2,), (None,)], "gap bigint")
    assert [r["label"] for r in feat.derive_label(gap).orderBy(F.col("gap").asc_nulls_last()).collect()] == [1, 0, 0, 0]
    idx = spark.createDataFrame([("5.0",), ("7.0",), ("bad",)], "index string")
    assert sorted(r["label"] for r in feat.derive_label(idx).collect()) == [0, 0, 1]
    tier = spark.createDataFrame([("Quartzo",), ("onix",)], "tier string")
    assert {r["tier"]: r["label"] for r in feat.derive_label(tier).collect()} == {"Quartzo": 1, "onix": 0}
    with pytest.raises(ValueError):
        feat.derive_label(spark.createDataFrame([(1,)], "other int"))


def test_cleaning_functions(spark):
    df = spark.createDataFrame([("1d", " 12.5 ", "12.0", "fase 2b", "nan", None)],
                               "a string, b string, k string, code string, cat string, n double")
    r = df.select(clean.to_number("a").alias("a"), clean.to_number("b").alias("b"),
                  clean.normalise_key("k").alias("k"), clean.clean_code("code").alias("c9"),
                  clean.extract_code("code").alias("c10"), clean.null_words("cat").alias("cat"),
                  clean.clip(F.col("n"), 0.0, 1.0).alias("n")).first()
    assert r["a"] is None and r["b"] == 12.5 and r["k"] == "12" and r["c9"] == "FASE2B"
    assert r["c10"] == "2B" and r["cat"] == "N/A" and r["n"] is None


def test_extract_code_patterns(spark):
    vals = ["ALFA", "turma alfa x", "fase 7", "7", "--", None, "A1"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["c"] for r in df.select(clean.extract_code("v").alias("c")).collect()]
    assert got == ["ALFA", "ALFA", "7", "7", "0", "0", "A1"]


def test_keyword_classify_single_letter_trap(spark):
    df = spark.createDataFrame([("nao informado",), ("homem",), ("xyz",)], "g string")
    got = [r["c"] for r in df.select(clean.keyword_classify("g").alias("c")).collect()]
    strict = [r["c"] for r in df.select(clean.keyword_classify("g", strict=True).alias("c")).collect()]
    assert got == ["Feminino", "Masculino", "Outro"] and strict == ["Outro", "Masculino", "Outro"]


def test_age_from_mixed(spark):
    df = spark.createDataFrame([("11", None), ("2012", 2022), ("2010-05-17", None), ("unknown", None), ("40", None)],
                               "raw string, ref int")
    got = [r["a"] for r in df.select(clean.age_from_mixed("raw", "ref").alias("a")).collect()]
    assert got == [11, 10, 14, None, None]


def test_train_statistics_medians(spark):
    df = spark.createDataFrame([(2018, 10, 2020), (2020, 12, 2021), (None, 13, 2022)], "s int, a int, r int")
    r = feat.train_statistics(df, "s", "a", "r").first()
    assert (r["median_start"], r["median_age"]) == (2019, 12)
    empty_start = spark.createDataFrame([(None, None, 2020), (None, None, 2023)], "s int, a int, r int")
    r = feat.train_statistics(empty_start, "s", "a", "r").first()
    assert (r["median_start"], r["median_age"]) == (2021, 12)


def test_rounding_matches_sql_on_binary_ties(spark):
    from vigil.functions.numeric import rnd
    df = spark.createDataFrame([(0.35105,), (2.23065,), (-1.40915,), (2.5,), (None,), (1e20,)], "x double")
    got = [r["r"] for r in df.select(rnd("x", 4).alias("r")).collect()]
    assert got == [0.351, 2.2306, -1.4091, 2.5, None, 1e20]


def test_request_defaults(spark):
    from vigil.operators import contract
    df = spark.createDataFrame([(1, None, 1), (2, 0.5, None)], "id int, prior_a double, is_new int")
    got = {r["id"]: (r["prior_a"], r["prior_b"], r["is_new"]) for r in contract.request_defaults(df, ["prior_a", "prior_b"]).collect()}
    assert got == {1: (0.0, 0.0, 1), 2: (0.5, 0.0, 0)}
    assert contract.request_defaults(df.drop("is_new")).first()["is_new"] == 0
