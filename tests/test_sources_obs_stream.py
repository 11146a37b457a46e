import json
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.operators import contract, obs
from vigil.sources import files


def test_scan_many_tags_period_and_skips_untagged(spark):
    d = tempfile.mkdtemp(prefix="vigil-scan-")
    spark.createDataFrame([("1", 5.0)], "RA string, INDE double").write.parquet(f"{d}/sheet_2022.parquet")
    spark.createDataFrame([("2", 6.0, "x")], "RA string, INDE double, PEDRA string").write.parquet(
        f"{d}/sheet_2023.parquet")
    spark.createDataFrame([("3", 1.0)], "RA string, INDE double").write.parquet(f"{d}/summary.parquet")
    df = files.scan_many(spark, [f"{d}/*.parquet"])
    got = sorted((r["RA"], r["period"], r["PEDRA"]) for r in df.collect())
    assert got == [("1", 2022, None), ("2", 2023, "x")]
    import pytest
    with pytest.raises(files.SourceError):
        files.scan_many(spark, [f"{d}/nothing*.csv"])


def test_csv_delimiter_fallback(spark):
    d = tempfile.mkdtemp(prefix="vigil-csv-")
    with open(f"{d}/a.csv", "w") as f:
        f.write("RA,YEAR\n1,2023\n")
    with open(f"{d}/b.csv", "w") as f:
        f.write("RA;YEAR\n2;2024\n")
    assert files.scan_csv(spark, f"{d}/a.csv", required=["YEAR"]).first()["YEAR"] == "2023"
    assert files.scan_csv(spark, f"{d}/b.csv", required=["YEAR"]).first()["YEAR"] == "2024"


def test_canonical_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7)], "ra int, `matematica 2023` int, `port 23` int, ing int, "
                                                        "defasagem int, `ano ingresso` int, `inst ensino` int")
    assert files.canonical_columns(df, 2023).columns == ["RA", "NOTA_MAT", "NOTA_PORT", "NOTA_ING", "DEFASAGEM",
                                                         "ANO_INGRESSO", "INSTITUICAO_ENSINO"]


def test_canonical_names_keep_other_years_and_columns(spark):
    names = {"INDE 22": "INDE 22", "INDE 2023": "INDE", "INDE 23": "INDE", "Fase": "FASE", "Fase ideal": "FASE IDEAL",
             "Pedra 2023": "PEDRA", "Pedra 21": "PEDRA 21"}
    assert {n: files.canonical_name(n, 2023) for n in names} == names
    for target, aliases in files.COLUMN_ALIASES.items():
        assert {files.canonical_name(a.lower(), 2024) for a in aliases} == {target}
    assert files.canonical_name("Rec. Psicologia 2022", 2022) == "REC_PSICOLOGIA"
    assert files.canonical_name("Ponto de virada") == "PONTO_VIRADA"


def test_scan_panel_chains_canonical_names_and_contract(spark):
    d = tempfile.mkdtemp(prefix="vigil-panel-")
    spark.createDataFrame([(" 1 ", 5.0, 1.0)], "matricula string, `INDE 22` double, `INDE 2023` double").write.parquet(f"{d}/p2023.parquet")
    spark.createDataFrame([("2", "7,5")], "id_aluno string, `INDE 24` string").write.parquet(f"{d}/p2024.parquet")
    df = files.scan_panel(spark, [f"{d}/p*.parquet"], required=["RA", "INDE"])
    got = {r["ANO_REFERENCIA"]: r for r in df.collect()}
    assert got[2023]["RA"] == "1" and float(got[2023]["INDE"]) == 1.0 and got[2023]["INDE 22"] == 5.0 and got[2024]["RA"] == "2"
    with pytest.raises(contract.ContractError):
        files.scan_panel(spark, [f"{d}/p*.parquet"], required=["NOPE"])


def test_jsonl_flatten_and_tail(spark):
    d = tempfile.mkdtemp(prefix="vigil-jsonl-")
    with open(f"{d}/log.jsonl", "w") as f:
        for i in range(5):
            f.write(json.dumps({"id": i, "input_features": {"AGE": 10 + i},
                                "prediction_result": {"class": i % 2, "probability": 0.1 * i}}) + "\n")
        f.write("{not json\n")
    schema = "id int, input_features struct<AGE:int>, prediction_result struct<class:int, probability:double>"
    df = files.scan_jsonl(spark, f"{d}/log.jsonl", schema)
    flat = files.flatten_structs(df, ["input_features", "prediction_result"], {"class": "prediction"})
    assert flat.columns == ["id", "AGE", "prediction", "probability"] and flat.count() == 6
    assert [r["id"] for r in files.tail_rows(flat.where(F.col("id").isNotNull()), 2, ["id"]).collect()] == [4, 3]
    assert files.tail_rows(flat, 0, ["id"]).count() == 0
    assert files.source_status(df, df.limit(4)) == "insufficient_samples"
    assert files.source_status(df, df.where(F.col("id") >= 0)) == "ok"


def test_apdex_latest_and_gaps(spark):
    df = spark.createDataFrame([(0.4, "a", 1, "2024-01-01 00:00:00"), (1.0, "a", 2, "2024-01-01 00:11:00"),
                                (3.0, "b", 3, "2024-01-01 00:11:00")], "d double, f string, id int, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert df.agg(obs.apdex("d", 0.5).alias("a")).first()["a"] == 0.5
    latest = {r["f"]: r["latest_d"] for r in obs.latest_by(df, "f", "ts", ["d"], "id").collect()}
    assert latest == {"a": 1.0, "b": 3.0}
    series = obs.time_series(df, "ts", "5 minutes", [F.count(F.lit(1)).alias("n")])
    filled = obs.fill_gaps(series, "bucket_start", 300, ["n"])
    assert [r["n"] for r in filled.orderBy("bucket_start").collect()] == [1, 0, 2]


def test_stream_matches_batch_on_closed_windows(spark, small_dir):
    from vigil.streaming import monitors
    q, path = monitors.run_to_parquet(monitors.windowed_timeseries(monitors.event_stream(spark, small_dir)), "t")
    monitors.await_all(q)
    stream = {r["bucket_start"]: r["n"] for r in spark.read.parquet(path).collect()}
    ev = spark.read.parquet(f"{small_dir}/events.parquet")
    batch = {r["b"]: r["n"] for r in ev.groupBy(F.window("ts", "5 minutes").start.alias("b")).count()
             .withColumnRenamed("count", "n").collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())
    assert len(stream) < len(batch) + 1       # the still-open last window is withheld
