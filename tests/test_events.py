import json

from pyspark.sql import functions as F

from vigil.operators import events

def shared():
    return events.common("v1", F.lit("2024-01-01"), "dev", "svc")


def test_threshold_rows_accept_every_shape(spark):
    row = {"name": "cost", "recall": "0.5", "f1": 0.25, "threshold": 0.4, "alto_risco_estimado": 3}
    other = {"metodo": "f1", "recall": None, "f1_score": "x"}
    shapes = {"list": [row, other], "strategies": {"strategies": [row, other]}, "rows": {"rows": [row, other]}, "one": row,
              "empty": {}, "empty list": []}
    got = {}
    for name, payload in shapes.items():
        df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
        got[name] = sorted(tuple(r) for r in events.threshold_rows(df, "payload").collect())
    want = [("cost", 0.5, 0.25, 0.4, 3.0, 0.0), ("f1", 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert got["list"] == got["strategies"] == got["rows"] == want
    assert got["one"] == want[:1] and got["empty"] == got["empty list"] == []
    assert events.threshold_rows(spark.createDataFrame([("not json",), (None,)], "payload string"), "payload").count() == 0


def test_threshold_events_mark_the_trained_strategy(spark):
    rows = spark.createDataFrame([("f1", 0.5, 0.1), ("cost", 0.7, None), (None, None, None)], "strategy string, recall double, f1 double")
    got = {r["strategy"]: r for r in events.threshold_events(rows, "cost", shared()).collect()}
    assert got["cost"]["is_active"] and not got["f1"]["is_active"] and got["n/d"]["recall"] == 0.0
    assert got["cost"]["f1_score"] == 0.0 and got["f1"]["service_name"] == "svc"


def test_importance_events_keep_the_top(spark):
    rank = spark.createDataFrame([(f"f{i:02d}", float(i % 7)) for i in range(30)], "feature string, importance double")
    got = events.importance_events(rank, shared()).orderBy("rank").collect()
    assert len(got) == 20 and got[0]["feature"] == "f06" and [r["rank"] for r in got] == list(range(1, 21))


def test_performance_event_defaults(spark):
    one = spark.createDataFrame([(0.5, None, 7)], "recall double, f1 double, support long")
    r = events.performance_event(one, shared(), {"f1_score": "f1", "test_size": "support"}).first()
    assert (r["recall"], r["f1_score"], r["test_size"], r["train_size"], r["threshold_strategy"]) == (0.5, 0.0, 7, 0, "n/d")
