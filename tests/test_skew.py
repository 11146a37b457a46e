"""One key / value holding a third of all rows: results stay exact."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators import curve, obs, temporal
from vigil.operators.ordered import exact_quantiles


def _hot_scores(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    p = np.where(np.arange(n) < n // 3, 0.5, np.round(rng.random(n), 3))   # a third share one score
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def test_threshold_counts_with_a_hot_score(spark):
    df = _hot_scores(spark)
    fast = {r["threshold"]: (r["tp"], r["fp"]) for r in curve.threshold_counts(df, "y", "p").collect()}
    g = df.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    w = Window.orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, 0)
    naive = {r["p"]: (r["tp"], r["fp"]) for r in
             g.select("p", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp")).collect()}
    assert fast == naive


def test_asof_with_a_hot_entity(spark):
    hist = spark.createDataFrame([("hot", y, float(y)) for y in range(2000, 2010)] +
                                 [(f"k{i}", 2005, 1.0) for i in range(50)], "k string, t int, v double")
    req = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}", 2000 + i % 12) for i in range(3000)],
                                "rid int, k string, t int")
    out = {r["rid"]: r["prior_v"] for r in temporal.asof_prior(req, hist, "k", "t", "t", ["t", "v"]).collect()}
    naive = (req.alias("r").join(hist.alias("h"), (F.col("r.k") == F.col("h.k")) & (F.col("h.t") < F.col("r.t")), "left")
             .groupBy("rid").agg(F.max_by("h.v", "h.t").alias("v")))
    assert out == {r["rid"]: (r["v"] if r["v"] is not None else 0.0) for r in naive.collect()}


def test_latest_and_quantiles_with_a_hot_facet(spark):
    rows = [("hot" if i % 3 == 0 else f"f{i % 7}", i, float(i % 97)) for i in range(6000)]
    df = spark.createDataFrame(rows, "f string, ts long, v double")
    latest = {r["f"]: r["latest_v"] for r in obs.latest_by(df, "f", "ts", ["v"]).collect()}
    assert latest["hot"] == float(5997 % 97)
    q = {(r["f"], r["q"]): r["value"] for r in exact_quantiles(df, "v", [0.5], "f").collect()}
    ref = {r["f"]: r["m"] for r in df.groupBy("f").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert all(abs(q[(f, 0.5)] - m) < 1e-12 for f, m in ref.items())
