"""The forest over counted cells against Spark's own forest over rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from vigil.operators import forest, ml


@pytest.fixture(scope="module")
def table(spark):
    """Few values a column, so that both forests may cut between all of them; rows repeat."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        a, b, g = float(r.integers(0, 12)), float(r.integers(0, 5)), "uvwx"[r.integers(0, 4)]
        rows.append((i, a, b, g, int(np.sin(a) + 0.3 * b + (g == "v") + r.normal() * 0.5 > 1.2)))
    df = ml.balanced_weights(spark.createDataFrame(rows, "id long, a double, b double, g string, label int"), "label", "g").cache()
    df.count()
    return df


def _fit(df, **kw):
    return ml.fit(df, ["a", "b"], ["g"], "label", "weight", **kw)


def _p(model, df):
    return {r["id"]: r["p"] for r in ml.score(model, df, ["g"]).select("id", "p").collect()}


def test_one_tree_is_sparks_tree(table, monkeypatch):
    *stages, tree = ml.build_pipeline(["a", "b"], ["g"], "label", "weight", n_trees=1, max_depth=4).getStages()
    tree = tree.setBootstrap(False)  # nothing is drawn then
    prepared = Pipeline(stages=stages).fit(table)
    ready = prepared.transform(table).withColumn("label", F.col("label").cast("double"))
    want = _p(PipelineModel([*prepared.stages, tree.fit(ready)]), table)
    monkeypatch.setattr(forest, "MIN_ROWS", 0)
    monkeypatch.setattr(forest, "BLOCK", 100)
    own = forest.fit(ready, tree, "_num_scaled", ["_idx_g"], [ready.schema["_ohe_g"].metadata["ml_attr"]["num_attrs"]])
    model = PipelineModel([*prepared.stages, own])
    got = _p(model, table)
    assert len(got) == 1500 and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert own.trees[0].depth == 4 and own.trees[0].numNodes > 5 and ml.feature_importance(model, ["a", "b"], ["g"])[0][1] > 0


def test_forest_counts_every_row_and_is_as_good(spark, table, monkeypatch, tmp_path):
    spark_own = _p(_fit(table, n_trees=30, max_depth=6), table)
    calls = []
    monkeypatch.setattr(forest, "MIN_ROWS", 0)
    monkeypatch.setattr(forest, "_model", lambda e, n, f, own=forest._model: calls.append(n) or own(e, n, f))
    model = _fit(table, n_trees=30, max_depth=6)
    got, y = _p(model, table), {r["id"]: r["label"] for r in table.collect()}
    brier = lambda p: sum((p[i] - y[i]) ** 2 for i in y) / len(y)
    assert abs(brier(got) - brier(spark_own)) < 0.01 and len(calls) == 1
    roots = [r["rawCount"] for r in calls[0].where("id = 0").collect()]
    assert len(roots) == 30 and abs(np.mean(roots) - 1500) < 5 * np.sqrt(1500 / 30) and len(set(roots)) > 1
    leaves = {r["treeID"]: r["n"] for r in calls[0].where("leftChild < 0").groupBy("treeID").agg(F.sum("rawCount").alias("n")).collect()}
    assert sorted(leaves.values()) == sorted(roots)  # what a split parts adds up
    again = _p(_fit(table, n_trees=30, max_depth=6), table.repartition(3))
    assert again == got  # seeded, whatever the partitions
    model.write().save(str(tmp_path / "m"))
    assert _p(PipelineModel.load(str(tmp_path / "m")), table) == got


def test_scores_are_the_models_own(table, monkeypatch):
    for rows in (forest.MIN_ROWS, 0):
        monkeypatch.setattr(forest, "MIN_ROWS", rows)
        model = _fit(table, n_trees=7, max_depth=5)
        own = model.transform(ml.prepare_categorical(table, ["g"])).select("id", ml.vector_to_array("_prob")[1].alias("p"))
        assert _p(model, table) == {r["id"]: r["p"] for r in own.collect()}


def test_split_points_see_every_value(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 1000, F.lit(0.0)).otherwise(F.col("id").cast("double")).alias("v"),
                                  (F.col("id") % 3).cast("double").alias("few"), F.lit(1.0).alias("w"))
    wide, few = forest.split_points(df, ["v", "few"], "w", 32)
    assert few == [0.5, 1.5]
    assert 28 <= len(wide) <= 31 and wide[0] < 1200  # the heavy value stands for itself, the rest is shared out
    steps = np.diff(wide[1:])
    assert steps.max() < 130


def test_other_tables_are_left_to_spark(table, monkeypatch):
    monkeypatch.setattr(forest, "MIN_ROWS", 0)
    monkeypatch.setattr(forest, "MAX_CELLS", 10)
    assert _fit(table, n_trees=2, max_depth=2).stages[-1].getNumTrees == 2
    assert _fit(table.where("label = 0"), n_trees=2, max_depth=2).stages[-1].getNumTrees == 2
