"""Model training, calibration and scoring as Spark ML jobs.

Preprocessing mirrors the reference estimator: numeric median imputation +
standardisation, categorical constant fill + one-hot where an unseen value is
the all-zero vector (``StringIndexer(handleInvalid='keep')`` + ``OneHotEncoder
(dropLast=True)``), and a random forest with balanced × group weights.
Training is distributed by Spark ML; the driver only chooses branches from
one-row results.  Results are not bit-equal to other forest libraries.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators import forest
from vigil.operators.metrics import group_weights
from vigil.operators.split import hash_split

# fixed values of the reference configuration
N_TREES = 200
MAX_DEPTH = 10
SEED = 42
CALIBRATION_MIN_ROWS = 50
CALIBRATION_MIN_GAIN = 1e-4
MISSING_CATEGORY = "missing"


def balanced_weights(df: DataFrame, label: str, group: str | None = None, out: str = "weight") -> DataFrame:
    """n / (2 · n_class) per row, multiplied by the group representation weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = counts.agg(F.sum("_nc").alias("_n"))
    w = counts.crossJoin(F.broadcast(n)).select(label, (F.col("_n") / (2.0 * F.col("_nc"))).alias("_cw"))
    d = df.join(F.broadcast(w), label)  # one row per class
    if group:
        d = group_weights(d, group, "_gw")
        return d.withColumn(out, F.col("_cw") * F.col("_gw")).drop("_cw", "_gw")
    return d.withColumnRenamed("_cw", out)


def build_pipeline(numeric: Sequence[str], categorical: Sequence[str], label: str,
                   weight: str | None = None, n_trees: int = N_TREES, max_depth: int = MAX_DEPTH,
                   seed: int = SEED) -> Pipeline:
    imp_out = [f"_imp_{c}" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=imp_out),
              VectorAssembler(inputCols=imp_out, outputCol="_num_vec", handleInvalid="keep"),
              StandardScaler(inputCol="_num_vec", outputCol="_num_scaled", withMean=True, withStd=True)]
    feats = ["_num_scaled"]
    if categorical:
        idx = [f"_idx_{c}" for c in categorical]
        ohe = [f"_ohe_{c}" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep")]
        feats += ohe
    stages += [VectorAssembler(inputCols=feats, outputCol="features"),
               RandomForestClassifier(featuresCol="features", labelCol=label, weightCol=weight,
                                      numTrees=n_trees, maxDepth=max_depth, seed=seed,
                                      probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")]
    return Pipeline(stages=stages)


def prepare_categorical(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Constant fill for categorical inputs (null -> ``missing``)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)) for c in categorical})


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
        weight: str | None = None, **kw) -> PipelineModel:
    """The fitted pipeline.  A long table's forest grows over counted cells (``forest``), a short one's by Spark over rows."""
    data = prepare_categorical(df, categorical).withColumn(label, F.col(label).cast("double"))
    *stages, classifier = build_pipeline(numeric, categorical, label, weight, **kw).getStages()
    prepared = Pipeline(stages=stages).fit(data)
    ready = prepared.transform(data)
    slots = [ready.schema[f"_ohe_{c}"].metadata["ml_attr"]["num_attrs"] for c in categorical]
    trees = forest.fit(ready, classifier, "_num_scaled", [f"_idx_{c}" for c in categorical], slots) or classifier.fit(ready)
    return PipelineModel([*prepared.stages, trees])


def score(model: PipelineModel, df: DataFrame, categorical: Sequence[str], out: str = "p") -> DataFrame:
    """Positive-class probability as a plain double column."""
    s = PipelineModel(model.stages[:-1]).transform(prepare_categorical(df, categorical))
    p = forest.probability(model.stages[-1], vector_to_array("features"))
    if p is None:
        s = model.stages[-1].transform(s)
        p = vector_to_array(F.col("_prob"))[1]
    return s.withColumn(out, p).drop(
        *[c for c in s.columns if c.startswith(("_imp_", "_idx_", "_ohe_", "_num_"))],
        "features", "_prob", "_raw", "_pred")


def feature_importance(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str],
                       top: int = 20) -> list[tuple[str, float]]:
    """Impurity importances by encoded feature name (numeric names, then
    ``column=value`` for each kept one-hot slot), top ``top`` descending."""
    rf = model.stages[-1]
    names = list(numeric)
    if categorical:
        sim = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"][0]
        for c, labels in zip(categorical, sim.labelsArray):
            names += [f"{c}={v}" for v in labels]  # dropLast removes the unseen slot
    imp = rf.featureImportances.toArray().tolist()
    pairs = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))[:top]
    return [(n, round(float(v), 4)) for n, v in pairs]


ISOTONIC_TASK_ROWS = 500_000  # distinct scores that one task of an isotonic fit sorts and pools


def fit_isotonic(df: DataFrame, label: str, score_col: str) -> IsotonicRegressionModel:
    """Isotonic regression over all rows, as its column ``_q``.

    Rows of one score are one row of their mean and number, which is the same
    fit; ranges of scores are pooled by as many tasks as there are rows for, and
    the driver merges their pooled blocks.  Blocks of 0/1 labels have rising
    fractions, of which n rows hold no more than about n^(2/3) in a range.  A
    missing label still fails the fit."""
    y = F.when(F.count(label) == F.count(F.lit(1)), F.avg(label))
    pooled = df.groupBy(score_col).agg(y.alias(label), F.count(F.lit(1)).cast("double").alias("_n"))
    tasks = -(-df.count() // ISOTONIC_TASK_ROWS)
    return IsotonicRegression(featuresCol=score_col, labelCol=label, weightCol="_n", predictionCol="_q").fit(
        pooled.repartition(tasks) if tasks > 1 else pooled)


ISOTONIC_MAX_ROWS = 200_000  # of ``_bounded`` only: no fit is bounded


def _bounded(df: DataFrame, key: str) -> DataFrame:
    """At most about ``ISOTONIC_MAX_ROWS`` rows, by a share of the range of the
    key's 64-bit hash.  No query or fit uses it."""
    share = min(1.0, ISOTONIC_MAX_ROWS / max(df.count(), 1))
    if share >= 1.0:
        return df
    h = F.xxhash64(F.col(key).cast("string"), F.lit(SEED + 1))
    return df.where((h.cast("double") + 2.0 ** 63) / 2.0 ** 64 < share)


def calibration_candidates(df: DataFrame, label: str, score_col: str, key: str, seed: int = SEED) -> DataFrame:
    """Brier score of no calibration, Platt (logistic on the logit) and
    isotonic calibration, each fitted on a seeded 80 % and evaluated on the
    held-out 20 %.  Output ``candidate, brier`` (one row per candidate)."""
    d = hash_split(df.select(key, F.col(label).cast("double").alias("_y"),
                             F.col(score_col).cast("double").alias("_p")), key, 80, seed)
    eps = 1e-6
    pc = F.least(F.greatest(F.col("_p"), F.lit(eps)), F.lit(1 - eps))
    d = d.withColumn("_logit", F.log(pc / (1 - pc)))
    train, test = d.where(F.col("role") == "train"), d.where(F.col("role") == "test")
    va = VectorAssembler(inputCols=["_logit"], outputCol="_f")
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, probabilityCol="_pp",
                            rawPredictionCol="_rp", predictionCol="_pr").fit(va.transform(train))
    platt = lr.transform(va.transform(test)).withColumn("_q", vector_to_array("_pp")[1])
    isot = fit_isotonic(train, "_y", "_p").transform(test)
    b = lambda df_, col: df_.agg(F.avg((F.col(col) - F.col("_y")) ** 2).alias("brier"))
    return (b(test, "_p").select(F.lit("none").alias("candidate"), "brier")
            .unionByName(b(platt, "_q").select(F.lit("sigmoid").alias("candidate"), "brier"))
            .unionByName(b(isot, "_q").select(F.lit("isotonic").alias("candidate"), "brier")))


def apply_calibration(method: str, fitted_on: DataFrame, df: DataFrame, label: str, score_col: str, key: str) -> DataFrame:
    """``df`` with ``score_col`` calibrated by ``method`` (none, sigmoid or isotonic)
    fitted on all held-out scores."""
    if method == "none":
        return df
    eps = 1e-6
    logit = lambda c: F.log(F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps)) / (1 - F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))))
    base = fitted_on.select(F.col(label).cast("double").alias("_y"), F.col(score_col).cast("double").alias("_p"))
    if method == "sigmoid":
        va = VectorAssembler(inputCols=["_logit"], outputCol="_f")
        m = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, probabilityCol="_pp", rawPredictionCol="_rp",
                               predictionCol="_pr").fit(va.transform(base.withColumn("_logit", logit(F.col("_p")))))
        out = m.transform(va.transform(df.withColumn("_logit", logit(F.col(score_col)))))
        return out.withColumn(score_col, vector_to_array("_pp")[1]).drop("_logit", "_f", "_pp", "_rp", "_pr")
    m = fit_isotonic(base, "_y", "_p")
    return m.transform(df.withColumn("_p", F.col(score_col))).withColumn(score_col, F.col("_q")).drop("_p", "_q")


def choose_calibration(cands: DataFrame, n_rows: int, n_classes: int) -> DataFrame:
    """Lowest Brier; switch away from ``none`` only for a gain >= 1e-4; too few
    rows (< 50) or a single class -> ``none``."""
    base = cands.where(F.col("candidate") == "none").select(F.col("brier").alias("_base"))
    best = cands.where(F.col("candidate") != "none").orderBy("brier", "candidate").limit(1) \
        .select(F.col("candidate").alias("_best"), F.col("brier").alias("_bb"))
    pick = base.crossJoin(best).select(
        F.when((F.lit(n_rows) >= CALIBRATION_MIN_ROWS) & (F.lit(n_classes) >= 2)
               & (F.col("_base") - F.col("_bb") >= CALIBRATION_MIN_GAIN), F.col("_best"))
         .otherwise(F.lit("none")).alias("_chosen"))
    return cands.crossJoin(pick).select("candidate", rnd("brier", 6).alias("brier"),
                                        (F.col("candidate") == F.col("_chosen")).alias("chosen"))
