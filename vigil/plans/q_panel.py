"""Panel queries: temporal features, as-of history, splits, folds, features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions import decision as dec
from vigil.functions.numeric import rnd
from vigil.operators import features as feat
from vigil.operators import temporal
from vigil.operators.metrics import group_weights as _group_weights
from vigil.plans.bindings import PANEL_SQL, REQUESTS_SQL, panel, requests, with_ctes
from vigil.plans.registry import query
from vigil.plans.sqlkit import dbl
from vigil.session import run_folder
from vigil.sources import files
from vigil.sources.tables import read_table

LAG_COLS = ["idx", "act", "bal"]


@query("lag_features", with_ctes(PANEL_SQL) + """
SELECT entity_id, period,
       coalesce(CAST(lag(idx) OVER w AS DOUBLE), 0.0) AS idx_prev,
       coalesce(CAST(lag(act) OVER w AS DOUBLE), 0.0) AS act_prev,
       coalesce(CAST(lag(bal) OVER w AS DOUBLE), 0.0) AS bal_prev,
       CAST(row_number() OVER w = 1 AS INTEGER) AS is_new
FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY period)""")
def lag_features(spark, d):
    out = temporal.lag_features(panel(spark, d), "entity_id", "period", LAG_COLS)
    return out.select("entity_id", "period", "idx_prev", "act_prev", "bal_prev", "is_new")


@query("last_row_per_key", with_ctes(PANEL_SQL) + """
SELECT entity_id, period, idx, act FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period DESC) AS rn FROM panel) WHERE rn = 1""")
def last_row_per_key(spark, d):
    return temporal.last_row_per_key(panel(spark, d), "entity_id", "period", ["period", "idx", "act"])


ASOF_CTES = """
m AS (SELECT r.request_id, max(p.period) AS prior_period FROM requests r
      JOIN panel p ON p.entity_id = r.entity_id AND (r.period IS NULL OR p.period < r.period)
      GROUP BY r.request_id),
asof_t AS (
  SELECT r.request_id, r.entity_id, r.period, m.prior_period,
         coalesce(p.idx, 0.0) AS prior_idx, coalesce(CAST(p.act AS DOUBLE), 0.0) AS prior_act,
         coalesce(p.bal, 0.0) AS prior_bal, CAST(m.prior_period IS NULL AS INTEGER) AS is_new
  FROM requests r LEFT JOIN m ON m.request_id = r.request_id
  LEFT JOIN panel p ON p.entity_id = r.entity_id AND p.period = m.prior_period)"""


def _asof(spark, d):
    return temporal.asof_prior(requests(spark, d), panel(spark, d), "entity_id", "period", "period",
                               ["period", "idx", "act", "bal"])


@query("asof_prior", with_ctes(PANEL_SQL, REQUESTS_SQL, ASOF_CTES) + "SELECT * FROM asof_t")
def asof_prior(spark, d):
    return _asof(spark, d).select("request_id", "entity_id", "period", "prior_period", "prior_idx",
                                  "prior_act", "prior_bal", "is_new")


@query("temporal_split", with_ctes(PANEL_SQL) + """
SELECT entity_id, period, CASE WHEN period = (SELECT max(period) FROM panel) THEN 'test' ELSE 'train' END AS role
FROM panel""")
def temporal_split(spark, d):
    return temporal.temporal_split(panel(spark, d), "period").select("entity_id", "period", "role")


FOLDS_CTES = """
periods AS (SELECT period, row_number() OVER (ORDER BY period) AS pi FROM (SELECT DISTINCT period FROM panel
            WHERE period IS NOT NULL)),
folds AS (SELECT pi AS fold FROM periods WHERE pi < (SELECT max(pi) FROM periods)),
long AS (SELECT CAST(f.fold AS INTEGER) AS fold, 'train' AS role, p.* FROM panel p JOIN periods USING (period)
         JOIN folds f ON pi <= f.fold
         UNION ALL
         SELECT CAST(f.fold AS INTEGER), 'validation', p.* FROM panel p JOIN periods USING (period)
         JOIN folds f ON pi = f.fold + 1)"""


@query("expanding_folds", with_ctes(PANEL_SQL, FOLDS_CTES) + """
SELECT fold, role, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,
       min(period) AS min_period, max(period) AS max_period FROM long GROUP BY fold, role""")
def expanding_folds(spark, d):
    return temporal.fold_report(panel(spark, d), "period", "entity_id")


@query("fold_integrity", with_ctes(PANEL_SQL, FOLDS_CTES) + """
SELECT fold, max(period) FILTER (WHERE role = 'train') AS train_max,
       min(period) FILTER (WHERE role = 'validation') AS val_min,
       coalesce(max(period) FILTER (WHERE role = 'train') < min(period) FILTER (WHERE role = 'validation'), false)
         AS no_leakage
FROM long GROUP BY fold""")
def fold_integrity(spark, d):
    return temporal.fold_bounds(panel(spark, d), "period")


@query("latest_period_rows", with_ctes(PANEL_SQL) + """
SELECT entity_id, period, idx FROM panel
WHERE period = (SELECT max(period) FROM panel WHERE period BETWEEN 2000 AND 2026)
   OR (SELECT max(period) FROM panel WHERE period BETWEEN 2000 AND 2026) IS NULL""")
def latest_period_rows(spark, d):
    return temporal.latest_period_rows(panel(spark, d), "period").select("entity_id", "period", "idx")


STATS_CTES = """
train AS (SELECT * FROM panel WHERE period < (SELECT max(period) FROM panel)),
stats AS (SELECT CAST(floor(coalesce(median(start_period), median(period))) AS INTEGER) AS median_start,
                 coalesce(CAST(floor(median(age)) AS INTEGER), 12) AS median_age FROM train)"""


def _stats(spark, d, materialise: bool = False):
    s = temporal.temporal_split(panel(spark, d), "period")
    st = feat.train_statistics(s.where(F.col("role") == "train"), "start_period", "age", "period")
    # the statistics are a one-row artifact: computed once, then used as a literal table
    return spark.createDataFrame([st.first()], st.schema) if materialise else st


@query("train_statistics", with_ctes(PANEL_SQL, STATS_CTES) + "SELECT median_start, median_age FROM stats")
def train_statistics(spark, d):
    return _stats(spark, d)


@query("tenure_impute", with_ctes(PANEL_SQL, STATS_CTES) + """
SELECT entity_id, period, start_period,
       greatest(CAST(period AS DOUBLE) - coalesce(CAST(start_period AS DOUBLE), CAST(s.median_start AS DOUBLE)), 0.0)
         AS tenure
FROM panel, stats s""")
def tenure_impute(spark, d):
    p = panel(spark, d)
    out = feat.with_tenure(p, "start_period", F.col("period").cast("double"), _stats(spark, d, True))
    return out.select("entity_id", "period", "start_period", "tenure")


@query("group_weights", with_ctes(PANEL_SQL, """
gc AS (SELECT grp, count(*) AS n FROM panel GROUP BY grp),
gm AS (SELECT avg(n) AS m FROM gc)""") + """
SELECT p.entity_id, p.period, p.grp, round(gm.m / gc.n, 6) AS weight
FROM panel p JOIN gc ON gc.grp IS NOT DISTINCT FROM p.grp, gm""")
def group_weights(spark, d):
    w = _group_weights(panel(spark, d), "grp")
    return w.select("entity_id", "period", "grp", rnd("weight", 6).alias("weight"))


@query("scan_union_periods", """
WITH u AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_custkey AS entity_id, o_totalprice AS amount,
         CAST(NULL AS VARCHAR) AS priority
  FROM orders WHERE year(o_orderdate) < 1998
  UNION ALL
  SELECT CAST(year(o_orderdate) AS INTEGER), o_custkey, o_totalprice, o_orderpriority
  FROM orders WHERE year(o_orderdate) >= 1998)
SELECT period, count(*) AS n_rows, count(*) FILTER (WHERE priority IS NULL) AS n_missing_priority,
       round(sum(amount), 2) AS amount FROM u GROUP BY period""")
def scan_union_periods(spark, d):
    o = read_table(spark, d, "orders").withColumn("period", F.year("o_orderdate"))
    early = o.where(F.col("period") < 1998).select("period", F.col("o_custkey").alias("entity_id"),
                                                  F.col("o_totalprice").alias("amount"))
    late = o.where(F.col("period") >= 1998).select("period", F.col("o_custkey").alias("entity_id"),
                                                  F.col("o_totalprice").alias("amount"),
                                                  F.col("o_orderpriority").alias("priority"))
    u = files.union_all([early, late])
    return u.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(F.col("priority").isNull()).alias("n_missing_priority"),
                                   rnd(F.sum("amount"), 2).alias("amount"))


@query("scan_panel_periods", """
WITH s AS (SELECT 2020 + CAST(year(o_orderdate) AS INTEGER) % 10 AS period, CAST(o_custkey AS VARCHAR) AS ra, o_totalprice AS inde, o_orderpriority AS turma FROM orders)
SELECT period AS ANO_REFERENCIA, count(*) AS n_rows, count(DISTINCT ra) AS n_keys, round(sum(inde), 2) AS inde,
       CASE WHEN period % 2 = 0 THEN count(turma) ELSE 0 END AS n_turma FROM s GROUP BY period""")
def scan_panel_periods(spark, d):
    """The loader chain over one file per period, each with column names of its own (own year, case, blanks) and not all
    with the same columns: found by pattern, tagged by name, canonical, unioned by name, under the contract."""
    o = read_table(spark, d, "orders").withColumn("period", F.lit(2020) + F.year("o_orderdate") % 10)
    base = f"{run_folder(spark)}/panel-{uuid.uuid4().hex}"
    for p in sorted(r[0] for r in o.select("period").distinct().collect()):
        rows = o.where(F.col("period") == p)
        key, value = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")), F.col("o_totalprice").cast("string")
        own = [key.alias("ra"), value.alias(f"Inde {p}"), F.col("o_orderpriority").alias("Turma")] if p % 2 == 0 else [value.alias("INDE"), key.alias("Ra ")]
        rows.select(*own).write.parquet(f"{base}/sheet-{p}.parquet")
    panel_rows = files.scan_panel(spark, [f"{base}/sheet-*.parquet"], required=["RA", "INDE"], types={"INDE": "double"})
    return panel_rows.groupBy("ANO_REFERENCIA").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("RA").alias("n_keys"),
                                                    rnd(F.sum("INDE"), 2).alias("inde"), F.count("TURMA").alias("n_turma"))


@query("derive_label", with_ctes(PANEL_SQL) + """
SELECT entity_id, period, CAST(coalesce(bal < 0, false) AS INTEGER) AS label FROM panel""")
def derive_label(spark, d):
    out = feat.derive_label(panel(spark, d), gap="bal", index="idx")
    return out.select("entity_id", "period", "label")


CLIP_SPEC = {"period": "period", "start": "start_period", "age": "age", "tenure": "tenure",
             "priors": ["idx_prev"], "flag": "is_new", "group": "grp_class", "code": "code",
             "keep": ["entity_id", "period"]}


@query("clip_and_impute", with_ctes(PANEL_SQL, STATS_CTES, """
lagged AS (SELECT *, coalesce(CAST(lag(idx) OVER w AS DOUBLE), 0.0) AS idx_prev,
                  CAST(row_number() OVER w = 1 AS INTEGER) AS is_new
           FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY period)),
t AS (SELECT l.*, greatest(CAST(period AS DOUBLE) - coalesce(CAST(start_period AS DOUBLE),
                                                              CAST(s.median_start AS DOUBLE)), 0.0) AS tenure,
             s.median_age FROM lagged l, stats s)""") + """
SELECT entity_id, period,
       least(greatest(CASE WHEN age BETWEEN 4 AND 25 THEN CAST(age AS DOUBLE)
                           ELSE coalesce(CAST(median_age AS DOUBLE), 12.0) END, 4.0), 25.0) AS age,
       least(greatest(tenure, 0.0), 30.0) AS tenure,
       least(greatest(idx_prev, 0.0), 10.0) AS idx_prev,
       least(greatest(is_new, 0), 1) AS is_new,
       CASE WHEN lower(trim(grp)) IS NULL THEN 'Outro'
            WHEN regexp_matches(lower(trim(grp)), 'fem|menina|mulher|garota|feminino|f') THEN 'Feminino'
            WHEN regexp_matches(lower(trim(grp)), 'masc|menino|homem|garoto|masculino|m') THEN 'Masculino'
            ELSE 'Outro' END AS grp_class,
       coalesce(nullif(regexp_replace(upper(grp), '[^A-Z0-9]', '', 'g'), ''), '0') AS code
FROM t""")
def clip_and_impute(spark, d):
    lagged = temporal.lag_features(panel(spark, d), "entity_id", "period", ["idx"])
    src = lagged.withColumn("grp_class", F.col("grp")).withColumn("code", F.col("grp"))
    out = feat.process_features(src, CLIP_SPEC, stats=_stats(spark, d, True))
    return out.select("entity_id", "period", "age", "tenure", "idx_prev", "is_new", "grp_class", "code")


T = dec.DEFAULT_THRESHOLD


@query("score_with_history", with_ctes(PANEL_SQL, REQUESTS_SQL, ASOF_CTES, """
sc AS (SELECT *, least(greatest(prior_idx / 10.0, 0.0), 1.0) AS p FROM asof_t)""") + f"""
SELECT request_id, round(p, 6) AS probability, CAST(p >= {dbl(T)} AS INTEGER) AS prediction,
       CASE WHEN p < 0.3 THEN 'low' WHEN p < {dbl(T)} THEN 'medium' ELSE 'high' END AS segment,
       (p >= greatest(0.0, {dbl(T)} - 0.02) AND p <= least(1.0, {dbl(T)} + 0.02)) OR is_new = 1 AS review
FROM sc""")
def score_with_history(spark, d):
    a = _asof(spark, d)
    p = F.least(F.greatest(F.col("prior_idx") / 10.0, F.lit(0.0)), F.lit(1.0))
    s = a.withColumn("p", p)
    return s.select("request_id", rnd("p", 6).alias("probability"),
                    dec.decision("p", T).alias("prediction"), dec.segment("p", T).alias("segment"),
                    (dec.review_band("p", T) | (F.col("is_new") == 1)).alias("review"))


@query("risk_drivers", with_ctes(PANEL_SQL, REQUESTS_SQL, ASOF_CTES, """
attrs AS (SELECT c_custkey AS entity_id,
                 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(1988 + c_custkey % 9 AS INTEGER) END AS start_period,
                 CAST(c_nationkey AS INTEGER) AS age FROM customer),
x AS (SELECT a.request_id,
             CASE WHEN a.period IS NOT NULL AND a.period <> 0 AND t.start_period IS NOT NULL AND t.start_period <> 0
                  THEN greatest(0.0, CAST(a.period - t.start_period AS DOUBLE)) ELSE 0.0 END AS tenure,
             a.prior_act, a.prior_idx, a.is_new, coalesce(t.age, 0) AS age
      FROM asof_t a LEFT JOIN attrs t ON t.entity_id = a.entity_id),
l AS (SELECT request_id, list_filter([
        CASE WHEN prior_act <= 4.0 THEN 'drop in prior engagement' END,
        CASE WHEN prior_idx <= 5.0 THEN 'low prior index' END,
        CASE WHEN is_new = 1 OR tenure <= 1 THEN 'short tenure' END,
        CASE WHEN age >= 15 THEN 'age above grade average' END], lambda v: v IS NOT NULL) AS fired FROM x)""") + """
SELECT request_id, CASE WHEN len(fired) = 0 THEN 'stable history without a dominant critical signal'
                        ELSE array_to_string(list_slice(fired, 1, 3), '|') END AS drivers
FROM l""")
def risk_drivers(spark, d):
    a = _asof(spark, d)
    c = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(1988) + F.col("c_custkey") % 9).cast("int")).alias("start_period"),
        F.col("c_nationkey").cast("int").alias("age"))
    x = a.join(c, "entity_id", "left")
    truthy = lambda col: F.col(col).isNotNull() & (F.col(col) != 0)
    tenure = F.when(truthy("period") & truthy("start_period"),
                    F.greatest(F.lit(0.0), (F.col("period") - F.col("start_period")).cast("double"))
                    ).otherwise(F.lit(0.0))
    drv = dec.risk_drivers("prior_act", "prior_idx", "is_new", tenure, "age")
    return x.select("request_id", F.array_join(drv, "|").alias("drivers"))
