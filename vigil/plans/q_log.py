"""Monitoring queries on the ``log`` binding (events as a prediction log)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators import drift
from vigil.plans.bindings import LOG_FEATURES, LOG_SQL, VERSIONS_LOG_SQL, log, versions_log, with_ctes
from vigil.plans.registry import query
from vigil.session import run_folder
from vigil.sources import files, registry
from vigil.sources.tables import read_table

# fixed values of the reference configuration (event defaults)
ENVIRONMENT_DEFAULT = "dev"
SERVICE_NAME = "vigil-monitor"
TAIL_ROWS = 1000


def _split(spark, d):
    lg = log(spark, d)
    return lg.where(F.col("is_ref")), lg.where(~F.col("is_ref"))


def _sql_long(src: str, feats: list[str], group: str | None) -> str:
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f"SELECT {g}'{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {src} WHERE {f} IS NOT NULL" for f in feats)


_PROBS = ", ".join(repr(k / 10) for k in range(11))
_BIN = ("CASE WHEN x.v < e.edges[1] OR x.v > e.edges[len(e.edges)] THEN NULL "
        "ELSE greatest(1, len(list_filter(e.edges, lambda t: t < x.v))) END")


def psi_ctes(group: str | None = None, cur_src: str = "cur") -> str:
    """PSI table as SQL CTEs ending in ``psi_tbl`` (optionally per current-side group)."""
    g = f"{group}, " if group else ""
    gj = (lambda a, b: f" AND {a}.{group} = {b}.{group}") if group else (lambda a, b: "")
    return f"""
ref AS (SELECT * FROM log WHERE is_ref),
cur AS (SELECT * FROM log WHERE NOT is_ref),
rl AS ({_sql_long('ref', LOG_FEATURES, None)}),
cl AS ({_sql_long(cur_src, LOG_FEATURES, group)}),
qs AS (SELECT feature, quantile_cont(v, [{_PROBS}]) AS qv FROM rl GROUP BY feature),
qe AS (SELECT feature, unnest(qv) AS e FROM qs),
edges AS (SELECT feature, list_sort(list_distinct(list(e))) AS edges FROM qe GROUP BY feature),
rb AS (SELECT x.feature, {_BIN} AS bin FROM rl x JOIN edges e ON x.feature = e.feature),
cb AS (SELECT {('x.' + group + ', ') if group else ''}x.feature, {_BIN} AS bin FROM cl x
       JOIN edges e ON x.feature = e.feature),
rt AS (SELECT feature, count(*) AS n_ref, count(bin) AS r_in FROM rb GROUP BY feature),
ct AS (SELECT {g}feature, count(*) AS n_cur, count(bin) AS c_in FROM cb GROUP BY {g}feature),
rn AS (SELECT feature, bin, count(*) AS n FROM rb WHERE bin IS NOT NULL GROUP BY feature, bin),
cn AS (SELECT {g}feature, bin, count(*) AS n FROM cb WHERE bin IS NOT NULL GROUP BY {g}feature, bin),
dom AS (SELECT {('ct.' + group + ', ') if group else ''}ct.feature, unnest(range(1, len(e.edges))) AS bin
        FROM ct JOIN edges e ON e.feature = ct.feature),
terms AS (
  SELECT {('d.' + group + ', ') if group else ''}d.feature, coalesce(rn.n, 0) / rt.r_in AS r,
         coalesce(cn.n, 0) / ct.c_in AS c
  FROM dom d JOIN rt ON d.feature = rt.feature JOIN ct ON d.feature = ct.feature{gj('ct', 'd')}
  LEFT JOIN rn ON rn.feature = d.feature AND rn.bin = d.bin
  LEFT JOIN cn ON cn.feature = d.feature AND cn.bin = d.bin{gj('cn', 'd')}
  WHERE ct.c_in > 0),
s AS (SELECT {g}feature, sum(((c + 1e-6) - (r + 1e-6)) * ln((c + 1e-6) / (r + 1e-6))) AS s FROM terms
      GROUP BY {g}feature),
rm AS (SELECT feature, avg(v) AS rm FROM rl GROUP BY feature),
cm AS (SELECT {g}feature, avg(v) AS cm FROM cl GROUP BY {g}feature),
psi_raw AS (
  SELECT {('ct.' + group + ', ') if group else ''}ct.feature,
         CASE WHEN rt.n_ref = 0 OR ct.n_cur = 0 OR len(e.edges) < 3 THEN 0.0
              WHEN ct.c_in = 0 THEN NULL ELSE round(s.s, 6) END AS psi_raw
  FROM ct JOIN rt ON ct.feature = rt.feature JOIN edges e ON e.feature = ct.feature
  LEFT JOIN s ON s.feature = ct.feature{gj('s', 'ct')}),
psi_tbl AS (
  SELECT {('p.' + group + ', ') if group else ''}p.feature, round(p.psi_raw, 4) AS psi,
         round(rm.rm, 4) AS reference_mean,
         round(cm.cm, 4) AS current_mean, round(cm.cm - rm.rm, 4) AS delta_mean,
         CASE WHEN cm.cm > rm.rm THEN 'increase' ELSE 'decrease_or_stable' END AS direction,
         coalesce(p.psi_raw >= 0.2, false) AS drift_flag,
         p.psi_raw IS NULL AS all_out_of_range
  FROM psi_raw p JOIN rm ON rm.feature = p.feature JOIN cm ON cm.feature = p.feature{gj('cm', 'p')})"""


PSI = with_ctes(LOG_SQL, psi_ctes())


def _psi(spark, d):
    ref, cur = _split(spark, d)
    return drift.psi_table(ref, cur, LOG_FEATURES)


@query("psi_by_feature", PSI + "SELECT * FROM psi_tbl")
def psi_by_feature(spark, d):
    return _psi(spark, d)


TOP_SQL = """
top AS (SELECT CAST(row_number() OVER (ORDER BY psi DESC NULLS LAST, feature ASC) AS INTEGER) AS rank, feature, psi
        FROM psi_tbl)"""


@query("psi_top_features", PSI + "," + TOP_SQL + " SELECT * FROM top WHERE rank <= 5")
def psi_top_features(spark, d):
    return drift.top_features(_psi(spark, d))


RATE_SQL = """
rates AS (SELECT round(coalesce(avg(CASE WHEN coalesce(CAST(prediction AS DOUBLE), 0.0) = 1.0 THEN 1.0 ELSE 0.0 END)
                                FILTER (WHERE is_ref), 0.0) * 100.0, 2) AS reference_rate,
                 round(coalesce(avg(CASE WHEN coalesce(CAST(prediction AS DOUBLE), 0.0) = 1.0 THEN 1.0 ELSE 0.0 END)
                                FILTER (WHERE NOT is_ref), 0.0) * 100.0, 2) AS current_rate FROM log),
shift AS (SELECT reference_rate, current_rate, round(current_rate - reference_rate, 2) AS delta_pp,
                 CASE WHEN reference_rate > 0 THEN round((current_rate - reference_rate) / reference_rate * 100.0, 2)
                      WHEN current_rate > 0 THEN 100.0 ELSE 0.0 END AS change_pct FROM rates),
shift2 AS (SELECT *, abs(change_pct) >= 20.0 AS shift_alert FROM shift)"""


@query("rate_shift", with_ctes(LOG_SQL, RATE_SQL) + "SELECT * FROM shift2")
def rate_shift(spark, d):
    ref, cur = _split(spark, d)
    return drift.rate_shift(ref, cur)


STATUS_SQL = """
summ AS (SELECT round(coalesce(avg(psi), 0.0), 4) AS avg_psi, count(*) FILTER (WHERE drift_flag) AS n_drifted
         FROM psi_tbl),
status AS (SELECT summ.*,
                  CASE WHEN avg_psi >= 0.35 OR shift2.shift_alert THEN 'critical'
                       WHEN avg_psi >= 0.2 THEN 'moderate' ELSE 'stable' END AS drift_status
           FROM summ, shift2)"""


def _status(spark, d, psi_tbl=None):
    ref, cur = _split(spark, d)
    s = drift.drift_summary(psi_tbl if psi_tbl is not None else _psi(spark, d))
    r = drift.rate_shift(ref, cur)
    j = s.crossJoin(r)
    return j.withColumn("drift_status", drift.drift_status_col(F.col("avg_psi"), F.col("shift_alert")))


@query("drift_status", PSI + "," + RATE_SQL + "," + STATUS_SQL +
       " SELECT avg_psi, n_drifted, shift_alert, drift_status FROM status, shift2")
def drift_status(spark, d):
    return _status(spark, d).select("avg_psi", "n_drifted", "shift_alert", "drift_status")


@query("drift_alerts", PSI + """
SELECT feature, psi, printf('Feature %s with PSI=%.4f above the limit (direction: %s).', feature, psi,
                            coalesce(direction, 'n/a')) AS message
FROM psi_tbl WHERE psi >= 0.2""")
def drift_alerts(spark, d):
    return drift.drift_alerts(_psi(spark, d))


MISSING_COLS = ["value", "k", "source", "prediction"]
JSON_SQL = """
js AS (SELECT event_id, ts, user_id, value, prediction, is_ref,
              TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              json_extract_string(props, '$.source') AS source FROM log),
miss AS (SELECT round(CASE WHEN count(*) = 0 THEN 0.0 ELSE
           (count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE k IS NULL)
            + count(*) FILTER (WHERE source IS NULL) + count(*) FILTER (WHERE prediction IS NULL))
           / (count(*) * 4.0) END, 6) AS missing_ratio FROM js WHERE NOT is_ref)"""

LOG_RECORD = "k bigint, source string"


def _records(spark, d):
    """The log as nested records (features + result), as a prediction log has them."""
    lg = log(spark, d)
    feats = F.from_json(F.col("props"), LOG_RECORD)
    rec = lg.select(
        "event_id", "ts", "is_ref",
        F.struct(feats.getField("k").alias("k"), feats.getField("source").alias("source"),
                 F.col("value"), F.col("user_id")).alias("input_features"),
        F.struct(F.col("prediction").alias("class"),
                 rnd(F.col("value") / 500.0, 6).alias("probability")).alias("prediction_result"))
    return rec


def _flat(spark, d):
    return files.flatten_structs(_records(spark, d), ["input_features", "prediction_result"],
                                 rename={"class": "prediction"})


@query("missing_ratio", with_ctes(LOG_SQL, JSON_SQL) + "SELECT missing_ratio FROM miss")
def missing_ratio(spark, d):
    cur = _flat(spark, d).where(~F.col("is_ref"))
    return drift.missing_ratio(cur, MISSING_COLS)


@query("json_extract_fields", with_ctes(LOG_SQL, JSON_SQL) + """
SELECT event_id, k, source, value, user_id, prediction, round(value / 500.0, 6) AS probability FROM js""")
def json_extract_fields(spark, d):
    return _flat(spark, d).select("event_id", "k", "source", "value", "user_id", "prediction", "probability")


@query("tail_recent_n", with_ctes(LOG_SQL) + f"""
SELECT event_id, ts, value, prediction FROM log ORDER BY ts DESC, event_id DESC LIMIT {TAIL_ROWS}""")
def tail_recent_n(spark, d):
    return files.tail_rows(log(spark, d), TAIL_ROWS, ["ts", "event_id"]).select("event_id", "ts", "value",
                                                                               "prediction")


SNAPSHOT_SQL = """
tops AS (SELECT max(CASE WHEN rank = 1 THEN feature END) AS t1, max(CASE WHEN rank = 2 THEN feature END) AS t2,
                max(CASE WHEN rank = 3 THEN feature END) AS t3 FROM top),
ncur AS (SELECT count(*) AS samples, max(ts) AS window_ts FROM log WHERE NOT is_ref AND prediction IS NOT NULL)"""


def _snapshot(spark, d):
    """One scan of the log: the records' fields, the features and the side of the split."""
    feats = F.from_json(F.col("props"), "source string")
    rows = log(spark, d).withColumn("source", feats.getField("source"))
    return drift.snapshot(rows, "is_ref", LOG_FEATURES, cells=MISSING_COLS, time="ts")


@query("drift_snapshot", PSI + "," + RATE_SQL + "," + STATUS_SQL + "," + TOP_SQL + "," + JSON_SQL + "," +
       SNAPSHOT_SQL + """
SELECT CASE WHEN samples >= 5 THEN 'updated' ELSE 'insufficient_samples' END AS status, samples >= 5 AS updated,
       samples, avg_psi, n_drifted, reference_rate, current_rate, change_pct, shift_alert, missing_ratio,
       drift_status, coalesce(t1, '') AS top_drift_feature_1, coalesce(t2, '') AS top_drift_feature_2,
       coalesce(t3, '') AS top_drift_feature_3
FROM status, shift2, tops, miss, ncur""")
def drift_snapshot(spark, d):
    return _snapshot(spark, d).select(
        "status", "updated", "samples", "avg_psi", "n_drifted", "reference_rate", "current_rate", "change_pct", "shift_alert", "missing_ratio",
        "drift_status", *[F.coalesce(F.col(f"t{i}"), F.lit("")).alias(f"top_drift_feature_{i}") for i in (1, 2, 3)])


GUARD_CASE = ("CASE WHEN (SELECT count(*) FROM log WHERE is_ref) = 0 THEN 'reference_not_found' WHEN n = 0 THEN 'empty_or_invalid_logs' "
              "WHEN n < 5 THEN 'insufficient_samples' ELSE 'updated' END")


@query("snapshot_guards", with_ctes(LOG_SQL, """
cur AS (SELECT * FROM log WHERE NOT is_ref AND prediction IS NOT NULL),
cases AS (
  SELECT 'whole' AS scenario, count(*) AS n FROM cur
  UNION ALL SELECT 'newest', count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM cur)) FROM cur
  UNION ALL SELECT 'future', count(*) FILTER (WHERE ts > (SELECT max(ts) FROM cur)) FROM cur)""") + f"""
SELECT scenario, {GUARD_CASE} AS status, {GUARD_CASE} = 'updated' AS updated, n AS samples FROM cases
UNION ALL SELECT 'no_reference', 'reference_not_found', false, 0
UNION ALL SELECT 'no_log', 'logs_not_found', false, 0""")
def snapshot_guards(spark, d):
    """Every status of the snapshot's guard, from sources that are whole, short, empty or not there."""
    ref, cur = _split(spark, d)
    gone = files.open_if_there(spark, f"{d}/no-such-table.parquet")
    latest = cur.where(F.col("prediction").isNotNull()).agg(F.max("ts")).scalar()
    cases = {"whole": (ref, cur), "newest": (ref, cur.where(F.col("ts") >= latest)), "future": (ref, cur.where(F.col("ts") > latest)),
             "no_reference": (gone, cur), "no_log": (ref, gone)}
    rows = [drift.snapshot_status(spark, *sides).select(F.lit(name).alias("scenario"), "*") for name, sides in cases.items()]
    return reduce(DataFrame.unionByName, rows)


@query("psi_distributions", PSI + """
SELECT d.feature, CAST(d.bin AS INTEGER) AS bin, round(e.edges[d.bin], 6) AS lower, round(e.edges[d.bin + 1], 6) AS upper,
       round(coalesce(rn.n, 0) / rt.r_in, 6) AS reference_share, round(coalesce(cn.n, 0) / ct.c_in, 6) AS current_share,
       round(((coalesce(cn.n, 0) / ct.c_in + 1e-6) - (coalesce(rn.n, 0) / rt.r_in + 1e-6))
             * ln((coalesce(cn.n, 0) / ct.c_in + 1e-6) / (coalesce(rn.n, 0) / rt.r_in + 1e-6)), 6) AS contribution
FROM dom d JOIN edges e ON d.feature = e.feature JOIN rt ON d.feature = rt.feature JOIN ct ON d.feature = ct.feature
LEFT JOIN rn ON rn.feature = d.feature AND rn.bin = d.bin LEFT JOIN cn ON cn.feature = d.feature AND cn.bin = d.bin
WHERE len(e.edges) >= 3 AND ct.c_in > 0""")
def psi_distributions(spark, d):
    """The bins behind the PSI table: edges, reference and current shares, contributions."""
    ref, cur = _split(spark, d)
    return drift.psi_distributions(drift.psi_fit(ref, LOG_FEATURES), cur)


@query("event_snapshot", PSI + "," + RATE_SQL + "," + STATUS_SQL + "," + TOP_SQL + "," + JSON_SQL + "," +
       SNAPSHOT_SQL + "," + VERSIONS_LOG_SQL + f"""
SELECT CAST(avg_psi AS DOUBLE) AS drift_score, CAST(n_drifted AS BIGINT) AS number_of_drifted_features,
       CAST(current_rate AS DOUBLE) AS risk_rate, CAST(missing_ratio AS DOUBLE) AS missing_ratio,
       coalesce(drift_status, 'unknown') AS drift_status, CAST(change_pct AS DOUBLE) AS high_risk_change_pct,
       coalesce(shift_alert, false) AS significant_shift_alert,
       coalesce(t1, '') AS top_drift_feature_1, coalesce(t2, '') AS top_drift_feature_2,
       coalesce(t3, '') AS top_drift_feature_3, (SELECT max_by(version, valid_from) FROM versions WHERE valid_from <= window_ts) AS model_version,
       window_ts AS window_timestamp, '{ENVIRONMENT_DEFAULT}' AS environment, '{SERVICE_NAME}' AS service_name
FROM status, shift2, tops, miss, ncur""")
def event_snapshot(spark, d):
    s = registry.in_force(_snapshot(spark, d), "window_ts", versions_log(spark, d))
    num = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default))
    return s.select(
        num("avg_psi").alias("drift_score"),
        F.coalesce(F.col("n_drifted").cast("long"), F.lit(0).cast("long")).alias("number_of_drifted_features"),
        num("current_rate").alias("risk_rate"), num("missing_ratio").alias("missing_ratio"),
        F.coalesce("drift_status", F.lit("unknown")).alias("drift_status"),
        num("change_pct").alias("high_risk_change_pct"),
        F.coalesce("shift_alert", F.lit(False)).alias("significant_shift_alert"),
        *[F.coalesce(F.col(f"t{i}"), F.lit("")).alias(f"top_drift_feature_{i}") for i in (1, 2, 3)],
        "model_version", F.col("window_ts").alias("window_timestamp"),
        F.lit(ENVIRONMENT_DEFAULT).alias("environment"), F.lit(SERVICE_NAME).alias("service_name"))


HISTORY = with_ctes(LOG_SQL, "curd AS (SELECT *, date_trunc('day', ts) AS day FROM log WHERE NOT is_ref)",
                    psi_ctes("day", "curd"))


TREND_SQL = """,
hs AS (SELECT day, round(coalesce(avg(psi), 0.0), 4) AS avg_psi FROM psi_tbl GROUP BY day),
hr AS (SELECT day, count(*) AS n,
              round(coalesce(avg(CASE WHEN coalesce(CAST(prediction AS DOUBLE), 0.0) = 1.0 THEN 1.0 ELSE 0.0 END),
                             0.0) * 100.0, 2) AS high_risk_rate FROM curd GROUP BY day)"""


@query("drift_history_trend", HISTORY + TREND_SQL + " SELECT hr.day, hr.n, hr.high_risk_rate, hs.avg_psi FROM hr JOIN hs ON hs.day = hr.day")
def drift_history_trend(spark, d):
    """One snapshot per day of the current period against the reference:
    the history table (day, rate, average PSI) computed in one grouped job."""
    ref, cur = _split(spark, d)
    cur = cur.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    p = drift.psi_table(ref, cur, LOG_FEATURES, group_cols=["day"])
    s = drift.drift_summary(p, "day").select("day", "avg_psi")
    r = cur.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    rate = drift.positive_rate(cur, "prediction", group_cols=["day"]).withColumnRenamed("rate", "high_risk_rate")
    return r.join(rate, "day").join(s, "day").select("day", "n", "high_risk_rate", "avg_psi")


RECORD_SCHEMA = ("event_id bigint, ts timestamp_ntz, is_ref boolean, input_features struct<k:bigint,source:string,value:double,user_id:bigint>, "
                 "prediction_result struct<class:int,probability:double>")


@query("scan_jsonl_log", with_ctes(LOG_SQL, JSON_SQL) + """
SELECT source, is_ref, count(*) AS n, count(k) AS n_k, round(sum(value), 4) AS value, CAST(sum(prediction) AS BIGINT) AS positives, max(ts) AS last_ts
FROM js GROUP BY source, is_ref
UNION ALL SELECT 'malformed', NULL, 2, 0, NULL, NULL, NULL""")
def scan_jsonl_log(spark, d):
    """The prediction log as JSON lines, two of them broken: scanned with a schema, flattened, counted by source.  A broken
    line is a row of nulls, and does not fail its file."""
    path = f"{run_folder(spark)}/log-{uuid.uuid4().hex}"
    lines = _records(spark, d).select(F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
    broken = spark.createDataFrame([('{"event_id": 12, "ts": "2024-',), ("not json",)], "value string")
    lines.unionByName(broken).write.text(path)
    flat = files.flatten_structs(files.scan_jsonl(spark, path, RECORD_SCHEMA), ["input_features", "prediction_result"], rename={"class": "prediction"})
    lost = F.col("ts").isNull()
    return (flat.groupBy(F.when(lost, "malformed").otherwise(F.col("source")).alias("source"), "is_ref")
            .agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_k"), rnd(F.sum("value"), 4).alias("value"),
                 F.sum(F.col("prediction").cast("long")).alias("positives"), F.max("ts").alias("last_ts")))


@query("scan_csv_delimiters", """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'semicolon' ELSE 'comma' END AS file, count(*) AS n, count(DISTINCT o_custkey) AS n_keys,
       CAST(sum(year(o_orderdate)) AS BIGINT) AS periods FROM orders GROUP BY 1""")
def scan_csv_delimiters(spark, d):
    """Two history files, one with ``;`` and one with ``,``, by the same reader with its required column."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("RA"), F.year("o_orderdate").alias("ANO_REFERENCIA"))
    base, out = f"{run_folder(spark)}/history-{uuid.uuid4().hex}", []
    for i, (name, sep) in enumerate((("semicolon", ";"), ("comma", ","))):
        o.where(F.col("o_orderkey") % 2 == i).drop("o_orderkey").write.option("header", "true").option("sep", sep).csv(f"{base}/{name}")
        out.append(files.scan_csv(spark, f"{base}/{name}", required=["ANO_REFERENCIA"]).withColumn("file", F.lit(name)))
    return files.union_all(out).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("RA").alias("n_keys"),
                                                    F.sum(F.col("ANO_REFERENCIA").cast("long")).alias("periods"))
