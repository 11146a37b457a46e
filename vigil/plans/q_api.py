"""Dashboard queries on the ``api`` binding (events as service requests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators import obs
from vigil.plans.bindings import API_SQL, api, with_ctes
from vigil.plans.registry import query

TYPES = ["error", "view", "click", "purchase", "signup"]
NOW = "now_t AS (SELECT max(ts) AS now FROM api)"


@query("events_by_type", with_ctes(API_SQL, NOW) + "SELECT count(*) AS n_total, " + ", ".join(
    f"count(*) FILTER (WHERE name = '{t}') AS n_{t}" for t in TYPES) + """,
  count(*) FILTER (WHERE ts >= now - INTERVAL 60 MINUTE) AS n_last_60m,
  count(*) FILTER (WHERE ts >= now - INTERVAL 60 MINUTE AND error) AS n_error_last_60m,
  count(*) FILTER (WHERE ts >= now - INTERVAL 24 HOUR) AS n_last_24h,
  count(*) FILTER (WHERE ts >= now - INTERVAL 24 HOUR AND error) AS n_error_last_24h
FROM api, now_t""")
def events_by_type(spark, d):
    a = obs.with_now(api(spark, d), "ts")
    return a.agg(F.count(F.lit(1)).alias("n_total"),
                 *[F.count_if(F.col("name") == t).alias(f"n_{t}") for t in TYPES],
                 F.count_if(obs.since("ts", 60)).alias("n_last_60m"),
                 F.count_if(obs.since("ts", 60) & F.col("error")).alias("n_error_last_60m"),
                 F.count_if(obs.since("ts", 24 * 60)).alias("n_last_24h"),
                 F.count_if(obs.since("ts", 24 * 60) & F.col("error")).alias("n_error_last_24h"))


@query("latest_by_facet", with_ctes(API_SQL) + """
SELECT host, duration AS latest_duration, name AS latest_name, ts AS latest_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS rn FROM api) WHERE rn = 1""")
def latest_by_facet(spark, d):
    return obs.latest_by(api(spark, d), "host", "ts", ["duration", "name"], tiebreak="event_id")


@query("facet_topn", with_ctes(API_SQL) + """
SELECT user_id, round(avg(duration), 6) AS avg_duration, count(*) AS n FROM api GROUP BY user_id
ORDER BY avg_duration DESC, user_id ASC LIMIT 20""")
def facet_topn(spark, d):
    agg = api(spark, d).groupBy("user_id").agg(rnd(F.avg("duration"), 6).alias("avg_duration"),
                                               F.count(F.lit(1)).alias("n"))
    return obs.top_n(agg, "avg_duration", 20, ["user_id"])


@query("facet_multi", with_ctes(API_SQL) + "SELECT name, host, count(*) AS n FROM api GROUP BY name, host")
def facet_multi(spark, d):
    return api(spark, d).groupBy("name", "host").agg(F.count(F.lit(1)).alias("n"))


@query("facet_case", with_ctes(API_SQL) + """
SELECT CASE WHEN CAST(user_id AS VARCHAR) LIKE '4%' THEN '4xx'
            WHEN CAST(user_id AS VARCHAR) LIKE '5%' THEN '5xx' ELSE 'other' END AS status_class,
       count(*) AS n, count(*) FILTER (WHERE name LIKE '%ro%' OR name IN ('view')) AS n_matching
FROM api GROUP BY 1""")
def facet_case(spark, d):
    code = F.col("user_id").cast("string")
    cls = F.when(code.like("4%"), "4xx").when(code.like("5%"), "5xx").otherwise("other")
    match = F.col("name").like("%ro%") | F.col("name").isin("view")
    return api(spark, d).groupBy(cls.alias("status_class")).agg(F.count(F.lit(1)).alias("n"),
                                                                F.count_if(match).alias("n_matching"))


@query("unique_count", with_ctes(API_SQL) + """
SELECT count(DISTINCT user_id) FILTER (WHERE error) AS users_with_errors, count(DISTINCT user_id) AS users
FROM api""")
def unique_count(spark, d):
    a = api(spark, d)
    return a.agg(F.countDistinct(F.when(F.col("error"), F.col("user_id"))).alias("users_with_errors"),
                 F.countDistinct("user_id").alias("users"))


@query("event_rate", with_ctes(API_SQL, """
r AS (SELECT date_diff('microsecond', min(ts), max(ts)) / 60e6 AS minutes FROM api)""") + """
SELECT name, count(*) AS n, round(count(*) / max(r.minutes), 6) AS rate_per_min FROM api, r GROUP BY name""")
def event_rate(spark, d):
    a = api(spark, d)
    minutes = obs.range_minutes(a, "ts")
    return (a.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
            .select("name", "n", rnd(F.col("n") / minutes, 6).alias("rate_per_min")))


@query("latency_percentiles", with_ctes(API_SQL, """
q AS (SELECT name, quantile_cont(duration, [0.5, 0.95, 0.99]) AS qs FROM api GROUP BY name)""") + """
SELECT name, round(qs[1], 6) AS p50, round(qs[2], 6) AS p95, round(qs[3], 6) AS p99 FROM q""")
def latency_percentiles(spark, d):
    p = obs.percentiles(api(spark, d), "duration", [0.5, 0.95, 0.99], "name")
    return p.select("name", *[rnd(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("error_percentage", with_ctes(API_SQL) + """
SELECT host, count(*) AS n, round(100.0 * avg(CAST(error AS INTEGER)), 4) AS error_pct FROM api GROUP BY host""")
def error_percentage(spark, d):
    return api(spark, d).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), rnd(100.0 * F.avg(F.col("error").cast("int")), 4).alias("error_pct"))


@query("apdex", with_ctes(API_SQL) + """
SELECT name, round((count(*) FILTER (WHERE duration <= 0.5)
                    + count(*) FILTER (WHERE duration > 0.5 AND duration <= 2.0) / 2.0) / count(*), 4) AS apdex
FROM api GROUP BY name""")
def apdex(spark, d):
    return api(spark, d).groupBy("name").agg(rnd(obs.apdex("duration", obs.APDEX_T), 4).alias("apdex"))


@query("slowest_endpoints", with_ctes(API_SQL) + """
SELECT name, round(quantile_cont(duration, 0.95), 6) AS p95, count(*) AS n,
       count(*) FILTER (WHERE error) AS n_errors
FROM api GROUP BY name ORDER BY p95 DESC, name ASC LIMIT 15""")
def slowest_endpoints(spark, d):
    a = api(spark, d)
    p = obs.percentiles(a, "duration", [0.95], "name").select("name", rnd("p95", 6).alias("p95"))
    c = a.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("n_errors"))
    return obs.top_n(p.join(c, "name"), "p95", 15, ["name"])


@query("timeseries_avg", with_ctes(API_SQL) + """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, round(avg(duration), 6) AS avg_duration,
       count(*) AS n FROM api GROUP BY 1""")
def timeseries_avg(spark, d):
    return obs.time_series(api(spark, d), "ts", "5 minutes",
                           [rnd(F.avg("duration"), 6).alias("avg_duration"), F.count(F.lit(1)).alias("n")])


@query("timeseries_percentile", with_ctes(API_SQL) + """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, round(quantile_cont(duration, 0.95), 6) AS p95
FROM api WHERE duration IS NOT NULL GROUP BY 1""")
def timeseries_percentile(spark, d):
    """Exact 95th percentile of the duration per hour; the hours are groups without a bound."""
    hours = api(spark, d).select(F.window("ts", "1 hour").alias("w"), "duration").select(F.col("w.start").alias("bucket_start"), "duration")
    return obs.percentiles(hours, "duration", [0.95], ["bucket_start"]).select("bucket_start", rnd("p95", 6).alias("p95"))


@query("timeseries_facet_topn", with_ctes(API_SQL, """
top AS (SELECT host FROM api GROUP BY host ORDER BY avg(duration) DESC, host ASC LIMIT 8)""") + """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, host, round(avg(duration), 6) AS avg_duration,
       count(*) AS n
FROM api WHERE host IN (SELECT host FROM top) GROUP BY 1, 2""")
def timeseries_facet_topn(spark, d):
    a = api(spark, d)
    top = obs.top_n(a.groupBy("host").agg(F.avg("duration").alias("_avg")), "_avg", 8, ["host"]).select("host")
    sel = a.join(F.broadcast(top), "host", "left_semi")  # at most 8 rows
    return obs.time_series(sel, "ts", "1 hour",
                           [rnd(F.avg("duration"), 6).alias("avg_duration"), F.count(F.lit(1)).alias("n")],
                           "host")


@query("freshness_gaps", with_ctes(API_SQL, """
c AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, count(*) AS n FROM api GROUP BY 1),
dom AS (SELECT unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 5 MINUTE)) AS bucket_start
        FROM c)""") + """
SELECT dom.bucket_start, coalesce(c.n, 0) AS n FROM dom LEFT JOIN c ON c.bucket_start = dom.bucket_start""")
def freshness_gaps(spark, d):
    s = obs.time_series(api(spark, d), "ts", "5 minutes", [F.count(F.lit(1)).alias("n")])
    return obs.fill_gaps(s, "bucket_start", 300, ["n"], fill=0)


@query("since_last_value", with_ctes(API_SQL, NOW) + """
SELECT count(*) AS n_last_15m,
       arg_max(duration, (ts, event_id)) AS latest_duration, arg_max(name, (ts, event_id)) AS latest_name
FROM api, now_t WHERE ts >= now - INTERVAL 15 MINUTE""")
def since_last_value(spark, d):
    a = obs.with_now(api(spark, d), "ts").where(obs.since("ts", 15))
    order = F.struct("ts", "event_id")
    return a.agg(F.count(F.lit(1)).alias("n_last_15m"), F.max_by("duration", order).alias("latest_duration"),
                 F.max_by("name", order).alias("latest_name"))
