"""Stand-in datasets derived from the driver's tables.

The test tables hold orders and events, not entities scored over time, so
each operator family runs on a binding.  Every binding is written twice:
as a DataFrame (used by the queries) and as a SQL CTE (used by the DuckDB
oracle).  Both read the same parquet tables, so their size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.numeric import rnd
from vigil.operators.ordered import scalar
from vigil.sources.tables import read_table

LOG_SPLIT_TS = "2024-01-16 00:00:00"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# --------------------------------------------------------------------------- panel
def panel(spark: SparkSession, d: str) -> DataFrame:
    """Entity × period panel: one row per (customer, order year).

    Orders are aggregated to (custkey, year) first (partial aggregation), then
    joined with the customer attributes — the join sees one row per panel
    cell instead of one per order.
    """
    o = _t(spark, d, "orders")
    c = _t(spark, d, "customer")
    cells = (o.groupBy(F.col("o_custkey").alias("entity_id"),
                       F.year("o_orderdate").alias("period"))
             .agg(rnd(F.avg("o_totalprice") / 50000.0, 4).alias("idx"),
                  F.count(F.lit(1)).alias("act")))
    attrs = c.select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_mktsegment").alias("grp"),
        F.col("c_acctbal").alias("bal"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(1988) + F.col("c_custkey") % 9).cast("int")).alias("start_period"),
        F.col("c_nationkey").cast("int").alias("age"))
    return cells.join(attrs, "entity_id")


PANEL_SQL = """
panel AS (
  SELECT o.entity_id, o.period, o.idx, o.act,
         c.c_mktsegment AS grp, c.c_acctbal AS bal,
         CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE CAST(1988 + c.c_custkey % 9 AS INTEGER) END AS start_period,
         CAST(c.c_nationkey AS INTEGER) AS age
  FROM (SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS period,
               round(avg(o_totalprice) / 50000.0, 4) AS idx, count(*) AS act
        FROM orders GROUP BY 1, 2) o
  JOIN customer c ON c.c_custkey = o.entity_id
)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Scoring requests: every order asks for its customer's history before
    the order year."""
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("entity_id"),
                    F.year("o_orderdate").alias("period"))


REQUESTS_SQL = """
requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS period
  FROM orders
)"""


# --------------------------------------------------------------------------- scored
def scored(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scored rows: p = price / 500 000, an informative label."""
    o = _t(spark, d, "orders")
    p = F.col("o_totalprice") / 500000.0
    y = ((p + ((F.col("o_orderkey") % 100) - 50) / 250.0) > 0.5).cast("int")
    return o.select(F.col("o_orderkey").alias("id"), p.alias("p"), y.alias("y"),
                    F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"),
                    F.year("o_orderdate").alias("period"), F.col("o_custkey").alias("cust"))


SCORED_SQL = """
scored AS (
  SELECT o_orderkey AS id, o_totalprice / 500000.0 AS p,
         CAST((o_totalprice / 500000.0 + ((o_orderkey % 100) - 50) / 250.0) > 0.5 AS INTEGER) AS y,
         o_orderpriority AS grp, o_orderstatus AS status,
         CAST(year(o_orderdate) AS INTEGER) AS period, o_custkey AS cust
  FROM orders
)"""


def scored_ties(spark: SparkSession, d: str) -> DataFrame:
    """Line items: 11 distinct scores, heavy ties."""
    li = _t(spark, d, "lineitem")
    return li.select((F.abs("l_discount") * 10.0).alias("p"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     F.col("l_linestatus").alias("grp"))


SCORED_TIES_SQL = """
scored_ties AS (
  SELECT abs(l_discount) * 10.0 AS p, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_linestatus AS grp
  FROM lineitem
)"""


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: quality label, length-based score."""
    lab = _t(spark, d, "labels")
    doc = _t(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("y"),
        F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"), F.col("lang").alias("grp"))


SCORED_LABELS_SQL = """
scored_labels AS (
  SELECT l.doc_id, l.quality AS y, least(d.n_chars / 20000.0, 1.0) AS p, d.lang AS grp
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


# --------------------------------------------------------------------------- log
def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a prediction log: features value, k (from the JSON props) and
    user id; prediction = error event; ``is_ref`` splits reference/current."""
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", "ts", "event_type", "user_id", "value", "props",
                    k.alias("k"), F.col("user_id").cast("double").alias("uid"),
                    (F.col("event_type") == "error").cast("int").alias("prediction"),
                    (F.col("ts") < F.lit(LOG_SPLIT_TS).cast("timestamp_ntz")).alias("is_ref"))


LOG_FEATURES = ["value", "k", "uid"]

LOG_SQL = f"""
log AS (
  SELECT event_id, ts, event_type, user_id, value, props,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(user_id AS DOUBLE) AS uid,
         CAST(event_type = 'error' AS INTEGER) AS prediction,
         ts < TIMESTAMP '{LOG_SPLIT_TS}' AS is_ref
  FROM events
)"""


def versions_scored(spark: SparkSession, d: str) -> DataFrame:
    """Registry of the scored rows: two versions, each with the mean score of the years before it as its threshold."""
    s = scored(spark, d)
    first, last = scalar(s, F.min("period") + 2), scalar(s, F.max("period") - 1)
    mean = lambda y: rnd(F.avg(F.when(F.col("period") < y, F.col("p"))), 4)
    one = s.agg(mean(first).alias("t1"), mean(last).alias("t2")).select(first.alias("y1"), last.alias("y2"), "t1", "t2")
    rows = F.array(*[F.struct(F.col(f"y{i}").alias("valid_from"), F.col(f"t{i}").alias("risk_threshold")) for i in (1, 2)])
    return one.select(F.explode(rows).alias("r")).select(F.concat(F.lit("v"), F.col("r.valid_from").cast("string")).alias("version"), "r.*").distinct()


VERSIONS_SCORED_SQL = """
versions AS (
  SELECT 'v' || CAST(since AS VARCHAR) AS version, since AS valid_from, (SELECT round(avg(p), 4) FROM scored WHERE period < since) AS risk_threshold
  FROM (SELECT min(period) + 2 AS since FROM scored UNION SELECT max(period) - 1 FROM scored)),
held AS (SELECT *, lead(valid_from) OVER (ORDER BY valid_from) AS valid_to FROM versions)"""


def versions_log(spark: SparkSession, d: str) -> DataFrame:
    """Registry of the log: a version from its first row on, another from the first row of the current part on."""
    lg = log(spark, d)
    one = lg.agg(F.min("ts").alias("a"), F.min(F.when(~F.col("is_ref"), F.col("ts"))).alias("b"))
    return (one.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("valid_from")).where("valid_from is not null")
            .select(F.concat(F.lit("v"), F.date_format("valid_from", "yyyy.MM.dd")).alias("version"), "valid_from"))


VERSIONS_LOG_SQL = """
versions AS (
  SELECT 'v' || strftime(valid_from, '%Y.%m.%d') AS version, valid_from
  FROM (SELECT min(ts) AS valid_from FROM log UNION SELECT min(ts) FROM log WHERE NOT is_ref) WHERE valid_from IS NOT NULL)"""


# --------------------------------------------------------------------------- api
def api(spark: SparkSession, d: str) -> DataFrame:
    """Events as service requests: duration, endpoint name, host, error flag."""
    e = _t(spark, d, "events")
    return e.select("event_id", "ts", F.col("value").alias("duration"), F.col("event_type").alias("name"),
                    (F.col("user_id") % 10).alias("host"), "user_id",
                    (F.col("event_type") == "error").alias("error"))


API_SQL = """
api AS (
  SELECT event_id, ts, value AS duration, event_type AS name, user_id % 10 AS host, user_id,
         event_type = 'error' AS error
  FROM events
)"""


# --------------------------------------------------------------------------- dirty
def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Messy text columns built deterministically from customer rows, feeding
    the cleaning, coercion and validation operators."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    bal = F.col("c_acctbal").cast("string")
    raw_num = (F.when(k % 6 == 0, bal).when(k % 6 == 1, F.concat(bal, F.lit("d")))
               .when(k % 6 == 2, F.lit("abc")).when(k % 6 == 3, F.lit(None).cast("string"))
               .when(k % 6 == 4, F.lit(" 12.5 ")).otherwise(F.col("c_nationkey").cast("string")))
    raw_key = (F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0")))
               .when(k % 3 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
               .otherwise(k.cast("string")))
    raw_gender = (F.when(k % 8 == 0, F.lit("Feminino")).when(k % 8 == 1, F.lit("menino"))
                  .when(k % 8 == 2, F.lit("nao informado")).when(k % 8 == 3, F.lit(None).cast("string"))
                  .when(k % 8 == 4, F.lit(" M ")).when(k % 8 == 5, F.lit("homem"))
                  .when(k % 8 == 6, F.lit("garota")).otherwise(F.lit("xyz")))
    raw_code = (F.when(k % 7 == 0, F.lit("fase 2b")).when(k % 7 == 1, F.lit("ALFA"))
                .when(k % 7 == 2, F.lit("Fase-1C")).when(k % 7 == 3, F.lit(" 7 "))
                .when(k % 7 == 4, F.lit(None).cast("string")).when(k % 7 == 5, F.lit("--"))
                .otherwise(F.col("c_mktsegment")))
    alias_a = F.when(k % 4 == 0, F.col("c_name"))
    alias_b = F.when(k % 4 <= 1, F.col("c_mktsegment"))
    alias_c = F.col("c_nationkey").cast("string")
    age_raw = (F.when(k % 5 == 0, (F.col("c_nationkey") + 3).cast("string"))
               .when(k % 5 == 1, (F.lit(2000) + F.col("c_nationkey")).cast("string"))
               .when(k % 5 == 2, F.concat(F.lit("20"), F.lpad((F.col("c_nationkey") % 10).cast("string"), 2, "0"),
                                          F.lit("-05-17")))
               .when(k % 5 == 3, F.lit("unknown")).otherwise((F.col("c_nationkey") + 30).cast("string")))
    ref_year = F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(
        (F.lit(2019) + k % 6).cast("string"))
    null_word = (F.when(k % 5 == 0, F.lit("nan")).when(k % 5 == 1, F.lit("None"))
                 .when(k % 5 == 2, F.lit("NaT")).otherwise(F.col("c_mktsegment")))
    return c.select(k.alias("id"), raw_num.alias("raw_num"), raw_key.alias("raw_key"),
                    raw_gender.alias("raw_gender"), raw_code.alias("raw_code"),
                    alias_a.alias("alias_a"), alias_b.alias("alias_b"), alias_c.alias("alias_c"),
                    age_raw.alias("age_raw"), ref_year.alias("ref_year_raw"),
                    null_word.alias("cat_raw"), F.col("c_name").alias("name"),
                    F.col("c_nationkey").alias("nation"))


DIRTY_SQL = """
dirty AS (
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 6 = 0 THEN CAST(c_acctbal AS VARCHAR)
         WHEN c_custkey % 6 = 1 THEN CAST(c_acctbal AS VARCHAR) || 'd'
         WHEN c_custkey % 6 = 2 THEN 'abc'
         WHEN c_custkey % 6 = 3 THEN NULL
         WHEN c_custkey % 6 = 4 THEN ' 12.5 '
         ELSE CAST(c_nationkey AS VARCHAR) END AS raw_num,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) || '.0'
         WHEN c_custkey % 3 = 1 THEN ' ' || CAST(c_custkey AS VARCHAR) || ' '
         ELSE CAST(c_custkey AS VARCHAR) END AS raw_key,
    CASE c_custkey % 8 WHEN 0 THEN 'Feminino' WHEN 1 THEN 'menino' WHEN 2 THEN 'nao informado'
         WHEN 3 THEN NULL WHEN 4 THEN ' M ' WHEN 5 THEN 'homem' WHEN 6 THEN 'garota' ELSE 'xyz' END AS raw_gender,
    CASE c_custkey % 7 WHEN 0 THEN 'fase 2b' WHEN 1 THEN 'ALFA' WHEN 2 THEN 'Fase-1C' WHEN 3 THEN ' 7 '
         WHEN 4 THEN NULL WHEN 5 THEN '--' ELSE c_mktsegment END AS raw_code,
    CASE WHEN c_custkey % 4 = 0 THEN c_name END AS alias_a,
    CASE WHEN c_custkey % 4 <= 1 THEN c_mktsegment END AS alias_b,
    CAST(c_nationkey AS VARCHAR) AS alias_c,
    CASE c_custkey % 5 WHEN 0 THEN CAST(c_nationkey + 3 AS VARCHAR)
         WHEN 1 THEN CAST(2000 + c_nationkey AS VARCHAR)
         WHEN 2 THEN '20' || lpad(CAST(c_nationkey % 10 AS VARCHAR), 2, '0') || '-05-17'
         WHEN 3 THEN 'unknown'
         ELSE CAST(c_nationkey + 30 AS VARCHAR) END AS age_raw,
    CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(2019 + c_custkey % 6 AS VARCHAR) END AS ref_year_raw,
    CASE c_custkey % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' WHEN 2 THEN 'NaT' ELSE c_mktsegment END AS cat_raw,
    c_name AS name, c_nationkey AS nation
  FROM customer
)"""


def with_ctes(*ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for an oracle query."""
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"
