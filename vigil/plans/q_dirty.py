"""Cleaning, coercion and contract queries on the ``dirty`` binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import clean
from vigil.operators import contract
from vigil.plans.bindings import DIRTY_SQL, dirty, with_ctes
from vigil.plans.registry import query

_NUM_RE = clean.NUMERIC_PATTERN.replace("'", "''")


def sql_num(x: str) -> str:
    """SQL twin of ``clean.to_number``."""
    return (f"(CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{_NUM_RE}') "
            f"THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END)")


def sql_contains_any(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def sql_classify(x: str, strict: bool = False) -> str:
    t = f"lower(trim(CAST({x} AS VARCHAR)))"
    fw, mw = ((clean.FEMALE_WORDS_STRICT, clean.MALE_WORDS_STRICT) if strict
              else (clean.FEMALE_WORDS, clean.MALE_WORDS))
    return (f"(CASE WHEN {t} IS NULL THEN 'Outro' WHEN {sql_contains_any(t, fw)} THEN 'Feminino' "
            f"WHEN {sql_contains_any(t, mw)} THEN 'Masculino' ELSE 'Outro' END)")


def sql_clean_code(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(upper(CAST({x} AS VARCHAR)), '[^A-Z0-9]', '', 'g'), ''), '0')"


def sql_extract_code(x: str) -> str:
    t = f"upper(trim(CAST({x} AS VARCHAR)))"
    return (f"(CASE WHEN {t} IS NULL THEN '0' WHEN regexp_full_match({t}, '[0-9A-Z]+') THEN {t} "
            f"ELSE coalesce(nullif(regexp_extract({t}, '\\b(ALFA)\\b', 1), ''), "
            f"nullif(regexp_extract({t}, '\\b([0-9]{{1,2}}[A-Z])\\b', 1), ''), "
            f"nullif(regexp_extract({t}, '\\b([0-9]{{1,2}})\\b', 1), ''), {sql_clean_code(t)}) END)")


def sql_null_words(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR lower({x}) IN ('nan', 'nat', 'none') THEN 'N/A' ELSE {x} END)"


def sql_int_or_null(x: str) -> str:
    v = sql_num(x)
    return f"(CASE WHEN {v} IS NOT NULL AND abs({v}) < 1e9 THEN CAST(trunc({v}) AS INTEGER) END)"


def sql_year(x: str) -> str:
    y = sql_int_or_null(x)
    return f"(CASE WHEN {y} BETWEEN 2000 AND 2026 THEN {y} END)"


def sql_age(x: str, ref: str) -> str:
    v = sql_num(x)
    base = f"coalesce({ref}, 2024)"
    ok = f"({x} IS NOT NULL AND {x} <> '' AND {v} IS NOT NULL)"
    fd = f"({base} - year(TRY_STRPTIME(trim({x}), '%Y-%m-%d')))"
    return (f"(CASE WHEN {ok} AND {v} BETWEEN 4 AND 25 THEN CAST(floor({v}) AS INTEGER) "
            f"WHEN {ok} AND {v} > 1900 AND ({base} - {v}) BETWEEN 4 AND 25 THEN CAST(floor({base} - {v}) AS INTEGER) "
            f"WHEN {fd} BETWEEN 4 AND 25 THEN CAST({fd} AS INTEGER) END)")


@query("coerce_numeric", with_ctes(DIRTY_SQL) + f"""
SELECT id, raw_num, coalesce({sql_num('raw_num')}, 0.0) AS num,
       raw_num IS NOT NULL AND {sql_num('raw_num')} IS NULL AS was_coerced FROM dirty""")
def coerce_numeric(spark, d):
    df = dirty(spark, d)
    out = contract.coerce_types(df.withColumn("num", F.col("raw_num")), {"num": "double"}, fill=0.0)
    return out.select("id", "raw_num", "num",
                      (F.col("raw_num").isNotNull() & clean.to_number("raw_num").isNull()).alias("was_coerced"))


LOSS_COLS = ["raw_num", "age_raw", "ref_year_raw"]


@query("coercion_loss_report", with_ctes(DIRTY_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS n_rows, count({c}) AS n_non_null, "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND {sql_num(c)} IS NULL) AS n_lost FROM dirty" for c in LOSS_COLS))
def coercion_loss_report(spark, d):
    return contract.coercion_loss_report(dirty(spark, d), LOSS_COLS)


@query("normalise_key", with_ctes(DIRTY_SQL) + """
SELECT id, regexp_replace(trim(CAST(raw_key AS VARCHAR)), '\\.0$', '') AS key FROM dirty""")
def normalise_key(spark, d):
    return dirty(spark, d).select("id", clean.normalise_key("raw_key").alias("key"))


@query("keyword_classify", with_ctes(DIRTY_SQL) + f"""
SELECT id, {sql_classify('raw_gender')} AS grp, {sql_classify('raw_gender', True)} AS grp_strict FROM dirty""")
def keyword_classify(spark, d):
    return dirty(spark, d).select("id", clean.keyword_classify("raw_gender").alias("grp"),
                                  clean.keyword_classify("raw_gender", strict=True).alias("grp_strict"))


@query("clean_code", with_ctes(DIRTY_SQL) + f"""
SELECT id, {sql_clean_code('raw_code')} AS code, {sql_extract_code('raw_code')} AS code_extracted,
       {sql_null_words('cat_raw')} AS category FROM dirty""")
def clean_code(spark, d):
    return dirty(spark, d).select("id", clean.clean_code("raw_code").alias("code"),
                                  clean.extract_code("raw_code").alias("code_extracted"),
                                  clean.null_words("cat_raw").alias("category"))


@query("coalesce_alias", with_ctes(DIRTY_SQL) + """
SELECT id, coalesce(alias_a, alias_b, alias_c) AS value FROM dirty""")
def coalesce_alias(spark, d):
    df = dirty(spark, d)
    return df.select("id", clean.first_present(df, ["alias_a", "alias_b", "alias_missing", "alias_c"]).alias("value"))


@query("age_from_mixed", with_ctes(DIRTY_SQL, f"""
x AS (SELECT id, {sql_int_or_null('ref_year_raw')} AS ref_year, age_raw, raw_gender, raw_code FROM dirty)""") + f"""
SELECT id, {sql_age('age_raw', 'ref_year')} AS age, ref_year, {sql_year('age_raw')} AS start_year,
       {sql_classify('raw_gender', True)} AS grp, {sql_null_words('raw_code')} AS phase
FROM x WHERE {sql_age('age_raw', 'ref_year')} IS NOT NULL""")
def age_from_mixed(spark, d):
    df = (dirty(spark, d).withColumn("ref_year", clean.int_or_null("ref_year_raw"))
          .withColumn("_num", clean.to_number("age_raw")))
    out = df.select("id", clean.age_from_mixed("age_raw", "ref_year", number="_num").alias("age"), "ref_year",
                    clean.year_parse("age_raw").alias("start_year"),
                    clean.keyword_classify("raw_gender", strict=True).alias("grp"),
                    clean.null_words("raw_code").alias("phase"))
    return out.where(F.col("age").isNotNull())


RULES_SQL = [
    ("key_empty", "length(key) >= 1"),
    ("age_out_of_range", "age BETWEEN 4 AND 25"),
    ("start_year_out_of_range", "start_year BETWEEN 2010 AND 2026"),
    ("group_not_allowed", "grp IN ('Masculino', 'Feminino', 'Outro')"),
    ("class_empty", "length(klass) >= 1"),
    ("institution_too_short", "length(institution) >= 3"),
    ("phase_empty", "length(phase) >= 1"),
    ("ref_year_out_of_range", "ref_year IS NULL OR ref_year BETWEEN 2010 AND 2030"),
    ("prior_index_out_of_range", "prior_index BETWEEN 0 AND 10"),
]


@query("row_validation", with_ctes(DIRTY_SQL, f"""
r AS (SELECT id, regexp_replace(trim(CAST(raw_key AS VARCHAR)), '\\.0$', '') AS key,
             {sql_age('age_raw', sql_int_or_null('ref_year_raw'))} AS age, {sql_year('age_raw')} AS start_year,
             trim(raw_gender) AS grp, cat_raw AS klass, name AS institution, raw_code AS phase,
             {sql_int_or_null('ref_year_raw')} AS ref_year, {sql_num('raw_num')} AS prior_index,
             coalesce(CASE WHEN id % 2 = 0 THEN {sql_num('raw_num')} END, 0.0) AS prior_engagement FROM dirty),
v AS (SELECT id, concat_ws(',', {', '.join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in RULES_SQL)})
             AS reasons, prior_engagement FROM r)""") + """
SELECT id, reasons = '' AS valid, reasons, CAST(prior_engagement AS DOUBLE) AS prior_engagement, 0.0 AS prior_mood, 0 AS is_new FROM v""")
def row_validation(spark, d):
    df = (dirty(spark, d).withColumn("ref_year", clean.int_or_null("ref_year_raw"))
          .withColumn("_num", clean.to_number("age_raw")))
    rec = df.select("id", clean.normalise_key("raw_key").alias("key"),
                    clean.age_from_mixed("age_raw", "ref_year", number="_num").alias("age"),
                    clean.year_parse("age_raw").alias("start_year"), F.trim("raw_gender").alias("group"),
                    F.col("cat_raw").alias("klass"), F.col("name").alias("institution"),
                    F.col("raw_code").alias("phase"), "ref_year",
                    clean.to_number("raw_num").alias("prior_index"),
                    F.when(F.col("id") % 2 == 0, clean.to_number("raw_num")).alias("prior_engagement"))
    rec = contract.request_defaults(rec, ["prior_engagement", "prior_mood"])
    tagged = rec.withColumn("reasons", contract.reasons(contract.request_rules()))
    return tagged.select("id", (F.size("reasons") == 0).alias("valid"),
                         F.array_join("reasons", ",").alias("reasons"), "prior_engagement", "prior_mood", "is_new")
