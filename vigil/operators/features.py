"""Feature preparation shared by training and scoring: label derivation,
leakage guard, reference period, tenure with an imputation chain, numeric
clipping/imputation, categorical normalisation and training statistics.

Statistics (medians) come from the distributed exact quantile kernel as
one-row DataFrames and are attached with a broadcast cross join, so the same
plan serves a batch of any size without driver round trips.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.clean import clean_code, clip, keyword_classify, null_words, to_number
from vigil.operators.ordered import exact_median, scalar

# fixed values of the reference configuration
DEFAULT_AGE = 12
AGE_RANGE = (4, 25)
TENURE_RANGE = (0, 30)
PRIOR_RANGE = (0, 10)
INDEX_RISK_BELOW = 6.0
TIER_MARKER = "QUARTZO"


def derive_label(df: DataFrame, gap: str | None = "gap", index: str | None = "index",
                 tier: str | None = "tier", out: str = "label") -> DataFrame:
    """Binary label by column priority (chosen from the schema):
    gap < 0 -> 1 (unparsable/null -> 0); else index < 6.0 -> 1 (unparsable
    -> 0); else tier text contains the marker (case-insensitive); else error."""
    if gap and gap in df.columns:
        lab = F.coalesce(to_number(F.col(gap)) < 0, F.lit(False))
    elif index and index in df.columns:
        lab = F.coalesce(to_number(F.col(index)) < INDEX_RISK_BELOW, F.lit(False))
    elif tier and tier in df.columns:
        lab = F.coalesce(F.contains(F.upper(F.col(tier).cast("string")), F.lit(TIER_MARKER)), F.lit(False))
    else:
        raise ValueError("no label source column present")
    return df.withColumn(out, lab.cast("int"))


def drop_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the listed columns that exist (leakage guard)."""
    return df.drop(*[c for c in cols if c in df.columns])


def add_missing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Missing numeric columns -> 0, missing categorical columns -> ``"N/A"``."""
    add = {c: F.lit(0) for c in numeric if c not in df.columns}
    add.update({c: F.lit("N/A") for c in categorical if c not in df.columns})
    return df.withColumns(add) if add else df


def reference_period(df: DataFrame, period: str | None, snapshot_year: int | None = None) -> Column:
    """Reference period column if present, else the snapshot year, else error."""
    if period and period in df.columns:
        return to_number(F.col(period))
    if snapshot_year is None:
        raise ValueError("no reference period column and no snapshot year")
    return F.lit(float(snapshot_year))


def train_statistics(train: DataFrame, start: str, age: str, ref_period: str | None = None) -> DataFrame:
    """One row ``median_start, median_age`` (ints, floor of the exact median).
    Start falls back to the median reference period; age falls back to 12.
    The three medians come from one run of the distributed quantile kernel."""
    cols = {"s": to_number(F.col(start)), "a": to_number(F.col(age)),
            "r": to_number(F.col(ref_period)) if ref_period else F.lit(None).cast("double")}
    long = train.select(*[c.alias(k) for k, c in cols.items()]).unpivot([], list(cols), "_k", "_v")
    med = exact_median(long, "_v", "_k", small_groups=True)
    m = med.agg(*[F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"_m{k}") for k in cols])
    one = train.sparkSession.range(1).select(F.lit(1).alias("_one"))
    j = one.join(m.withColumn("_one", F.lit(1)), "_one", "left")
    return j.select(F.floor(F.coalesce("_ms", "_mr")).cast("int").alias("median_start"),
                    F.coalesce(F.floor("_ma").cast("int"), F.lit(DEFAULT_AGE)).alias("median_age"))


def with_tenure(df: DataFrame, start: str | None, ref: Column, stats: DataFrame | None = None,
                out: str = "tenure", compat_zero_fill: bool = False) -> DataFrame:
    """tenure = reference period − start period, floored at 0.

    Null start periods are imputed by the training median (``stats``), else
    the batch median, else the median reference period.  ``compat_zero_fill``
    reproduces the reference order (contract fills null with 0 before
    imputation, so tenure becomes the reference year, later clipped)."""
    if not start or start not in df.columns:
        return df.withColumn(out, F.lit(0.0))
    s = to_number(F.col(start))
    d = df.withColumn("_ref", ref).withColumn("_start", s)
    if compat_zero_fill:
        filled = F.coalesce(F.col("_start"), F.lit(0.0))
    elif stats is not None:
        filled = F.coalesce(F.col("_start"), scalar(stats, F.col("median_start").cast("double")))
    else:
        bm = scalar(exact_median(d, "_start"), F.max("value"))
        rm = scalar(exact_median(d, "_ref"), F.max("value"))
        filled = F.coalesce(F.col("_start"), bm, F.floor(rm))
    d = d.withColumn(out, F.greatest(F.col("_ref") - filled, F.lit(0.0)))
    return d.drop("_ref", "_start", "_bm", "_rm", "_tm")


def normalise_numeric(df: DataFrame, age: str | None = None, tenure: str | None = None,
                      priors: Sequence[str] = (), flag: str | None = None, others: Sequence[str] = (),
                      stats: DataFrame | None = None) -> DataFrame:
    """Age outside [4, 25] -> training median (else 12) then clip; tenure
    null -> 0, clip [0, 30]; priors null -> 0, clip [0, 10]; flag null -> 0,
    int, clip [0, 1]; other numerics null -> 0."""
    d = df
    if age and age in d.columns:
        a = to_number(F.col(age))
        a = F.when(a.between(*AGE_RANGE), a)
        if stats is not None:
            default = F.coalesce(scalar(stats, F.max("median_age")).cast("double"), F.lit(float(DEFAULT_AGE)))
        else:
            default = F.lit(float(DEFAULT_AGE))
        d = d.withColumn(age, clip(F.coalesce(a, default), float(AGE_RANGE[0]), float(AGE_RANGE[1])))
    cols: dict[str, Column] = {}
    if tenure and tenure in d.columns:
        cols[tenure] = clip(F.coalesce(to_number(F.col(tenure)), F.lit(0.0)), *map(float, TENURE_RANGE))
    for c in priors:
        if c in d.columns:
            cols[c] = clip(F.coalesce(to_number(F.col(c)), F.lit(0.0)), *map(float, PRIOR_RANGE))
    if flag and flag in d.columns:
        cols[flag] = clip(F.coalesce(to_number(F.col(flag)), F.lit(0.0)).cast("int"), 0, 1)
    for c in others:
        if c in d.columns:
            cols[c] = F.coalesce(to_number(F.col(c)), F.lit(0.0))
    return d.withColumns(cols) if cols else d


def normalise_categorical(df: DataFrame, group: str | None = None, code: str | None = None,
                          others: Sequence[str] = ()) -> DataFrame:
    """Group text -> keyword class; code -> cleaned code; others -> null words as N/A."""
    cols: dict[str, Column] = {}
    if group and group in df.columns:
        cols[group] = keyword_classify(F.col(group))
    if code and code in df.columns:
        cols[code] = clean_code(F.col(code))
    for c in others:
        if c in df.columns:
            cols[c] = null_words(F.col(c))
    return df.withColumns(cols) if cols else df


def process_features(df: DataFrame, spec: Mapping, stats: DataFrame | None = None,
                     snapshot_year: int | None = None) -> DataFrame:
    """The shared feature pipeline (reference period -> tenure -> missing
    columns -> projection -> numeric -> categorical), same at training and
    scoring.  ``spec`` keys: period, start, age, tenure, priors, flag,
    group, code, categorical, keep."""
    ref = reference_period(df, spec.get("period"), snapshot_year)
    d = with_tenure(df, spec.get("start"), ref, stats, out=spec.get("tenure", "tenure"))
    numeric = [spec.get("age"), spec.get("tenure", "tenure"), *spec.get("priors", []), spec.get("flag")]
    numeric = [c for c in numeric if c]
    categorical = [c for c in [spec.get("group"), spec.get("code"), *spec.get("categorical", [])] if c]
    d = add_missing(d, numeric, categorical)
    d = d.select(*spec.get("keep", []), *numeric, *categorical)
    d = normalise_numeric(d, spec.get("age"), spec.get("tenure", "tenure"), spec.get("priors", []),
                          spec.get("flag"), stats=stats)
    return normalise_categorical(d, spec.get("group"), spec.get("code"), spec.get("categorical", []))
