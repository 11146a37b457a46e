"""Dashboard algebra over event tables: counts with relative time windows,
latest value per facet, facet top-N, unique counts, rates, exact
percentiles, Apdex, tumbling time series with gap filling.

"Now" for a relative window is the table's latest timestamp (a scalar
subquery evaluated once), which keeps batch results reproducible; a
streaming job uses the watermark instead.  Percentiles use the distributed
exact quantile kernel, never a per-group value buffer.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ordered import _cols, exact_quantiles, scalar

APDEX_T = 0.5


def with_now(df: DataFrame, ts: str, name: str = "_now") -> DataFrame:
    """Attach the latest timestamp as a column (scalar subquery, evaluated once)."""
    return df.withColumn(name, scalar(df, F.max(ts)))


def since(ts: str, minutes: float, now: str = "_now") -> Column:
    """``ts >= now − minutes`` (relative time filter)."""
    return F.col(ts) >= F.col(now) - F.make_dt_interval(secs=F.lit(float(minutes) * 60.0))


def latest_by(df: DataFrame, facets: Sequence[str] | str | None, ts: str, values: Sequence[str],
              tiebreak: str | None = None, prefix: str = "latest_") -> DataFrame:
    """Value(s) at the greatest (ts, tiebreak) per facet — ``max_by`` with
    partial aggregation, so a hot facet is pre-reduced on every executor."""
    g = _cols(facets)
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    agg = df.groupBy(*g).agg(F.max_by(F.struct(*[F.col(v).alias(v) for v in values], F.col(ts).alias("_ts")),
                                      order).alias("_l"))
    return agg.select(*g, *[F.col(f"_l.{v}").alias(f"{prefix}{v}") for v in values],
                      F.col("_l._ts").alias(f"{prefix}{ts}"))


def top_n(agg: DataFrame, metric: str, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """First ``n`` rows by metric desc, then tiebreak columns asc (distributed top-k)."""
    return agg.orderBy(F.col(metric).desc_nulls_last(), *[F.col(c).asc() for c in tiebreak]).limit(n)


def percentiles(df: DataFrame, value: str, probs: Sequence[float], group_cols=None,
                names: Sequence[str] | None = None) -> DataFrame:
    """Exact percentiles as columns (``p50`` style names by default)."""
    g = _cols(group_cols)
    names = list(names or [f"p{int(round(q * 100))}" for q in probs])
    q = exact_quantiles(df, value, probs, g)
    return q.groupBy(*g).agg(*[F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(nm)
                               for p, nm in zip(probs, names)])


def apdex(duration: str, t: float = APDEX_T) -> Column:
    """(satisfied d <= t + tolerated t < d <= 4t / 2) / n as an aggregate."""
    d = F.col(duration)
    sat = F.count_if(d <= F.lit(t))
    tol = F.count_if((d > F.lit(t)) & (d <= F.lit(4 * t)))
    return (sat + tol / 2.0) / F.count(F.lit(1))


def range_minutes(df: DataFrame, ts: str) -> Column:
    """Minutes between the first and last timestamp (scalar subquery)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return scalar(df, (F.max(us) - F.min(us)) / 60e6)


def bucket(ts: str, interval: str) -> Column:
    """Start of the tumbling window containing ``ts`` (epoch aligned)."""
    return F.window(F.col(ts), interval).start


def time_series(df: DataFrame, ts: str, interval: str, aggs: Sequence[Column],
                facets: Sequence[str] | str | None = None, name: str = "bucket_start") -> DataFrame:
    """Tumbling-window aggregate per (bucket, facet…)."""
    g = _cols(facets)
    return df.groupBy(bucket(ts, interval).alias(name), *g).agg(*aggs)


def fill_gaps(series: DataFrame, bucket_col: str, step_seconds: int, value_cols: Sequence[str],
              fill=0) -> DataFrame:
    """Left-join a generated bucket domain (min..max by step) so empty buckets
    appear with ``fill``.  The span is one two-value result; the domain is a
    distributed ``range`` (its size is span / step, not the data size)."""
    us = F.unix_micros(F.col(bucket_col).cast("timestamp"))
    lo, hi = series.agg(F.min(us), F.max(us)).first()
    if lo is None:
        return series.select(bucket_col, *value_cols)
    step = int(step_seconds) * 1_000_000
    n = (hi - lo) // step + 1
    ts_type = series.schema[bucket_col].dataType.simpleString()
    dom = series.sparkSession.range(n).select(
        F.timestamp_micros(F.lit(lo) + F.col("id") * F.lit(step)).cast(ts_type).alias(bucket_col))
    j = dom.join(series, bucket_col, "left")
    return j.select(bucket_col, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in value_cols])
