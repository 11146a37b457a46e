"""Panel operators: previous-period features, last row per key, strict as-of
lookup with cold start, temporal splits and expanding-window folds.

Scale notes
- ``lag_features`` uses one window spec for every column (one shuffle by key).
  A panel has one row per (key, period), so a window partition is bounded by
  the number of periods.
- ``asof_prior`` merges requests and history into one time line in ranges, linear
  in both whatever one key has of either.
- folds are intervals of periods: what adds up comes from prefix sums over the
  periods (``fold_sums``); only ``expanding_folds`` copies rows, for callers that
  need the folds' rows themselves.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vigil.operators.ordered import global_index, running_sums, scalar
from vigil.session import written


def lag_features(df: DataFrame, key: str, order: str, cols: Sequence[str], fill: float = 0.0,
                 suffix: str = "_prev", new_col: str | None = "is_new", compat_new_from: str | None = None,
                 tiebreak: str | None = None) -> DataFrame:
    """Previous *row* per key (gaps between periods are skipped) for ``cols``,
    null -> ``fill``.  ``new_col`` = 1 for the first row of a key; with
    ``compat_new_from=c`` it is 1 when the lagged ``c`` equals 0 (the
    reference's rule, which also flags real zero priors).  Rows of equal order
    stand by ``tiebreak``, by default by ``cols``.  Key or order column absent
    -> unchanged."""
    if key not in df.columns or order not in df.columns:
        return df
    ordering = [F.col(order)] + ([F.col(tiebreak)] if tiebreak else _tiebreak(df, [c for c in cols if c in df.columns]))
    w = Window.partitionBy(key).orderBy(*ordering)
    out = df.withColumns({f"{c}{suffix}": F.coalesce(F.lag(c, 1).over(w).cast("double"), F.lit(float(fill)))
                          for c in cols if c in df.columns})
    if new_col:
        if compat_new_from:
            src = f"{compat_new_from}{suffix}"
            flag = (F.col(src) == 0).cast("int") if src in out.columns else F.lit(1)
        else:
            flag = (F.row_number().over(w) == 1).cast("int")
        out = out.withColumn(new_col, flag)
    return out


def _tiebreak(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Columns that can be ordered, to decide between rows of equal order: the
    same row wins on every run and partitioning."""
    simple = ("array", "map", "struct", "variant")
    return [F.col(c) for c in cols if df.schema[c].dataType.typeName() not in simple]


def last_row_per_key(df: DataFrame, key: str, order: str, cols: Sequence[str] | None = None,
                     tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Row with the greatest ``order`` per key (``max_by`` — partial aggregation,
    so a hot key is combined on every executor before the shuffle).  Rows of
    equal order: the greatest by ``tiebreak``, by default by the kept columns."""
    keep = [c for c in (cols or df.columns) if c not in (key,)]
    rank = F.struct(F.col(order).alias("_o"), *[c.alias(f"_t{i}") for i, c in enumerate(_tiebreak(df, tiebreak or keep))])
    return (df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in keep]), rank).alias("_r"))
            .select(key, "_r.*"))


def history_cells(panel: DataFrame, key: str, period: str, cols: Sequence[str],
                  tiebreak: Sequence[str] | None = None) -> DataFrame:
    """One row per (key, period): ``_key, _period, _m`` (a struct of ``cols``)."""
    keep = [c for c in cols if c != period]
    rank = _tiebreak(panel, tiebreak or keep)
    return (panel.where(F.col(period).isNotNull() & F.col(key).isNotNull())
            .groupBy(F.col(key).alias("_key"), F.col(period).alias("_period"))
            .agg(F.max_by(F.struct(*[F.col(c) for c in keep]), F.struct(*rank) if rank else F.lit(1)).alias("_m")))


def _as_double(c: Column, dtype) -> Column:
    """Numeric columns cast directly; text parsed strictly (bad -> null)."""
    from pyspark.sql.types import NumericType
    if isinstance(dtype, NumericType):
        return F.when(~F.isnan(c.cast("double")), c.cast("double"))
    from vigil.functions.clean import to_number
    return to_number(c)


def asof_prior(requests: DataFrame, panel: DataFrame, key: str, req_period: str, panel_period: str,
               cols: Sequence[str], prefix: str = "prior_", fill: float = 0.0,
               new_col: str = "is_new", tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Strict as-of lookup with cold start (D1 + D2).

    For each request: the panel row of the same key with the greatest period
    strictly before the request period (request period null -> the last row
    overall).  Each metric is parsed to double, unparsable/null -> ``fill``.
    Found -> ``is_new = 0``; no earlier row or unknown key -> zeros and
    ``is_new = 1``.  Requests keep their own columns, duplicates survive.

    Requests and history cells are merged into one time line, cut into ranges of
    (key, time) by Spark's range partitioning, so that one key's requests may
    spread over any number of tasks.  Within a range the last cell is carried
    along; what a range's first key brings with it is the last cell of the ranges
    before, at most one row a range.  Work is linear in requests and cells, however
    many of either one key has.
    """
    cells = history_cells(panel, key, panel_period, cols, tiebreak)
    rp, kind = F.col(req_period), cells.schema["_period"].dataType
    seen, ask = F.struct("_period", "_m"), F.struct(*[F.col(c) for c in requests.columns])
    asked = requests.where(F.col(key).isNotNull())
    none = cells.select(seen.alias("c")).schema["c"].dataType
    wish = requests.select(ask.alias("r")).schema["r"].dataType
    # at one time requests come before cells: the lookup is strict; without a time they come last
    line = asked.select(F.col(key).alias("_key"), rp.isNull().alias("_late"), rp.cast(kind).alias("_t"), F.lit(0).alias("_is_cell"),
                        ask.alias("_req"), F.lit(None).cast(none).alias("_cell")).unionByName(
        cells.select("_key", F.lit(False).alias("_late"), F.col("_period").alias("_t"), F.lit(1).alias("_is_cell"),
                     F.lit(None).cast(wish).alias("_req"), seen.alias("_cell")))
    by = ["_key", "_late", "_t", "_is_cell"]
    line = written(line.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "time-line")
    so_far = Window.partitionBy("_key", "_range").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    opening = (line.groupBy("_key", "_range").agg(F.max_by("_cell", F.when(F.col("_is_cell") == 1, F.col("_t"))).alias("_last"))
               .select(F.col("_key").alias("_o_key"), F.col("_range").alias("_o_range"), F.last("_last", ignorenulls=True).over(before).alias("_open"))
               .where(F.col("_open").isNotNull()))  # of a range's first key only
    found = (line.withColumn("_in", F.last("_cell", ignorenulls=True).over(so_far)).where(F.col("_is_cell") == 0)
             .join(F.broadcast(opening), (F.col("_key") == F.col("_o_key")) & (F.col("_range") == F.col("_o_range")), "left")
             .select("_req.*", F.coalesce("_in", "_open").alias("_cell")))
    lost = requests.where(F.col(key).isNull()).withColumn("_cell", F.lit(None).cast(none))
    j = found.unionByName(lost).withColumns({"_period": F.col("_cell._period"), "_m": F.col("_cell._m")})
    out = j.withColumns({
        f"{prefix}period": F.col("_period"),
        **{f"{prefix}{c}": F.coalesce(_as_double(F.col(f"_m.{c}"), panel.schema[c].dataType), F.lit(float(fill)))
           for c in cols if c != panel_period},
        new_col: F.col("_period").isNull().cast("int"),
    })
    return out.drop("_cell", "_period", "_m")


def max_period(df: DataFrame, period: str) -> DataFrame:
    return df.agg(F.max(period).alias("_max_period"))


def temporal_split(df: DataFrame, period: str, role: str = "role") -> DataFrame:
    """Last period -> ``test``, earlier -> ``train`` (a filter on a broadcast
    scalar, no materialisation)."""
    m = scalar(df, F.max(period))
    return df.withColumn(role, F.when(F.col(period) == m, F.lit("test")).otherwise(F.lit("train")))


def period_index(df: DataFrame, period: str) -> DataFrame:
    """Distinct sorted periods with a 1-based position (one row per period)."""
    p = df.where(F.col(period).isNotNull()).select(period).distinct()
    if isinstance(p.schema[period].dataType, NumericType):
        return global_index(p, period, name="_pi").withColumn("_pi", (F.col("_pi") + 1).cast("int"))
    return p.withColumn("_pi", F.row_number().over(Window.orderBy(period)))


def fold_bounds(df: DataFrame, period: str, min_periods: int = 2) -> DataFrame:
    """``fold_integrity`` of the expanding folds from the distinct periods alone: fold i trains up to the i-th and
    validates on the next, so no row is copied into a fold to learn this."""
    return (fold_table(df, period).select(F.col("fold").cast("int").alias("fold"), F.col("train_max"), F.col("val_period").alias("val_min"))
            .withColumn("no_leakage", F.col("train_max") < F.col("val_min")).where(F.col("fold") >= min_periods - 1))


def fold_sums(df: DataFrame, period: str, sums: Mapping[str, Column]) -> DataFrame:
    """``fold, train_max, val_period, train_<name>…, val_<name>…``: sums over the training and the validation rows of each
    expanding fold, from one aggregate per period and prefix sums over the periods.  For whatever adds up: counts,
    sums, sums of squares, confusion cells."""
    per = df.where(F.col(period).isNotNull()).groupBy(period).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    idx = period_index(df, period).withColumnRenamed(period, "_p")
    per = per.join(idx, F.col(period) == F.col("_p")).select(F.col(period).alias("train_max"), "_pi", *sums)
    run = running_sums(per, "_pi", list(sums))
    nxt = per.select((F.col("_pi") - 1).alias("_n"), F.col("train_max").alias("val_period"), *[F.col(n).alias(f"val_{n}") for n in sums])
    return run.join(nxt, F.col("_pi") == F.col("_n")).select(F.col("_pi").cast("int").alias("fold"), "train_max", "val_period",
                                                             *[F.col(f"{n}_cum").alias(f"train_{n}") for n in sums], *[f"val_{n}" for n in sums])


def fold_report(df: DataFrame, period: str, entity: str) -> DataFrame:
    """``fold, role, n_rows, n_entities, min_period, max_period`` of the expanding folds.  An entity is new to the
    training rows once, in its first period, so distinct entities add up as well."""
    seen = df.where(F.col(period).isNotNull()).groupBy(entity, period).agg(F.count(F.lit(1)).alias("_n"))
    first = F.col(period) == F.min(period).over(Window.partitionBy(entity))  # a row per period of the entity
    known = F.col(entity).isNotNull()
    seen = seen.withColumn("_new", (first & known).cast("long"))
    s = fold_sums(seen, period, {"rows": F.col("_n"), "new": F.col("_new"), "here": known.cast("long")})
    lowest = scalar(df, F.min(period))
    roles = F.array(F.struct(F.lit("train").alias("role"), F.col("train_rows").alias("n_rows"), F.col("train_new").alias("n_entities"),
                             lowest.alias("min_period"), F.col("train_max").alias("max_period")),
                    F.struct(F.lit("validation").alias("role"), F.col("val_rows").alias("n_rows"), F.col("val_here").alias("n_entities"),
                             F.col("val_period").alias("min_period"), F.col("val_period").alias("max_period")))
    return s.select("fold", F.explode(roles).alias("_r")).select("fold", "_r.*")


def validation_rows(df: DataFrame, period: str) -> DataFrame:
    """``df`` with ``fold``, the only one that a row validates (rows of the first period validate none)."""
    idx = period_index(df, period).withColumnRenamed(period, "_p")
    return (df.join(idx, F.col(period) == F.col("_p")).where("_pi >= 2").withColumn("fold", (F.col("_pi") - 1).cast("int")).drop("_p", "_pi"))


def expanding_folds(df: DataFrame, period: str, min_periods: int = 2) -> DataFrame:
    """Expanding-window folds as one long DataFrame with ``fold, role``.

    With periods p1 < … < pk, fold i (1..k−1) trains on p1..pi and validates
    on p(i+1).  Each row is emitted once per fold it belongs to: a row of
    period pj trains folds j..k−1 and validates fold j−1 — an equi-join on the
    period index plus an explode, no theta join.  For counts and statistics of folds
    use ``fold_sums``, for their bounds ``fold_bounds``, for scores on validation
    rows ``validation_rows``: none of them copies rows.
    """
    idx = period_index(df, period)
    j = df.join(idx, period).withColumn("_k", scalar(idx, F.max("_pi")))
    folds = F.sequence(F.lit(1), F.greatest(F.col("_k") - 1, F.lit(1)))
    roles = F.transform(folds, lambda f: F.struct(
        f.alias("fold"),
        F.when(f >= F.col("_pi"), F.lit("train"))
         .when(f == F.col("_pi") - 1, F.lit("validation")).alias("role")))
    roles = F.filter(roles, lambda s: s["role"].isNotNull() & (F.col("_k") >= min_periods))
    return j.withColumn("_fr", F.explode(roles)).select(*df.columns, "_fr.fold", "_fr.role")


def fold_table(df: DataFrame, period: str) -> DataFrame:
    """``fold, train_max, val_period`` (one row per fold)."""
    idx = period_index(df, period)
    nxt = idx.select((F.col("_pi") - 1).alias("fold"), F.col(period).alias("val_period"))
    return (idx.withColumnRenamed("_pi", "fold").withColumnRenamed(period, "train_max")
            .join(nxt, "fold"))


def fold_integrity(folds: DataFrame, period: str) -> DataFrame:
    """Per fold: latest training period, earliest validation period and
    whether every training period precedes every validation period."""
    agg = folds.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col(period))).alias("train_max"),
        F.min(F.when(F.col("role") == "validation", F.col(period))).alias("val_min"))
    return agg.withColumn("no_leakage", F.coalesce(F.col("train_max") < F.col("val_min"), F.lit(False)))


def latest_period_rows(df: DataFrame, period: str, lo: int = 2000, hi: int = 2026) -> DataFrame:
    """Keep rows of the latest *valid* period (an integer year in [lo, hi]);
    when no period is valid nothing is filtered."""
    valid = F.when(F.col(period).cast("string").try_cast("int").between(lo, hi),
                   F.col(period).cast("string").try_cast("int"))
    latest = scalar(df, F.max(valid))
    return df.where(latest.isNull() | (valid == latest))
