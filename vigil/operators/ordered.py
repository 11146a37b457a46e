"""Order-dependent kernels that stay distributed.

A running sum over a global order written as ``sum() OVER (ORDER BY x)``
has no partition key and runs in a single task.  ``running_sums`` instead
cuts the order column into ranges of equal row counts (so a skewed value
distribution still spreads evenly), runs the window per (group, range) and adds
per-range offsets.  The number of ranges follows from the size of the input, so
that a range stays within ``ROWS_PER_BUCKET`` or so at any size.
``exact_quantiles`` and ``global_index`` are built on it, so exact medians,
deciles and ranks never gather a whole column into one aggregation buffer.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import Iterable, Mapping, Sequence

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import written

DEFAULT_BUCKETS = 1024
CUT_ACCURACY = 10_000  # percentile_approx accuracy for bucket cuts: ±n/10 000 rows per cut
ROWS_PER_BUCKET = 1_000_000  # target rows per (group, range) window task
RANGES_PER_BUCKET = 4  # where the rows are counted: smaller ranges, so that as many cores have one


def _cols(cols: Iterable[str] | str | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` with ``default`` when the denominator is 0 (ANSI-safe)."""
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def scalar(df: DataFrame, expr) -> Column:
    """A one-row aggregate over a *scan* as a scalar-subquery column:
    evaluated once and used as a literal by the consuming stage (no join).
    Inside kernels whose one-row input is itself a shuffled intermediate, a
    broadcast one-row join is used instead so that the intermediate's
    shuffle is shared (a subquery is planned separately and recomputes it)."""
    return df.select(expr).scalar()


def count_below(df: DataFrame, v: Column, cuts: str, n_cuts: int, out: str) -> DataFrame:
    """``out`` = number of entries of the sorted array column ``cuts`` (length
    at most ``n_cuts``) that are < ``v``: a binary search unrolled into
    ceil(log2(n_cuts + 1)) projections — codegen'd, no lambda, O(log n) per row."""
    step = 1
    while step * 2 <= n_cuts:
        step *= 2
    df = df.withColumn(out, F.lit(0))
    while step >= 1:
        cand = F.col(out) + F.lit(step)
        df = df.withColumn(out, F.when(F.try_element_at(F.col(cuts), cand) < v, cand).otherwise(F.col(out)))
        step //= 2
    return df


def count_less(cuts, v: Column, inclusive: bool = False, n: int | None = None) -> Column:
    """Number of entries of a sorted array that are < ``v`` (<= with
    ``inclusive``): an unrolled sum of comparisons, codegen'd — a
    ``size(filter(arr, lambda))`` would be evaluated interpreted on every row.
    ``cuts`` is a literal list, or an array column of at most ``n`` entries
    (missing entries count 0)."""
    def below(e: Column) -> Column:
        return (e <= v) if inclusive else (e < v)

    if isinstance(cuts, (list, tuple)):
        terms = [below(F.lit(float(e))).cast("int") for e in cuts]
    else:
        terms = [F.coalesce(below(F.try_element_at(cuts, F.lit(k))).cast("int"), F.lit(0))
                 for k in range(1, (n or 0) + 1)]
    return reduce(operator.add, terms) if terms else F.lit(0)


def ranges_for(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many ranges a group of ``df`` needs so that one holds about
    ``rows_per_bucket`` rows, from an upper bound of its bytes: the tables that it
    reads, or the optimizer's estimate where that is lower (its estimate of a join
    is the product of both sides).  One where everything fits into a few of them,
    ``DEFAULT_BUCKETS`` where the size is not known (the cut points are then
    thinned by the real counts)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    size = min(int(plan.stats().sizeInBytes()), read)
    if size >= 1 << 60:
        return DEFAULT_BUCKETS
    n = -(-size // (2 * rows_per_bucket))  # a distinct number takes two bytes at least
    return 1 if n <= 4 else max(DEFAULT_BUCKETS, n)


def assign_ranges(df: DataFrame, order: Column, g: list[str], nb: int, rows_per_bucket: int, small_groups: bool) -> DataFrame:
    """``df`` with ``_b``: the range that a row's order value falls into, ascending within its group.

    Up to ``DEFAULT_BUCKETS`` ranges come from approximate quantiles of each
    group.  More are Spark's own range partitions of (group, order): any number
    of them, each of about ``rows_per_bucket`` rows, so that neither a range nor
    the table of ranges (one row per group and partition) grows with the data of
    one task.  They are written, as a range must not move when a task is repeated."""
    if nb <= 1:
        return df.withColumn("_b", F.lit(0))
    if nb > DEFAULT_BUCKETS:
        return range_partitions(df, order, g, nb)
    cuts = cut_points(df, order, g, nb, rows_per_bucket)
    if not g:
        b = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    elif small_groups:
        key = F.struct(*[F.col(c) for c in g])
        lookup = cuts.agg(F.map_from_entries(F.collect_list(F.struct(key, F.col("_cuts"))))).scalar()
        b = df.withColumn("_cuts", F.try_element_at(lookup, key))
    else:
        b = same_groups(df, cuts, g)
    return count_below(b, order, "_cuts", nb - 1, "_b").drop("_cuts")


def range_partitions(df: DataFrame, order: Column, g: list[str], nb: int) -> DataFrame:
    """``df`` with ``_b``, the number of its range partition of (group, order); written, as a range must not move."""
    if nb <= 1:
        return df.withColumn("_b", F.lit(0))
    return written(df.repartitionByRange(nb, *[F.col(c) for c in g], order).withColumn("_b", F.spark_partition_id()), "ranges")


def cut_points(df: DataFrame, order: Column, group_cols: list[str], buckets: int,
               rows_per_bucket: int) -> DataFrame:
    """Per group: sorted cut points splitting the rows into
    ``min(buckets, ceil(n / rows_per_bucket))`` ranges of about equal size
    (approximate quantiles, one sketch aggregate; ``buckets - 1`` values at
    most per group)."""
    nb = buckets
    per = df.groupBy(*group_cols).agg(
        F.count(order).alias("_n"),
        # one array literal (a list would become nb separate literal expressions, slow to analyse)
        F.percentile_approx(order, F.lit(np.arange(1, nb) / nb), CUT_ACCURACY).alias("_all"))
    k_g = F.least(F.lit(nb), F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_bucket)).cast("int")))
    thin = F.when(k_g > 1, F.transform(
        F.sequence(F.lit(1), k_g - 1),
        lambda k: F.element_at(F.col("_all"), F.floor(k * F.lit(nb) / k_g).cast("int"))))
    return per.select(*group_cols, F.coalesce(thin, F.array().cast("array<double>")).alias("_cuts"))


def same_groups(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, null being equal to null; ``left``'s columns are kept."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    on = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in cols])


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                 group_cols: Sequence[str] | str | None = None,
                 descending: bool = False, buckets: int | None = None,
                 small_groups: bool = False, suffix: str = "_cum", totals: bool = False,
                 index: str | None = None, count: str | None = None,
                 lead_cols: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
                 extremes: Mapping[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over all rows of the same group whose
    order value is <= (or >= when ``descending``) the row's value, ties
    included (RANGE frame).  Optional outputs from the same pass:
    ``totals`` -> ``<c>_tot`` (group total); ``index`` -> 0-based position in
    the scan order; ``count`` -> rows in the group; ``lead_cols`` ->
    ``<c>_next``, the next row's value (null on the last row); ``extremes`` ->
    name: (column, ``max`` or ``min``, ``upto`` or ``after``), the extreme over the
    rows up to and including the row, or over those after it (null on the last
    row).  ``index``, ``lead_cols`` and ``extremes`` assume distinct order values
    per group (pre-aggregate).

    Plan: each group's order values are cut into ranges of about
    ``rows_per_bucket`` rows (``assign_ranges``; ``buckets`` of them, by default as
    many as the size asks for), so a skewed value distribution still spreads
    evenly.  Where the bound of the size asks for many (``DEFAULT_BUCKETS``), the
    table is written and its rows are counted: it is computed once, and the plan
    neither holds a thousand cut points nor grows with what came before.  A window partitioned by (group, range) does the work; a window over
    the per-range totals gives each range its offset, joined back.
    """
    g = _cols(group_cols)
    o = F.col(order_col).cast("double")
    nb = max(1, int(buckets)) if buckets is not None else ranges_for(df, rows_per_bucket)
    if nb >= DEFAULT_BUCKETS:
        df = written(df, "ordered")
        nb = max(1, -(-df.count() * RANGES_PER_BUCKET // rows_per_bucket))
        b = range_partitions(df, o, g, nb)
    else:
        b = assign_ranges(df, o, g, nb, rows_per_bucket, small_groups)
    if descending:
        b = b.withColumn("_b", F.lit(nb - 1) - F.col("_b"))

    ordering = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*g, "_b").orderBy(ordering)
    w_in = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    extra = [F.sum(c).over(w_in).alias(f"_{c}_in") for c in sum_cols]
    if index:
        extra.append(F.row_number().over(w).alias("_rn"))
    if lead_cols:
        extra.append(F.lead(F.struct(*lead_cols)).over(w).alias("_lead"))
    # what comes after a row is what came before it the other way round: a frame that ends at the partition's end
    # would be folded anew for every row
    back = Window.partitionBy(*g, "_b").orderBy(F.col(order_col).asc() if descending else F.col(order_col).desc())
    reach = {"upto": w.rowsBetween(Window.unboundedPreceding, 0), "after": back.rowsBetween(Window.unboundedPreceding, -1)}
    fold = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    extremes = dict(extremes or {})
    extra += [fold[how][0](c).over(reach[side]).alias(f"_{name}_in") for name, (c, how, side) in extremes.items()]
    b = b.select("*", *extra)

    aggs = [F.sum(c).alias(f"_{c}_bt") for c in sum_cols]
    if index or count:
        aggs.append(F.count(F.lit(1)).alias("_n_bt"))
    if lead_cols:
        first = F.max_by if descending else F.min_by
        aggs.append(first(F.struct(*lead_cols), F.col(order_col)).alias("_first"))
    aggs += [fold[how][0](c).alias(f"_{name}_bt") for name, (c, how, _) in extremes.items()]
    aggs = aggs or [F.count(F.lit(1)).alias("_n_bt")]
    per = b.groupBy(*g, "_b").agg(*aggs)
    w_b = Window.partitionBy(*g).orderBy("_b")
    w_prev = w_b.rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g)
    sel = [F.coalesce(F.sum(f"_{c}_bt").over(w_prev), F.lit(0)).alias(f"_{c}_off") for c in sum_cols]
    if totals:
        sel += [F.sum(f"_{c}_bt").over(w_all).alias(f"{c}_tot") for c in sum_cols]
    if index:
        sel.append(F.coalesce(F.sum("_n_bt").over(w_prev), F.lit(0)).alias("_n_off"))
    if count:
        sel.append(F.sum("_n_bt").over(w_all).alias(count))
    if lead_cols:
        sel.append(F.lead("_first").over(w_b).alias("_next_first"))
    w_back = Window.partitionBy(*g).orderBy(F.col("_b").desc())
    beyond = {"upto": w_prev, "after": w_back.rowsBetween(Window.unboundedPreceding, -1)}
    sel += [fold[how][0](f"_{name}_bt").over(beyond[side]).alias(f"_{name}_off") for name, (_, how, side) in extremes.items()]
    offsets = per.select(*g, "_b", *sel)

    out = same_groups(b, F.broadcast(offsets) if small_groups else offsets, [*g, "_b"])
    new = [(F.col(f"_{c}_in") + F.col(f"_{c}_off")).alias(f"{c}{suffix}") for c in sum_cols]
    if totals:
        new += [F.col(f"{c}_tot") for c in sum_cols]
    if index:
        new.append((F.col("_rn") - 1 + F.col("_n_off")).alias(index))
    if count:
        new.append(F.col(count))
    if lead_cols:
        nxt = F.coalesce(F.col("_lead"), F.col("_next_first"))
        new += [nxt[c].alias(f"{c}_next") for c in lead_cols]
    new += [fold[how][1](f"_{name}_in", f"_{name}_off").alias(name) for name, (_, how, _) in extremes.items()]
    return out.select(*[F.col(c) for c in df.columns], *new)  # one projection drops the helpers


def global_index(df: DataFrame, order_col: str, group_cols: Sequence[str] | str | None = None,
                 descending: bool = False, buckets: int | None = None,
                 name: str = "_idx") -> DataFrame:
    """0-based position of each row in (group, order) — rows must have distinct
    order values within a group (pre-aggregate first)."""
    return running_sums(df, order_col, [], group_cols, descending=descending, buckets=buckets, index=name)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] | str | None = None,
                    buckets: int | None = None, small_groups: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles, equal to SQL ``percentile`` to the
    last bit.  Null values are ignored; a null group is a group.  Output:
    ``group…, q, value``.

    One plan at every size: value counts -> distributed running counts
    (bucketed) -> pick the order statistics around ``(n-1)·q`` -> interpolate;
    no buffer grows with the data.
    """
    g = _cols(group_cols)
    v = F.col(value_col).cast("double")
    vc = (df.select(*g, v.alias("_v")).where(F.col("_v").isNotNull())
          .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")))
    return quantiles_of_counts(vc, "_v", "_c", probs, g, buckets, small_groups).select(*g, "q", "value")


def quantiles_of_counts(counts: DataFrame, value_col: str, count_col: str, probs: Sequence[float],
                        group_cols: Sequence[str] | str | None = None,
                        buckets: int | None = None, small_groups: bool = False) -> DataFrame:
    """``exact_quantiles`` of a value count table (distinct non-null values per
    group).  Output: ``group…, q, value, below, total`` - ``below`` counts the
    rows whose value is at most the quantile, ``total`` the group's rows."""
    g = _cols(group_cols)
    vc = counts.select(*g, F.col(value_col).alias("_v"), F.col(count_col).alias("_c"))
    vc = running_sums(vc, "_v", ["_c"], g, buckets=buckets, small_groups=small_groups, totals=True)
    vc = vc.withColumn("_end", F.col("_c_cum") - 1).withColumn("_start", F.col("_c_cum") - F.col("_c"))

    # order-statistic positions around (n-1)·q from the group total on every row (no join); the
    # probabilities are unrolled into codegen'd columns (no per-row lambda), and only the few rows whose
    # position range holds a wanted order statistic are expanded
    def holds(pos: Column) -> Column:
        return (pos >= F.col("_start")) & (pos <= F.col("_end"))

    entries, any_hit = [], None
    for q in probs:
        h = (F.col("_c_tot") - 1).cast("double") * F.lit(float(q))
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        hit = holds(lo) | holds(hi)
        entries.append(F.when(hit, F.struct(F.lit(float(q)).alias("q"), h.alias("h"), lo.alias("lo"),
                                            hi.alias("hi"))))
        any_hit = hit if any_hit is None else any_hit | hit
    hits = (vc.where(any_hit).select(*g, "_v", F.explode(F.array(*entries)).alias("p"), "_start", "_end", "_c_tot")
            .where(F.col("p").isNotNull()))
    in_lo = (F.col("p.lo") >= F.col("_start")) & (F.col("p.lo") <= F.col("_end"))
    in_hi = (F.col("p.hi") >= F.col("_start")) & (F.col("p.hi") <= F.col("_end"))
    agg = hits.groupBy(*g, F.col("p.q").alias("q")).agg(
        F.first("p.h").alias("h"), F.first("p.lo").alias("lo"), F.first("p.hi").alias("hi"),
        F.max(F.when(in_lo, F.col("_v"))).alias("v_lo"),
        F.max(F.when(in_hi, F.col("_v"))).alias("v_hi"),
        F.max(F.when(in_lo, F.col("_start"))).alias("c_none"),
        F.max(F.when(in_lo, F.col("_end") + 1)).alias("c_lo"),
        F.max(F.when(in_hi, F.col("_end") + 1)).alias("c_hi"), F.first("_c_tot").alias("total"))
    val = (F.col("hi") - F.col("h")) * F.col("v_lo") + (F.col("h") - F.col("lo")) * F.col("v_hi")
    out = agg.withColumn("value", F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(val))
    # an interpolated value lies between its two order statistics, up to rounding
    below = (F.when(F.col("value") >= F.col("v_hi"), F.col("c_hi"))
             .when(F.col("value") >= F.col("v_lo"), F.col("c_lo")).otherwise(F.col("c_none")))
    return out.select(*g, "q", "value", below.alias("below"), "total")


def exact_median(df: DataFrame, value_col: str,
                 group_cols: Sequence[str] | str | None = None, small_groups: bool = False) -> DataFrame:
    """Exact median per group (``group…, value``)."""
    return exact_quantiles(df, value_col, [0.5], group_cols, small_groups=small_groups).drop("q")
