"""Population drift between a reference and a current DataFrame.

PSI is fitted on the reference once (like an MLlib estimator).  One scan makes
a (feature, value) count table by partial aggregation in the scan's own stage;
it is written once, and the exact decile edges, the share of every bin and the
means all come from it - a result bounded by features × (bins + 1), whatever
the data size.  Applying it to a current DataFrame (a batch, a group of snapshots or a
streaming micro-batch) is one scan: values are unpivoted to
``(feature, value)``, binned by a JVM-side expression against the literal
edges, and counted per (group, feature, bin) with map-side combine.  The bin
domain comes from the edges, so empty bins count as 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vigil.functions.clean import to_number
from vigil.functions.numeric import rnd
from vigil.operators.ordered import _cols, count_less, quantiles_of_counts, safe_div, same_groups
from vigil.session import written

# fixed values of the reference configuration
PSI_EPS = 1e-6
PSI_FLAG = 0.2
PSI_ALERT = 0.2
PSI_CRITICAL = 0.35
RATE_SHIFT_ALERT_PCT = 20.0
PSI_TOP_FEATURES = 5
STATUS_STABLE, STATUS_MODERATE, STATUS_CRITICAL = "stable", "moderate", "critical"


def as_number(df: DataFrame, name: str) -> Column:
    """A column as double: text that is no number and NaN become null."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, NumericType):
        d = c.cast("double")
        return F.when(~F.isnan(d), d) if kind.typeName() in ("float", "double") else d
    return to_number(c.cast("string"))


def to_long(df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = (), nulls: bool = False) -> DataFrame:
    """Wide -> ``group…, feature, v`` (double); values that are no number are
    dropped, or kept as null with ``nulls``."""
    g = list(group_cols)
    cast = df.select(*g, *[as_number(df, f).alias(f) for f in features])
    long = cast.unpivot(g, list(features), "feature", "v")
    return long if nulls else long.where(F.col("v").isNotNull())


def value_counts(df: DataFrame, features: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """``group…, feature, v, n``: how often each number occurs; null stands for values that are none.

    The rows x features exist only inside the scan's stage: the partial
    aggregate follows at once, and what is shuffled is one row per distinct
    value and task."""
    g = list(group_cols)
    return to_long(df, features, g, nulls=True).groupBy(*g, "feature", "v").agg(F.count(F.lit(1)).alias("n"))


def bin_index(v: Column, edges: Column, max_edges: int) -> Column:
    """Right-closed bin 1..m-1 for edges e0<…<e(m-1) (m <= ``max_edges``),
    lowest edge included; null when the value is outside [e0, e(m-1)]."""
    first, last = F.try_element_at(edges, F.lit(1)), F.try_element_at(edges, F.lit(-1))
    idx = F.greatest(F.lit(1), count_less(edges, v, n=max_edges))
    return F.when((v >= first) & (v <= last), idx)


@dataclass
class PsiReference:
    """The reference side of PSI, fitted once: per feature the distinct
    decile edges, the in-range share of every bin, the mean and counts.
    Its size is bounded by features × (bins + 1) whatever the data size."""
    features: list
    bins: int
    edges: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)
    mean: dict = field(default_factory=dict)
    n: dict = field(default_factory=dict)
    n_in: dict = field(default_factory=dict)

    def _map(self, values: dict, elem) -> Column:
        items = [x for f in self.features for x in (F.lit(f), elem(values.get(f)))]
        return F.create_map(*items) if items else F.create_map()

    def max_edges(self) -> int:
        return max([len(e) for e in self.edges.values()] or [0])

    def edges_col(self) -> Column:
        return self._map(self.edges, lambda e: F.array(*[F.lit(float(x)) for x in (e or [])]).cast("array<double>"))

    def shares_col(self) -> Column:
        return self._map(self.shares, lambda e: F.array(*[F.lit(float(x)) for x in (e or [])]).cast("array<double>"))


def psi_fit(ref: DataFrame, features: Sequence[str], bins: int = 10) -> PsiReference:
    """Fit the reference: one scan into value counts, which are written; the rest reads those."""
    return psi_fit_counts(written(value_counts(ref, features), "psi-counts"), features, bins)


def psi_fit_counts(counts: DataFrame, features: Sequence[str], bins: int = 10) -> PsiReference:
    """Fit from ``counts(feature, v, n)``.  A bin's share is the difference of the
    counts up to its edges, which the quantiles bring along: at most bins + 1
    rows a feature, and one row a feature of sums, reach the driver."""
    model = PsiReference(list(features), bins)
    known = counts.where(F.col("v").isNotNull())
    q = quantiles_of_counts(known, "v", "n", [k / bins for k in range(bins + 1)], "feature", small_groups=True)
    upto: dict = {}
    for r in q.collect():
        upto.setdefault(r["feature"], {})[float(r["value"])] = r["below"]
        model.n[r["feature"]] = r["total"]
    sums = {r["feature"]: r["s"] for r in known.groupBy("feature").agg(F.sum(F.col("v") * F.col("n")).alias("s")).collect()}
    for f in features:
        edges = sorted(upto.get(f, {}))
        model.edges[f] = edges
        model.n[f] = model.n_in[f] = model.n.get(f, 0)  # the first edge is the lowest value, the last the highest
        model.mean[f] = sums[f] / model.n[f] if model.n[f] else None
        ends = [upto[f][e] for e in edges[1:]]
        model.shares[f] = [(b - a) / model.n[f] for a, b in zip([0, *ends[:-1]], ends)]
    return model


def _bin_counts(model: PsiReference, cur: DataFrame, g: list[str], tails: bool, counted: bool) -> DataFrame:
    """``group…, feature, bin, n, s``: counts and sums per bin of rows, or of value counts."""
    # a feature without a number still has its row
    cl = cur.select(*g, "feature", "v", F.col("n").alias("_w")) if counted else to_long(cur, model.features, g, nulls=True).withColumn("_w", F.lit(1))
    edges = F.element_at(model.edges_col(), F.col("feature"))
    b = bin_index(F.col("v"), edges, model.max_edges())
    if tails:
        b = (F.when(F.col("v") < F.try_element_at(edges, F.lit(1)), F.lit(0))
             .when(F.col("v") > F.try_element_at(edges, F.lit(-1)), F.size(edges)).otherwise(b))
    known = F.when(F.col("v").isNotNull(), F.col("_w"))
    return (cl.withColumn("bin", b).groupBy(*g, "feature", "bin")
            .agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), F.sum(F.col("v") * F.col("_w")).alias("s")))


def psi_apply(model: PsiReference, cur: DataFrame, group_cols: Sequence[str] | str | None = None,
              tails: bool = False, counted: bool = False) -> DataFrame:
    """PSI of a current DataFrame (per optional group) against a fitted
    reference — one scan of ``cur`` and one aggregate; empty current bins
    still contribute (the bin domain comes from the reference edges).

    Output: ``group…, feature, psi_raw, n_edges, in_range_cur, n_cur,
    current_mean`` (psi_raw rounded to 6 dp; 0 with < 3 edges or an empty
    side; null when every current value is out of range).  With ``tails``
    out-of-range current values are kept in two extra bins (below / above,
    reference share 0) and proportions are over all values.  With ``counted``
    ``cur`` is a table of value counts (``group…, feature, v, n``)."""
    g = _cols(group_cols)
    return psi_of_bins(model, _bin_counts(model, cur, g, tails, counted), g, tails)


def psi_of_bins(model: PsiReference, agg: DataFrame, group_cols: Sequence[str] | str | None = None,
                tails: bool = False) -> DataFrame:
    """``psi_apply`` from bin counts ``group…, feature, bin, n, s`` - of a scan, or kept as a stream's state."""
    g = _cols(group_cols)
    tot = agg.groupBy(*g, "feature").agg(
        F.sum("n").alias("n_cur"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("c_in"),
        F.sum("s").alias("s_cur"))
    n_edges = F.size(F.element_at(model.edges_col(), F.col("feature")))
    if tails:
        tot = tot.withColumn("c_in", F.col("n_cur"))
        dom = tot.select(*g, "feature", "c_in", F.explode(F.sequence(F.lit(0), n_edges)).alias("bin"))
    else:
        dom = tot.select(*g, "feature", "c_in",
                         F.explode(F.sequence(F.lit(1), F.greatest(n_edges - 1, F.lit(1)))).alias("bin"))
        dom = dom.where(F.col("bin") < n_edges)
    j = same_groups(dom, agg.where(F.col("bin").isNotNull()).select(*g, "feature", "bin", "n"),
                    [*g, "feature", "bin"], "left")
    r = F.element_at(F.element_at(model.shares_col(), F.col("feature")), F.col("bin"))
    if tails:
        r = F.when((F.col("bin") == 0) | (F.col("bin") == n_edges), F.lit(0.0)).otherwise(r)
    c = F.coalesce(F.col("n"), F.lit(0)) / F.col("c_in")
    eps = F.lit(PSI_EPS)
    term = ((c + eps) - (r + eps)) * F.log((c + eps) / (r + eps))
    s = j.where(F.col("c_in") > 0).groupBy(*g, "feature").agg(F.sum(term).alias("_s"))
    out = same_groups(tot, s, [*g, "feature"], "left")
    n_ref = model._map(model.n, lambda x: F.lit(int(x or 0)).cast("long"))
    val = (F.when((F.element_at(n_ref, F.col("feature")) == 0) | (F.col("n_cur") == 0) | (n_edges < 3),
                  F.lit(0.0))
           .when(F.coalesce(F.col("c_in"), F.lit(0)) == 0, F.lit(None).cast("double"))
           .otherwise(rnd(F.col("_s"), 6)))
    return out.select(*g, "feature", val.alias("psi_raw"), n_edges.alias("n_edges"),
                      F.coalesce("c_in", F.lit(0)).alias("in_range_cur"), "n_cur",
                      F.when(F.col("n_cur") > 0, F.col("s_cur") / F.col("n_cur")).alias("current_mean"))


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10,
        group_cols: Sequence[str] | str | None = None, tails: bool = False) -> DataFrame:
    """PSI per feature (and per current-side group): fit on ``ref``, apply to ``cur``."""
    return psi_apply(psi_fit(ref, features, bins), cur, group_cols, tails=tails)


def psi_table(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10,
              group_cols: Sequence[str] | str | None = None, flag: float = PSI_FLAG,
              model: PsiReference | None = None, top: int | None = PSI_TOP_FEATURES, counted: bool = False) -> DataFrame:
    """PSI table: ``group…, feature, psi (4 dp), reference_mean, current_mean,
    delta_mean, direction, drift_flag, all_out_of_range`` for the first ``top``
    features (None: all) present on both sides."""
    g = _cols(group_cols)
    if model is None:
        model = psi_fit(ref, [f for f in features if f in ref.columns and f in cur.columns][:top], bins)
    return psi_report(model, psi_apply(model, cur, g, counted=counted), g, flag)


def psi_report(model: PsiReference, p: DataFrame, group_cols: Sequence[str] | str | None = None, flag: float = PSI_FLAG) -> DataFrame:
    """The PSI table's columns from ``psi_apply``'s."""
    g = _cols(group_cols)
    rm = F.element_at(model._map(model.mean, lambda x: F.lit(x).cast("double")), F.col("feature"))
    return p.select(
        *g, "feature",
        rnd("psi_raw", 4).alias("psi"),
        rnd(rm, 4).alias("reference_mean"),
        rnd("current_mean", 4).alias("current_mean"),
        rnd(F.col("current_mean") - rm, 4).alias("delta_mean"),
        F.when(F.col("current_mean") > rm, "increase").otherwise("decrease_or_stable").alias("direction"),
        F.coalesce(F.col("psi_raw") >= F.lit(flag), F.lit(False)).alias("drift_flag"),
        F.col("psi_raw").isNull().alias("all_out_of_range"))


def psi_distributions(model: PsiReference, cur: DataFrame, group_cols: Sequence[str] | str | None = None,
                      counted: bool = False) -> DataFrame:
    """The distributions behind the PSI: ``group…, feature, bin, lower, upper,
    reference_share, current_share, contribution`` (6 dp), one row per bin of
    each feature with at least 3 edges and numbers on both sides."""
    g = _cols(group_cols)
    agg = _bin_counts(model, cur, g, False, counted)
    in_range = F.col("bin").isNotNull()
    tot = agg.groupBy(*g, "feature").agg(F.sum(F.when(in_range, F.col("n"))).alias("c_in"))
    edges, shares = F.element_at(model.edges_col(), F.col("feature")), F.element_at(model.shares_col(), F.col("feature"))
    dom = (tot.where((F.size(edges) >= 3) & (F.col("c_in") > 0))
           .select(*g, "feature", "c_in", F.explode(F.sequence(F.lit(1), F.size(edges) - 1)).alias("bin")))
    j = same_groups(dom, agg.where(in_range).select(*g, "feature", "bin", "n"), [*g, "feature", "bin"], "left")
    c, r, eps = F.coalesce(F.col("n"), F.lit(0)) / F.col("c_in"), F.element_at(shares, F.col("bin")), F.lit(PSI_EPS)
    return j.select(*g, "feature", "bin", rnd(F.element_at(edges, F.col("bin")), 6).alias("lower"),
                    rnd(F.element_at(edges, F.col("bin") + 1), 6).alias("upper"), rnd(r, 6).alias("reference_share"),
                    rnd(c, 6).alias("current_share"), rnd(((c + eps) - (r + eps)) * F.log((c + eps) / (r + eps)), 6).alias("contribution"))


def psi_detail(model: PsiReference, cur: DataFrame, group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """``group…, feature, psi, reference_distribution, current_distribution,
    bins``: the shares and the edges as arrays (6 dp), empty where the PSI is 0
    for want of numbers or edges."""
    g = _cols(group_cols)
    d = psi_distributions(model, cur, g)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("bin", c))), lambda x: x[c]).alias(c)
    lists = d.groupBy(*g, "feature").agg(listed("reference_share"), listed("current_share"))
    none = F.array().cast("array<double>")
    edges = F.transform(F.element_at(model.edges_col(), F.col("feature")), lambda e: rnd(e, 6))
    out = same_groups(psi_apply(model, cur, g).select(*g, "feature", F.col("psi_raw").alias("psi"), "n_cur"), lists, [*g, "feature"], "left")
    return out.select(*g, "feature", "psi", F.coalesce("reference_share", none).alias("reference_distribution"),
                      F.coalesce("current_share", none).alias("current_distribution"), F.when(F.col("n_cur") > 0, edges).otherwise(none).alias("bins"))


def top_features(psi_tbl: DataFrame, n: int = PSI_TOP_FEATURES,
                 group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """Top-n features by PSI (desc, then feature name): ``group…, rank, feature, psi``."""
    g = _cols(group_cols)
    w = Window.partitionBy(*g).orderBy(F.col("psi").desc_nulls_last(), F.col("feature"))
    return (psi_tbl.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(*g, "rank", "feature", "psi"))


def positive_rate(df: DataFrame, prediction: str | None = "prediction",
                  segment: str | None = None, high_value: str = "high",
                  group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """Share of positive predictions × 100 (2 dp), null predictions as 0;
    with no prediction column the share of ``segment == high_value``; else 0."""
    g = _cols(group_cols)
    if prediction and prediction in df.columns:
        hit = (F.coalesce(as_number(df, prediction), F.lit(0.0)) == 1.0).cast("double")
    elif segment and segment in df.columns:
        hit = (F.col(segment).cast("string") == high_value).cast("double")
    else:
        hit = F.lit(0.0)
    return df.groupBy(*g).agg(rnd(F.coalesce(F.avg(hit), F.lit(0.0)) * 100.0, 2).alias("rate"))


def rate_shift_cols(ref_rate: Column, cur_rate: Column, alert_pct: float = RATE_SHIFT_ALERT_PCT) -> list[Column]:
    """delta (pp), relative change (%) and the alert flag from two rates."""
    change = (F.when(ref_rate > 0, rnd((cur_rate - ref_rate) / ref_rate * 100.0, 2))
              .when(cur_rate > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return [rnd(cur_rate - ref_rate, 2).alias("delta_pp"), change.alias("change_pct"),
            (F.abs(change) >= F.lit(alert_pct)).alias("shift_alert")]


def rate_shift(ref: DataFrame, cur: DataFrame, prediction: str = "prediction",
               alert_pct: float = RATE_SHIFT_ALERT_PCT) -> DataFrame:
    """One row: reference_rate, current_rate, delta_pp, change_pct, shift_alert."""
    r = positive_rate(ref, prediction).withColumnRenamed("rate", "reference_rate")
    c = positive_rate(cur, prediction).withColumnRenamed("rate", "current_rate")
    j = r.crossJoin(c)
    return j.select("reference_rate", "current_rate",
                    *rate_shift_cols(F.col("reference_rate"), F.col("current_rate"), alert_pct))


def missing_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null cells / (rows × columns), 6 dp; 0 for an empty frame.  One pass."""
    cols = list(columns or df.columns)
    def missing(c: str) -> Column:
        gone = F.col(c).isNull()
        return gone | F.isnan(F.col(c)) if df.schema[c].dataType.typeName() in ("float", "double") else gone

    nulls = sum((F.sum(F.coalesce(missing(c), F.lit(True)).cast("long")) for c in cols), F.lit(0))
    agg = df.agg(nulls.alias("_nulls"), F.count(F.lit(1)).alias("_rows"))
    cells = F.col("_rows") * F.lit(len(cols))
    return agg.select(rnd(safe_div(F.col("_nulls").cast("double"), cells.cast("double")), 6)
                      .alias("missing_ratio"))


def drift_status_col(avg_psi: Column, shift_alert: Column, flag: float = PSI_FLAG) -> Column:
    return (F.when((avg_psi >= F.lit(PSI_CRITICAL)) | shift_alert, F.lit(STATUS_CRITICAL))
            .when(avg_psi >= F.lit(max(flag, 0.2)), F.lit(STATUS_MODERATE))
            .otherwise(F.lit(STATUS_STABLE)))


def drift_summary(psi_tbl: DataFrame, group_cols: Sequence[str] | str | None = None) -> DataFrame:
    """``group…, avg_psi (4 dp), n_drifted`` from a PSI table."""
    g = _cols(group_cols)
    return psi_tbl.groupBy(*g).agg(
        rnd(F.coalesce(F.avg("psi"), F.lit(0.0)), 4).alias("avg_psi"),
        F.count_if(F.col("drift_flag")).alias("n_drifted"))


MIN_SAMPLES = 5


def guard_status(n_ref: Column, n_cur: Column, min_rows: int = MIN_SAMPLES) -> Column:
    """What keeps a snapshot from being taken, else ``updated``."""
    return (F.when(n_ref == 0, "reference_not_found").when(n_cur == 0, "empty_or_invalid_logs")
            .when(n_cur < min_rows, "insufficient_samples").otherwise("updated"))


def snapshot_status(spark: SparkSession, ref: DataFrame | None, cur: DataFrame | None, prediction: str = "prediction",
                    min_rows: int = MIN_SAMPLES) -> DataFrame:
    """One row (status, updated, samples) from sources that may be missing: None is a source that is not there.
    Rows without a prediction do not count."""
    lost = "reference_not_found" if ref is None else "logs_not_found" if cur is None else None
    if lost:
        return spark.range(1).select(F.lit(lost).alias("status"), F.lit(False).alias("updated"), F.lit(0).cast("long").alias("samples"))
    # the reference is only asked whether it has a row
    n_ref = ref.limit(1).agg(F.count(F.lit(1))).scalar()
    one = cur.agg(F.count(prediction).alias("samples")).withColumn("status", guard_status(n_ref, F.col("samples"), min_rows))
    return one.select("status", (F.col("status") == "updated").alias("updated"), "samples")


def snapshot_counts(rows: DataFrame, is_ref: str, features: Sequence[str], prediction: str = "prediction",
                    cells: Sequence[str] = (), time: str | None = None) -> DataFrame:
    """Everything a snapshot needs, in one scan: ``is_ref, feature, v, n, last``.

    Besides the features there are two that no column has: ``#positive`` (is the
    prediction 1) and ``#missing`` (how many of ``cells`` the row lacks).  Rows
    without a prediction are left out."""
    def missing(c: str) -> Column:
        gone = F.col(c).isNull()
        return (gone | F.isnan(F.col(c)) if rows.schema[c].dataType.typeName() in ("float", "double") else gone).cast("double")

    lacks = sum((missing(c) for c in cells), F.lit(0.0))
    wide = rows.where(F.col(prediction).isNotNull()).select(
        F.col(is_ref).alias("is_ref"), (F.col(time) if time else F.lit(None).cast("timestamp")).alias("at"),
        *[as_number(rows, f).alias(f) for f in features],
        F.coalesce(as_number(rows, prediction) == 1.0, F.lit(False)).cast("double").alias("#positive"), lacks.alias("#missing"))
    return (wide.unpivot(["is_ref", "at"], [*features, "#positive", "#missing"], "feature", "v")
            .groupBy("is_ref", "feature", "v").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")))


def snapshot(rows: DataFrame, is_ref: str, features: Sequence[str], prediction: str = "prediction", cells: Sequence[str] = (),
             time: str | None = None, bins: int = 10, top: int = PSI_TOP_FEATURES, min_rows: int = MIN_SAMPLES,
             alert_pct: float = RATE_SHIFT_ALERT_PCT) -> DataFrame:
    """The drift snapshot of the rows where ``is_ref`` is false against those where it is true: one row with the
    guard's status, sizes, rates, missing cells, PSI summary and the three top features.

    ``rows`` is scanned once, into ``snapshot_counts``; the rest reads those."""
    features = list(features)[:top]
    counts = written(snapshot_counts(rows, is_ref, features, prediction, cells, time), "snapshot-counts")
    own = counts.where(F.col("feature").isin(features))
    model = psi_fit_counts(own.where("is_ref"), features, bins)
    p = psi_report(model, psi_apply(model, own.where("not is_ref"), counted=True))
    tops = top_features(p, 3).agg(*[F.max(F.when(F.col("rank") == i, F.col("feature"))).alias(f"t{i}") for i in (1, 2, 3)])

    def total(feature: str, ref: bool, v: Column = F.lit(1.0)) -> Column:
        return F.coalesce(F.sum(F.when((F.col("feature") == feature) & (F.col("is_ref") == ref), v * F.col("n"))), F.lit(0.0))

    sizes = counts.agg(total("#positive", True).cast("long").alias("n_ref"), total("#positive", False).cast("long").alias("samples"),
                       total("#positive", True, F.col("v")).alias("pos_ref"), total("#positive", False, F.col("v")).alias("pos_cur"),
                       total("#missing", False, F.col("v")).alias("lacking"), F.max(F.when(~F.col("is_ref"), F.col("last"))).alias("window_ts"))
    rate = lambda hits, n: rnd(safe_div(F.col(hits), F.col(n).cast("double")) * 100.0, 2)
    sizes = sizes.withColumns({"reference_rate": rate("pos_ref", "n_ref"), "current_rate": rate("pos_cur", "samples"),
                               "missing_ratio": rnd(safe_div(F.col("lacking"), (F.col("samples") * max(1, len(cells))).cast("double")), 6),
                               "status": guard_status(F.col("n_ref"), F.col("samples"), min_rows)})
    j = drift_summary(p).crossJoin(tops).crossJoin(sizes)  # one row each
    j = j.select("*", *rate_shift_cols(F.col("reference_rate"), F.col("current_rate"), alert_pct))
    return j.select("status", (F.col("status") == "updated").alias("updated"), "samples", "avg_psi", "n_drifted", "reference_rate", "current_rate",
                    "delta_pp", "change_pct", "shift_alert", "missing_ratio", drift_status_col(F.col("avg_psi"), F.col("shift_alert")).alias("drift_status"),
                    "t1", "t2", "t3", "window_ts")


def drift_alerts(psi_tbl: DataFrame, threshold: float = PSI_ALERT) -> DataFrame:
    """Alert text for features with PSI >= threshold: ``feature, psi, message``."""
    msg = F.format_string("Feature %s with PSI=%.4f above the limit (direction: %s).",
                          F.col("feature"), F.col("psi"), F.coalesce(F.col("direction"), F.lit("n/a")))
    return psi_tbl.where(F.col("psi") >= F.lit(threshold)).select("feature", "psi", msg.alias("message"))
