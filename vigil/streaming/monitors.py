"""Structured Streaming twins of the batch monitors.

The event log is read with ``readStream`` (explicit schema), event time is
the ``ts`` column cast to TIMESTAMP (watermarks reject TIMESTAMP_NTZ), and a
10-minute watermark bounds the state.  Tumbling-window aggregates run in
append mode (a window is emitted once the watermark passes it) or, by
``run_latest``, in update mode with each window's last state kept.  The
windowed drift monitor keeps bin counts per event-time window as its state; the
per-batch one re-uses the batch snapshot inside ``foreachBatch`` and appends one
history row per micro-batch — the throttle of the reference becomes a
processing-time trigger.  Sinks are parquet folders under the shared
checkpoint location (exactly-once file sink / idempotent batch writes).
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from vigil.functions.numeric import rnd
from vigil.operators import drift
from vigil.session import checkpoint_dir
from vigil.sources.tables import as_instant

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
WATERMARK = "10 minutes"
SNAPSHOT_SECONDS = 300


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream with event time ``ts`` (TIMESTAMP) and a watermark."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    s = r.parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
    return s.withColumn("ts", as_instant("ts")).withWatermark("ts", WATERMARK)


def run_to_parquet(df: DataFrame, name: str, mode: str = "append", available_now: bool = True,
                   processing_seconds: int | None = None) -> tuple[StreamingQuery, str]:
    """Start a streaming query into a fresh parquet folder; with
    ``available_now`` it processes what is there and stops."""
    spark = df.sparkSession
    base = _run_dir(spark, name)
    w = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{processing_seconds} seconds")
    return w.start(), f"{base}/data"


def run_foreach_batch(df: DataFrame, name: str, fn: Callable[[DataFrame, int], None], mode: str = "update",
                      available_now: bool = True, processing_seconds: int = SNAPSHOT_SECONDS) -> StreamingQuery:
    spark = df.sparkSession
    base = _run_dir(spark, name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint").foreachBatch(fn)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{processing_seconds} seconds")
    return w.start()


def run_latest(df: DataFrame, name: str, keys: list[str], available_now: bool = True,
               processing_seconds: int | None = None) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Start a query in update mode: every micro-batch writes the rows it changed
    under its own ``batch_id=`` folder (a replayed batch rewrites its own), and
    the returned reader gives each key's last row — open windows included, with
    the state still bounded by the watermark."""
    spark = df.sparkSession
    out = _run_dir(spark, f"{name}_out")

    def sink(batch: DataFrame, bid: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={bid}")

    q = run_foreach_batch(df, name, sink, mode="update", available_now=available_now,
                          processing_seconds=processing_seconds or SNAPSHOT_SECONDS)

    def read() -> DataFrame:
        every = spark.read.schema(StructType([*df.schema.fields, StructField("batch_id", LongType())])).parquet(out)
        kept = [c for c in df.columns if c not in keys]
        return (every.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch_id").alias("_l"))
                .select(*[F.col(c) if c in keys else F.col(f"_l.{c}") for c in df.columns]))

    return q, read


def windowed_timeseries(events: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """Average value and count per tumbling window."""
    return (events.groupBy(F.window("ts", interval).alias("w"))
            .agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "avg_value", "n"))


def windowed_error_rate(events: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """Error percentage per tumbling window."""
    err = (F.col("event_type") == "error").cast("int")
    return (events.groupBy(F.window("ts", interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(err)).alias("error_pct"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "n", "error_pct"))


def latest_per_facet(events: DataFrame, facet: Column | None = None) -> DataFrame:
    """Latest value per ``facet`` (default: host = user_id % 10), as column
    ``host`` — a keyed running ``max_by`` (state is one row per facet), emitted
    in update mode."""
    host = F.col("user_id") % 10 if facet is None else facet
    return events.groupBy(host.alias("host")).agg(
        F.max_by(F.struct("value", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")),
                 F.struct("ts", "event_id")).alias("l")).select(
        "host", F.col("l.value").alias("latest_value"), F.col("l.event_type").alias("latest_type"),
        F.col("l.ts").alias("latest_ts"))


def drift_bins(current: DataFrame, model: drift.PsiReference, prediction: str = "prediction", interval: str = "1 day") -> DataFrame:
    """The state of a windowed drift monitor: ``bucket_start, feature, bin, n, s`` - counts and sums per event-time window,
    feature and bin of the fitted reference.  They add up, so rows may come in any order and any number of
    micro-batches, late ones included; the state holds windows x features x bins, whatever the rows.  ``#positive`` is
    the prediction as a feature of two bins."""
    feats = model.features
    wide = current.select("ts", *[drift.as_number(current, f).alias(f) for f in feats],
                          F.coalesce(drift.as_number(current, prediction) == 1.0, F.lit(False)).cast("double").alias("#positive"))
    long = wide.unpivot(["ts"], [*feats, "#positive"], "feature", "v")
    b = drift.bin_index(F.col("v"), F.element_at(model.edges_col(), F.col("feature")), model.max_edges())
    long = long.withColumn("bin", F.when(F.col("feature") == "#positive", F.col("v").cast("int")).otherwise(b))
    return (long.groupBy(F.window("ts", interval).alias("w"), "feature", "bin").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "feature", "bin", "n", "s"))


def drift_trend(bins: DataFrame, model: drift.PsiReference) -> DataFrame:
    """``bucket_start, n, high_risk_rate, avg_psi`` per window from ``drift_bins``."""
    p = drift.psi_of_bins(model, bins.where(F.col("feature") != "#positive"), "bucket_start")
    s = drift.drift_summary(drift.psi_report(model, p, "bucket_start"), "bucket_start").select("bucket_start", "avg_psi")
    hits = bins.where(F.col("feature") == "#positive").groupBy("bucket_start").agg(F.sum("n").alias("n"), F.sum("s").alias("hits"))
    return hits.join(s, "bucket_start").select("bucket_start", "n", rnd(F.col("hits") / F.col("n") * 100.0, 2).alias("high_risk_rate"), "avg_psi")


def windowed_drift(current: DataFrame, model: drift.PsiReference, prediction: str = "prediction", interval: str = "1 day",
                   available_now: bool = True, processing_seconds: int | None = None) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Start the windowed drift monitor; the reader gives the trend from every window's last state."""
    q, read = run_latest(drift_bins(current, model, prediction, interval), "drift_bins", ["bucket_start", "feature", "bin"],
                         available_now, processing_seconds)
    return q, lambda: drift_trend(read(), model)


def await_all(q: StreamingQuery) -> None:
    """Wait until an ``availableNow`` query has read everything, however long it takes."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def drift_monitor(current: DataFrame, reference: DataFrame, features, history_path: str,
                  prediction: str = "prediction", available_now: bool = True,
                  interval_seconds: int = SNAPSHOT_SECONDS, top: int | None = drift.PSI_TOP_FEATURES) -> StreamingQuery:
    """Drift snapshot per micro-batch against a reference fitted once.

    Every batch adds one row (samples, average PSI, drifted feature count,
    positive rate, shift, status) to the history table under its own
    ``batch_id=`` folder, so a replayed batch rewrites the same row;
    a batch with fewer than 5 rows appends nothing (insufficient samples).
    With ``available_now=False`` the processing-time trigger is the
    snapshot throttle (at most one snapshot per interval)."""
    feats = [f for f in features if f in reference.columns and f in current.columns][:top]
    model = drift.psi_fit(reference, feats)
    ref_rate = drift.positive_rate(reference, prediction).first()["rate"]

    def sink(batch: DataFrame, bid: int) -> None:
        batch = batch.persist()  # read by several aggregates below
        try:
            _snapshot(batch, bid)
        finally:
            batch.unpersist()

    def _snapshot(batch: DataFrame, bid: int) -> None:
        if batch.limit(5).count() < 5:
            return
        p = drift.psi_table(reference, batch, feats, model=model, top=None)
        s = drift.drift_summary(p)
        r = drift.positive_rate(batch, prediction).withColumnRenamed("rate", "current_rate")
        n = batch.agg(F.count(F.lit(1)).alias("samples"))
        row = s.crossJoin(r).crossJoin(n).withColumn("reference_rate", F.lit(float(ref_rate)))
        row = row.select("*", *drift.rate_shift_cols(F.col("reference_rate"), F.col("current_rate")))
        row = row.withColumn("drift_status", drift.drift_status_col(F.col("avg_psi"), F.col("shift_alert")))
        # idempotent per batch id: a replayed micro-batch overwrites its own row
        row.coalesce(1).write.mode("overwrite").parquet(f"{history_path}/batch_id={bid}")

    return run_foreach_batch(current, "drift", sink, mode="append", available_now=available_now,
                             processing_seconds=interval_seconds)
