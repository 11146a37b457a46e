"""Which model was in force when: a versioned registry joined as of each row's time.

The registry is an append-only table, a row per promotion (version, since when,
threshold, strategy).  A version is in force until the next one is; rows before
the first have the defaults.  The same join serves a batch and, as a
stream-static join, a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.decision import DEFAULT_THRESHOLD

UNKNOWN_VERSION = "unknown"
NO_STRATEGY = "n/d"
MAX_VERSIONS = 100_000  # promotions, a row of under 100 bytes each; more are no registry of models


def intervals(registry: DataFrame, since: str = "valid_from") -> DataFrame:
    """``registry(version, <since>, risk_threshold, strategy)`` with ``valid_to``, when the next version takes over (null
    for the last).  Of versions promoted at the same time the greatest by name holds."""
    have = lambda c, kind: F.col(c).cast(kind) if c in registry.columns else F.lit(None).cast(kind)
    one = (registry.where(F.col(since).isNotNull()).groupBy(F.col(since).alias("valid_from"))
           .agg(F.max(F.struct(F.col("version"), have("risk_threshold", "double").alias("risk_threshold"), have("strategy", "string").alias("strategy"))).alias("_v")))
    following = F.lead("valid_from").over(Window.orderBy("valid_from"))  # one row per promotion
    return one.select("_v.*", "valid_from", following.alias("valid_to"))


def in_force(rows: DataFrame, at: str, registry: DataFrame, since: str = "valid_from", threshold: float = DEFAULT_THRESHOLD,
             version: str = UNKNOWN_VERSION, strategy: str = NO_STRATEGY) -> DataFrame:
    """``rows`` with ``model_version``, ``risk_threshold`` and ``threshold_strategy`` of the version in force at each row's
    ``at``; the defaults before the first version, where ``at`` is null, and where a version has none."""
    held = intervals(registry, since)
    if held.count() > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} promotions in the registry")
    held = F.broadcast(held.withColumnsRenamed({c: f"_m_{c}" for c in held.columns}))
    t = F.col(at)
    within = (t >= F.col("_m_valid_from")) & (F.col("_m_valid_to").isNull() | (t < F.col("_m_valid_to")))
    return (rows.join(held, within, "left")
            .withColumns({"model_version": F.coalesce("_m_version", F.lit(version)), "risk_threshold": F.coalesce("_m_risk_threshold", F.lit(float(threshold))),
                          "threshold_strategy": F.coalesce("_m_strategy", F.lit(strategy))})
            .drop(*held.columns))
