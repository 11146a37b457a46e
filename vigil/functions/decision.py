"""Scoring decisions as column expressions: class, label, segment, review
band and textual risk drivers.  No UDFs; a margin lookup is a literal map."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the reference configuration
DEFAULT_THRESHOLD = 0.5072
LOW_SEGMENT_MAX = 0.3
REVIEW_MARGIN = 0.02
SEGMENT_LOW, SEGMENT_MEDIUM, SEGMENT_HIGH = "low", "medium", "high"
LABEL_HIGH, LABEL_LOW = "high risk", "low risk"
DRIVER_ENGAGEMENT = "drop in prior engagement"
DRIVER_INDEX = "low prior index"
DRIVER_TENURE = "short tenure"
DRIVER_AGE = "age above grade average"
DRIVER_NONE = "stable history without a dominant critical signal"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def decision(p, t=DEFAULT_THRESHOLD) -> Column:
    """1 when p >= t (boundary inclusive, unrounded p)."""
    return (_c(p) >= _c(t)).cast("int")


def risk_label(pred) -> Column:
    return F.when(_c(pred) == 1, F.lit(LABEL_HIGH)).otherwise(F.lit(LABEL_LOW))


def segment(p, t=DEFAULT_THRESHOLD, low_max: float = LOW_SEGMENT_MAX) -> Column:
    """p < low_max -> low; p < t -> medium; else high (with t < low_max a
    positive decision can sit in ``low``, as in the reference)."""
    p, t = _c(p), _c(t)
    return (F.when(p < F.lit(low_max), F.lit(SEGMENT_LOW))
            .when(p < t, F.lit(SEGMENT_MEDIUM)).otherwise(F.lit(SEGMENT_HIGH)))


def margin_for(group, margins: Mapping[str, float], default: float = REVIEW_MARGIN) -> Column:
    """Per-group review margin: literal map lookup with a default."""
    if not margins:
        return F.lit(float(default))
    m = F.create_map(*[x for k, v in margins.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(m, F.trim(_c(group).cast("string"))), F.lit(float(default)))


def review_band(p, t=DEFAULT_THRESHOLD, margin=REVIEW_MARGIN, enabled: bool = True) -> Column:
    """max(0, t−m) <= p <= min(1, t+m) when enabled and the margin is > 0."""
    if not enabled:
        return F.lit(False)
    p, t, m = _c(p), _c(t), _c(margin)
    lo = F.greatest(F.lit(0.0), t - m)
    hi = F.least(F.lit(1.0), t + m)
    return F.coalesce((m > 0) & (p >= lo) & (p <= hi), F.lit(False))


def risk_drivers(prior_engagement, prior_index, is_new, tenure, age, top: int = 3) -> Column:
    """Ordered textual drivers, first ``top``; a default text when none fires.
    Missing inputs count as 0, like the reference."""
    z = lambda c: F.coalesce(_c(c).cast("double"), F.lit(0.0))
    rules = F.array(
        F.when(z(prior_engagement) <= 4.0, F.lit(DRIVER_ENGAGEMENT)),
        F.when(z(prior_index) <= 5.0, F.lit(DRIVER_INDEX)),
        F.when((z(is_new) == 1) | (z(tenure) <= 1), F.lit(DRIVER_TENURE)),
        F.when(z(age) >= 15, F.lit(DRIVER_AGE)))
    fired = F.array_compact(rules)
    return F.when(F.size(fired) == 0, F.array(F.lit(DRIVER_NONE))).otherwise(F.slice(fired, 1, top))
