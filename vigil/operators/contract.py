"""Input contracts: required columns, non-empty input, type coercion with a
loss report, and row-level domain validation with a quarantine output."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.clean import to_number


class ContractError(ValueError):
    """Raised when a DataFrame violates its contract."""


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail listing *all* missing columns at once."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ContractError(f"missing required columns: {missing}; available: {df.columns}")
    return df


def require_non_empty(df: DataFrame | None) -> DataFrame:
    if df is None or df.isEmpty():
        raise ContractError("empty or null DataFrame")
    return df


def coerce_types(df: DataFrame, spec: Mapping[str, str], fill: float | None = 0) -> DataFrame:
    """Cast ``spec`` columns: ``string`` columns are cast as text; numeric ones
    are coerced (bad -> null) and, when ``fill`` is not None, nulls -> fill."""
    out = {}
    for c, t in spec.items():
        if c not in df.columns:
            continue
        if t in ("string", "str"):
            out[c] = F.col(c).cast("string")
        else:
            v = to_number(F.col(c))
            if t in ("int", "integer", "long", "bigint"):
                v = F.when(v.isNotNull() & (F.abs(v) < 9.2e18), v.cast("long"))
                if t in ("int", "integer"):
                    v = F.when(v.between(-2147483648, 2147483647), v.cast("int"))
            if fill is not None:
                tt = "int" if t in ("int", "integer") else ("long" if t in ("long", "bigint") else "double")
                v = F.coalesce(v, F.lit(fill).cast(tt))
            out[c] = v
    return df.withColumns(out)


def coercion_loss_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One pass over the data: per column the rows, non-null inputs and the
    values lost by numeric coercion (non-null in, null out).  Long output
    ``column, n_rows, n_non_null, n_lost``."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNotNull()).alias(f"nn_{i}"),
                 F.count_if(F.col(c).isNotNull() & to_number(F.col(c)).isNull()).alias(f"lost_{i}")]
    a = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"nn_{i}").alias("n_non_null"),
                                        F.col(f"lost_{i}").alias("n_lost")) for i, c in enumerate(cols)]))
    return a.select("n_rows", rows.alias("r")).select("r.column", "n_rows", "r.n_non_null", "r.n_lost")


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Array of the names of failed rules; a rule is (name, ok-condition) and a
    null condition counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
                                     for name, ok in rules]))


def validate_rows(df: DataFrame, rules: Sequence[tuple[str, Column]],
                  col: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Split into (valid, quarantine); quarantine rows carry the failed rule names."""
    tagged = df.withColumn(col, reasons(rules))
    return (tagged.where(F.size(col) == 0).drop(col), tagged.where(F.size(col) > 0))


def request_defaults(df: DataFrame, priors: Sequence[str] = (), flag: str | None = "is_new") -> DataFrame:
    """What a request may leave out: optional prior metrics are 0.0 and the new-entity flag is 0, whether the column is
    absent or the value null.  Applied before the rules."""
    have = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    new = {c: F.coalesce(have(c, "double"), F.lit(0.0)) for c in priors}
    if flag is not None:
        new[flag] = F.coalesce(have(flag, "int"), F.lit(0))
    return df.withColumns(new)


def request_rules(key="key", age="age", start="start_year", group="group", klass="klass",
                  institution="institution", phase="phase", ref_year="ref_year",
                  prior_index="prior_index") -> list[tuple[str, Column]]:
    """Domain of a scoring request (fixed limits of the reference schema)."""
    length = lambda c: F.length(F.col(c).cast("string"))
    return [
        ("key_empty", length(key) >= 1),
        ("age_out_of_range", F.col(age).between(4, 25)),
        ("start_year_out_of_range", F.col(start).between(2010, 2026)),
        ("group_not_allowed", F.col(group).isin("Masculino", "Feminino", "Outro")),
        ("class_empty", length(klass) >= 1),
        ("institution_too_short", length(institution) >= 3),
        ("phase_empty", length(phase) >= 1),
        ("ref_year_out_of_range", F.col(ref_year).isNull() | F.col(ref_year).between(2010, 2030)),
        ("prior_index_out_of_range", F.col(prior_index).between(0, 10)),
    ]
