"""Small builders for the DuckDB oracle SQL (kept next to the queries so that
both sides of every check are readable side by side)."""

from __future__ import annotations


def dbl(x: float) -> str:
    """Exact double literal."""
    return f"CAST('{x!r}' AS DOUBLE)"


def curve_ctes(src: str, name: str = "curve", group: str | None = None,
               extra: list[float] | None = None) -> str:
    """Running confusion counts per distinct score (optionally per group):
    ``[group,] threshold, pos, neg, tp, fp, fn, tn, n_pos, n_neg``."""
    gsel = f"{group}, " if group else ""
    gby = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    extra_rows = ""
    if extra:
        if group:
            extra_rows = " UNION ALL " + " UNION ALL ".join(
                f"SELECT DISTINCT {group}, {dbl(t)} AS threshold, 0 AS y0, 0 AS n0 FROM {src}" for t in extra)
        else:
            extra_rows = " UNION ALL " + " UNION ALL ".join(
                f"SELECT {dbl(t)} AS threshold, 0 AS y0, 0 AS n0" for t in extra)
    base = (f"SELECT {gsel}CAST(p AS DOUBLE) AS threshold, y AS y0, 1 AS n0 FROM {src} WHERE p IS NOT NULL"
            + extra_rows)
    return f"""
{name}_g AS (
  SELECT {gby}threshold, CAST(sum(y0) AS BIGINT) AS pos, CAST(sum(n0) - sum(y0) AS BIGINT) AS neg
  FROM ({base}) GROUP BY {gby}threshold),
{name}_t AS (SELECT {gby}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
  FROM {name}_g {('GROUP BY ' + group) if group else ''}),
{name}_c AS (
  SELECT {gsel}threshold, pos, neg,
         CAST(sum(pos) OVER (w) AS BIGINT) AS tp, CAST(sum(neg) OVER (w) AS BIGINT) AS fp
  FROM {name}_g
  WINDOW w AS ({part}ORDER BY threshold DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (
  SELECT c.*, c_t.n_pos - c.tp AS fn, c_t.n_neg - c.fp AS tn, c_t.n_pos, c_t.n_neg
  FROM {name}_c c {'JOIN' if group else 'CROSS JOIN'} {name}_t c_t {('USING (' + group + ')') if group else ''})"""


def curve_metrics(name: str = "curve") -> str:
    """precision / recall (curve convention) / smoothed F1 over a curve CTE."""
    return f"""
{name}_m AS (
  SELECT *, CASE WHEN n_pos = 0 THEN 1.0 ELSE tp / n_pos END AS recall,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision
  FROM {name}),
{name}_f AS (SELECT *, (2.0 * precision * recall) / (precision + recall + 1e-9) AS f1 FROM {name}_m)"""


def prf_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn", digits: int | None = 4) -> str:
    p = f"CASE WHEN {tp} + {fp} = 0 THEN 0.0 ELSE {tp} / ({tp} + {fp}) END"
    r = f"CASE WHEN {tp} + {fn} = 0 THEN 0.0 ELSE {tp} / ({tp} + {fn}) END"
    f = f"CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2 * {tp} / (2 * {tp} + {fp} + {fn}) END"
    if digits is not None:
        p, r, f = (f"round({x}, {digits})" for x in (p, r, f))
    return f"{p} AS precision, {r} AS recall, {f} AS f1"


def confusion_sql(label: str, pred: str) -> str:
    return (f"count(*) FILTER (WHERE {label} = 0 AND {pred} = 0) AS tn, "
            f"count(*) FILTER (WHERE {label} = 0 AND {pred} = 1) AS fp, "
            f"count(*) FILTER (WHERE {label} = 1 AND {pred} = 0) AS fn, "
            f"count(*) FILTER (WHERE {label} = 1 AND {pred} = 1) AS tp")
