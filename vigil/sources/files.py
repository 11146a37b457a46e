"""File sources and sinks: multi-file scans tagged by period, CSV with a
delimiter fallback, JSON-lines logs with an explicit schema, schema-level
column canonicalisation, source guards and append/overwrite sinks.

Column-name work (canonicalisation, de-duplication) touches only the schema
on the driver; every data operation is a Spark read or write.
"""

from __future__ import annotations

import re
import unicodedata
from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values of the reference loader: period names, exact aliases, and words that together rename a column
PERIOD_PATTERN = r"(202\d)"
COLUMN_ALIASES = {
    "RA": ["RA", "ID_ALUNO", "CODIGO_ALUNO", "MATRICULA"],
    "NOTA_MAT": ["MAT", "MATEM", "MATEMATICA"],
    "NOTA_PORT": ["POR", "PORT", "PORTUG", "PORTUGUES"],
    "NOTA_ING": ["ING", "INGL", "INGLES"],
    "DEFASAGEM": ["DEFAS", "DEFASAGEM"],
}
ENTRY_YEAR = (("ANO", "INGRESSO"), "ANO_INGRESSO")
LATER_RULES = [
    (("INST", "ENSINO"), "INSTITUICAO_ENSINO"),
    (("PONTO", "VIRADA"), "PONTO_VIRADA"),
    (("PSICOLOGIA", "REC"), "REC_PSICOLOGIA"),
]
KEY = "RA"


class SourceError(FileNotFoundError):
    """No usable input."""


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by column name, keeping duplicates; missing columns become null.
    A column that is text in one input and a number in another becomes text
    (the coercions parse it later), not a failing cast."""
    frames = list(frames)
    if not frames:
        raise SourceError("nothing to union")
    types: dict[str, set[str]] = {}
    for f in frames:
        for c, t in f.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, ts in types.items() if len(ts) > 1 and "string" in ts}
    frames = [f.withColumns({c: F.col(f"`{c}`").cast("string") for c in f.columns if c in mixed}) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _expand(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        stats = fs.globStatus(hp)
        if stats:
            found += [s.getPath().toString() for s in stats]
    return found


def scan_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
              period_col: str | None = "period", period_pattern: str = PERIOD_PATTERN,
              options: Mapping[str, str] | None = None, prepare=None) -> DataFrame:
    """All inputs matching ``paths`` (globs allowed) as one DataFrame.

    No match -> SourceError.  The period is the first ``202Y`` in each
    input's own name; inputs without one are skipped and if none remains a
    SourceError is raised.  Inputs of the same period are read together and
    tagged with it, then periods are unioned by column name (missing columns
    become null) — one read per distinct period, not per file.  ``prepare(df,
    period)`` is applied to each period's columns before.  Data laid out
    in ``period=YYYY`` folders needs none of this: Spark discovers it."""
    found = _expand(spark, paths)
    if not found:
        raise SourceError(f"no input files match {list(paths)}")
    reader = spark.read.format(fmt).options(**(options or {}))
    if not period_col:
        return reader.load(found)
    by_period: dict[int, list[str]] = {}
    for f in found:
        m = re.search(period_pattern, f.rstrip("/").rsplit("/", 1)[-1])
        if m:
            by_period.setdefault(int(m.group(1)), []).append(f)
    if not by_period:
        raise SourceError("no input file carries a period in its name")
    prepare = prepare or (lambda df, period: df)
    return union_all(prepare(reader.load(fs), p).withColumn(period_col, F.lit(p).cast("int"))
                     for p, fs in sorted(by_period.items()))


def sniff_delimiter(spark: SparkSession, path: str, candidates: Sequence[str] = (";", ",")) -> str:
    """Pick the first delimiter that splits the header into > 1 column."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    for sep in candidates:
        if len(line.split(sep)) > 1:
            return sep
    return candidates[-1]


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             required: Sequence[str] = ()) -> DataFrame:
    """CSV with header; ``;`` first, ``,`` when the header does not split.
    A required column (e.g. the period) missing -> SourceError."""
    sep = sniff_delimiter(spark, path)
    r = spark.read.option("header", "true").option("sep", sep)
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SourceError(f"{path}: missing columns {missing}")
    return df


def canonical_name(name: str, period: int | None = None) -> str:
    """The contract's name of a sheet's column: upper case, no accents, without
    the sheet's *own* year (another year stays: it is another column), then the
    aliases.  Two columns that differ in anything else stay two."""
    n = unicodedata.normalize("NFKD", str(name).upper().strip()).encode("ascii", "ignore").decode("ascii")
    if period is not None:
        n = re.sub(rf"[ _]{period}|[ _]{period % 100:02d}$", "", n)
    by_alias = {alias: target for target, aliases in COLUMN_ALIASES.items() for alias in aliases}
    rules = LATER_RULES + ([] if n in by_alias else [ENTRY_YEAR])
    return next((target for needles, target in rules if all(w in n for w in needles)), by_alias.get(n, n))


def canonical_columns(df: DataFrame, period: int | None = None) -> DataFrame:
    """Rename to canonical names, then keep the first of equal names; the key is trimmed text."""
    names = [canonical_name(c, period) for c in df.columns]
    tmp = [f"_c{i}" for i in range(len(names))]
    d = df.toDF(*tmp)
    seen, keep = set(), []
    for t, n in zip(tmp, names):
        if n not in seen:
            seen.add(n)
            keep.append((F.trim(F.col(t).cast("string")) if n == KEY else F.col(t)).alias(n))
    return d.select(*keep)


def scan_panel(spark: SparkSession, paths: Sequence[str], required: Sequence[str] = (), types: Mapping[str, str] | None = None,
               period_col: str = "ANO_REFERENCIA", fmt: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """The loader as one plan: every input canonicalised with its own period,
    tagged, unioned by name, then the contract — required columns, at least one
    row, types."""
    from vigil.operators import contract

    df = scan_many(spark, paths, fmt, period_col, options=options, prepare=canonical_columns)
    df = contract.require_non_empty(contract.require_columns(df, [*required, period_col]))
    return contract.coerce_types(df, types, fill=None) if types else df


def scan_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with an explicit schema; malformed lines become null rows
    (line-level tolerance) instead of failing the whole file."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def flatten_structs(df: DataFrame, structs: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Expand nested records side by side; ``rename`` maps field -> new name."""
    rename = rename or {}
    keep = [c for c in df.columns if c not in structs]
    fields = []
    for s in structs:
        for f in df.schema[s].dataType.fields:
            fields.append(F.col(f"{s}.{f.name}").alias(rename.get(f.name, f.name)))
    return df.select(*keep, *fields)


def tail_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows by ``order`` (descending); n <= 0 -> empty.
    Planned as a distributed top-k (TakeOrderedAndProject)."""
    if n <= 0:
        return df.limit(0)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def open_if_there(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None where nothing is; a table that is there but can't be read raises."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.format(fmt).load(path)


def source_status(ref: DataFrame | None, cur: DataFrame | None, min_rows: int = 5) -> str:
    """Monitoring guard: a status instead of an exception."""
    if ref is None:
        return "reference_not_found"
    if cur is None:
        return "logs_not_found"
    n = cur.limit(min_rows).count()
    if n == 0:
        return "empty_or_invalid_logs"
    if n < min_rows:
        return "insufficient_samples"
    return "ok"


# --------------------------------------------------------------------------- sinks

def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (),
                fmt: str = "parquet") -> None:
    """Append/overwrite sink (history tables are append-only, no read-modify-write)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_one_row(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """A one-row statistics table; unreadable -> empty DataFrame of ``schema``."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except Exception:  # noqa: BLE001 - unreadable source degrades to empty
        return spark.createDataFrame([], schema)
