"""An append-only log whose appends can be repeated.

``path/runs/<run>-<attempt>`` holds the rows of one attempt, ``path/manifest/<run>``
is written last and names the attempt that counts.  A run with a manifest is
committed: appending it again does nothing, and rows of attempts that failed are
never read.  Compaction is a run that replaces others, by the same rule: its manifest
lists them, so that readers see either the old runs or the new one.  Manifests are
created exclusively, so that of two writers of one run one wins."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


FILE_BYTES = 32 << 20  # of the files that a compaction leaves, as far as the replaced ones' bytes tell


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@dataclass(frozen=True)
class Run:
    """A committed run: its folder, how many rows it added, and the runs that it replaces."""

    run: str
    folder: str
    rows: int
    replaces: tuple[str, ...] = ()


def _commit(spark: SparkSession, path: str, run: Run) -> bool:
    """Write the manifest unless the run has one."""
    fs, where = _fs(spark, f"{path}/manifest/{run.run}")
    try:
        out = fs.create(where, False)
    except Exception as e:  # py4j wraps the store's own exception
        if fs.exists(where):
            return False
        raise RuntimeError(f"no manifest could be written to {path}") from e
    out.write(bytearray(json.dumps({"run": run.run, "folder": run.folder, "rows": run.rows, "replaces": run.replaces}).encode()))
    out.close()
    return True


def runs(spark: SparkSession, path: str) -> list[Run]:
    """The committed runs in force, by name: one small file each, fewer after compaction."""
    fs, where = _fs(spark, f"{path}/manifest")
    if not fs.exists(where) or not fs.listStatus(where):
        return []
    found = [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest").collect()]
    gone = {x for r in found for x in r["replaces"]}
    return sorted((Run(r["run"], r["folder"], r["rows"], tuple(r["replaces"])) for r in found if r["run"] not in gone), key=lambda r: r.run)


def _write(df: DataFrame, path: str, run: str) -> tuple[str, int]:
    folder = f"runs/{run}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path}/{folder}")
    return folder, df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}").count()


def append(df: DataFrame, path: str, run: str) -> bool:
    """Add ``df`` as ``run`` (letters, digits, ``.``, ``-`` and ``_``); False if it had been added before."""
    if not run or not all(c.isalnum() or c in "._-" for c in run) or run.startswith((".", "_")):
        raise ValueError(f"run id {run!r}")
    spark = df.sparkSession
    fs, where = _fs(spark, f"{path}/manifest/{run}")
    if fs.exists(where):
        return False
    folder, rows = _write(df, path, run)
    return _commit(spark, path, Run(run, folder, rows))


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed runs."""
    folders = [f"{path}/{r.folder}" for r in runs(spark, path) if r.rows]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _bytes(spark: SparkSession, path: str, found: list[Run]) -> int:
    """Bytes of the runs' files."""
    fs, _ = _fs(spark, path)
    return sum(fs.getContentSummary(_fs(spark, f"{path}/{r.folder}")[1]).getLength() for r in found if r.rows)


def compact(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None, file_bytes: int = FILE_BYTES) -> bool:
    """Rewrite all committed runs as one of ``files`` files, by default as many as keep each at about ``file_bytes``, so
    that a task's share does not grow with the log; False if there is at most one.  The replaced folders stay for readers
    that have begun, until ``vacuum``."""
    old = runs(spark, path)
    if len(old) < 2:
        return False
    if files is None:
        files = max(1, -(-_bytes(spark, path, old) // file_bytes))
    name = f"compact-{uuid.uuid4().hex[:12]}"
    folder, rows = _write(read(spark, path, schema).repartition(files), path, name)
    return _commit(spark, path, Run(name, folder, rows, tuple(r.run for r in old)))


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that no run in force uses - replaced ones and failed attempts; not while others append."""
    kept = {r.folder for r in runs(spark, path)}
    fs, where = _fs(spark, f"{path}/runs")
    gone = [s.getPath() for s in fs.listStatus(where) if f"runs/{s.getPath().getName()}" not in kept] if fs.exists(where) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
