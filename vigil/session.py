"""Session helper and lineage-cut location.

On a cluster the shared checkpoint folder comes from ``spark.checkpoint.dir``;
only when nothing is configured (local tests) a scratch folder is created.
"""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "vigil",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    ``master`` defaults to ``local[$BENCH_CPUS]`` / ``local[*]``; on a cluster
    the submitter sets the master and this only adds SQL settings.
    """
    if master is None:
        cpus = os.environ.get("BENCH_CPUS")
        master = f"local[{cpus}]" if cpus else "local[*]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and streaming state.

    Reads ``spark.checkpoint.dir`` (the cluster's shared folder).  Only when it
    is unset on a ``local`` master — tests — a scratch folder is created and
    registered, so later calls agree; on a cluster it must be set, because no
    folder of the driver is seen by the executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_RUN = uuid.uuid4().hex
_dropped_at_exit: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The folder of this run's written tables below the shared one; dropped when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vigil-run-{_RUN}"
    if path not in _dropped_at_exit:
        _dropped_at_exit.add(path)
        atexit.register(_drop_at_exit, spark, path)
    return path


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_run(spark, path)
    except Exception as e:  # noqa: BLE001 - the JVM may have gone first; nothing can be done at exit
        logging.getLogger("vigil").debug("run folder %s stays: %s", path, e)


def drop_run(spark: SparkSession, path: str | None = None) -> None:
    """Delete the run's written tables; results that still read them are lost."""
    path = path or run_folder(spark)
    if spark.sparkContext._jsc is None:  # stopped before
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` into the run's folder and read it back.

    Unlike a persisted frame it survives lost executors, and unlike an RDD
    checkpoint it carries file sizes for the optimizer."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
