"""Helpers shared by the corpus operators: tables, lineage cuts, row splits and
connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigil.session import run_folder, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new name in the run's folder below the cluster's shared one (``spark.checkpoint.dir``)."""
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` below the shared folder and read it back.

    Unlike an RDD checkpoint the result carries file sizes for the optimizer
    and no partitioning, so a later join on a hot key gets exchanges that
    adaptive execution can split.  Lost executors only repeat their own tasks.
    The run's folder is dropped when the driver ends.
    """
    return written(df, what)


BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its files hold at most ``most`` bytes, else as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most else df


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32(id as text) mod n; null ids count as remainder of the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def ascii_lower(c: str | Column) -> Column:
    """Lower-case A-Z only; null stays null.  ``translate`` looks every character
    up in a table, so it is left to texts that are not plain ASCII."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable, for every node of ``edges(a, b)``.

    Alternating large-star / small-star rounds; each round is a handful of
    joins and partial aggregations and ends with a written table.  Node pairs
    stay distributed, a hub's edges are split by the skew join, and only two
    numbers per round (edge count and checksum) reach the driver.  Nodes whose
    only edge is a loop are absent.  Raises if the rounds do not converge.
    """
    e = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = materialize(e, "edges")
    sign = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == sign or now["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        sign = (now["n"], now["s"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, "large-star")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = (large.join(root.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k"))
               .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(hop.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
