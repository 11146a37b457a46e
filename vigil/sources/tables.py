"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; projections and filters applied later reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_instant(c: Column | str) -> Column:
    """``timestamp_ntz`` -> ``timestamp`` (session zone is UTC), needed by watermarks."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp")


def as_local(c: Column | str) -> Column:
    """Back to ``timestamp_ntz`` for batch outputs compared with other engines."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")
