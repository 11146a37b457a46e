"""Deterministic splits that scale: hash split and exact stratified split.

No random numbers per run and no shuffle of the whole table to the driver:
each row gets a seeded 64-bit hash of its key; the stratified split ranks
rows by that hash inside their class with the bucketed running count, so a
class holding most of the rows is still ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from vigil.operators.ordered import running_sums, scalar

SEED = 42


def hash_split(df: DataFrame, key: str, train_pct: int = 80, seed: int = SEED, role: str = "role") -> DataFrame:
    """``train`` when pmod(xxhash64(key, seed), 100) < train_pct.  A table with
    fewer than two rows goes wholly to both sides in the reference; here it
    goes to ``train`` (exact 80 % is not guaranteed, the split is stable)."""
    b = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(100))
    return df.withColumn(role, F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test")))


def _holds_map(kind: DataType) -> bool:
    """Maps have no hash of their own."""
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType)


def stratified_split(df: DataFrame, label: str, key: str, train_frac: float = 0.8, seed: int = SEED,
                     role: str = "role") -> DataFrame:
    """Exactly floor(train_frac · n_class) rows of each class go to ``train``,
    chosen by seeded hash order; when a class has fewer than 2 rows the split
    is not stratified (one stratum), as in the reference's fallback.  Rows
    without a label are a class.  Rows of one key stand by a hash of all their
    columns, so only equal rows may change places."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    plain = [F.col(c) if not _holds_map(df.schema[c].dataType) else F.to_json(F.struct(c)) for c in df.columns]
    whole = F.xxhash64(*plain, F.lit(seed))
    order = (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 32)) * F.lit(1 << 21)
             + F.pmod(whole, F.lit(1 << 21))).cast("double")
    d = df.withColumn("_o", order).withColumn("_min_n", scalar(counts, F.min("_n")))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    d = d.withColumn("_stratum", F.when(F.col("_min_n") >= 2, stratum).otherwise(F.lit("all")))
    ranked = running_sums(d, "_o", [], "_stratum", index="_rank", count="_sn")
    return (ranked.withColumn(role, F.when(F.col("_rank") < F.floor(F.col("_sn") * train_frac), F.lit("train"))
                              .otherwise(F.lit("test")))
            .drop("_min_n", "_stratum", "_o", "_rank", "_sn"))
