"""Deterministic train/test split and fold assignment by a seeded
hash of whole rows: independent of partitioning and of executor loss, no
shuffle, no global sort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranged

BUCKETS = 10_000


def row_hash(df: DataFrame, seed: int = 42, key_cols: list[str] | None = None) -> Column:
    cols = key_cols or df.columns
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def md5_unit(df: DataFrame, seed: int = 42, key_cols: list[str] | None = None) -> Column:
    """Portable hash in [0, 1): md5 of the '|'-joined text key (the same
    value in any SQL engine with md5)."""
    cols = key_cols or df.columns
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def train_test_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                     key_cols: list[str] | None = None, portable: bool = False) -> DataFrame:
    """H7: adds ``is_test``; about ``test_fraction`` of rows, fixed by seed."""
    if portable:
        return df.withColumn("is_test", md5_unit(df, seed, key_cols) < F.lit(test_fraction))
    b = F.pmod(row_hash(df, seed, key_cols), F.lit(BUCKETS))
    return df.withColumn("is_test", b < F.lit(int(round(test_fraction * BUCKETS))))


def assign_folds(df: DataFrame, k: int, seed: int = 42, key_cols: list[str] | None = None,
                 portable: bool = False) -> DataFrame:
    """``fold`` in 0..k-1 (used as CrossValidator's foldCol)."""
    if portable:
        return df.withColumn("fold", F.floor(md5_unit(df, seed + 1, key_cols) * k).cast("int"))
    return df.withColumn("fold", F.pmod(row_hash(df, seed + 1, key_cols), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, k: int, label: str, order: Column, out: str = "fold") -> DataFrame:
    """``out`` in 0..k-1, the rank of a row among those of its label in the
    order of a hash, modulo k: sizes per label differ by one at most.  Ranks
    come from ranges of (label, hash), so a label with all rows is no single
    task; equal hashes are spread by row."""
    rows = ranged(df.withColumn("__o", order).withColumn("__e", F.xxhash64("__o", F.monotonically_increasing_id())), label, "__o", "__e")
    sums = rows.groupBy(label, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(label).alias("__l"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(label, "__part").orderBy("__o", "__e")
    met = rows.withColumn("__r", F.row_number().over(inside)).join(
        F.broadcast(offsets),                     # at most a row per range and per label
        rows[label].eqNullSafe(offsets["__l"]) & (rows["__part"] == offsets["__p"]))
    return met.select(*df.columns, F.pmod(F.col("__r") - 1 + F.col("__ahead"), F.lit(k)).cast("int").alias(out))


def fold_count(n: int, smallest_class: int | None = None) -> int:
    """clamp(n // 10, 2, 5) for regression, clamp(smallest class, 2, 5) for
    classification."""
    return max(2, min(5, n // 10 if smallest_class is None else smallest_class))
