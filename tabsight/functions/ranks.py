"""Global ranks and running sums without funnelling rows into one
task.

Rows are first grouped by the ordering value (map-side combined), so a hot
value costs one row.  The grouped rows are range-partitioned on the ordering
column itself (any orderable type) and written once to the checkpoint folder,
so the ranges are fixed; one total per partition gives each partition's
offset, and the running sum inside a partition is a window.  The same steps
run at every size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ranged(grouped: DataFrame, *order, part: str = "__part") -> DataFrame:
    """``grouped`` in ranges of ``order``, with the range number, kept once."""
    n = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))      # raised by ``sized`` for large tables
    return cut_lineage(grouped.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))


def running_sums(grouped: DataFrame, order_col: str, sum_cols: list[str],
                 descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` over ``grouped`` ordered by
    ``order_col`` (one row per distinct value expected)."""
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    rows = ranged(grouped, order)
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(c) for c in sum_cols])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("__o_" + c) for c in sum_cols])
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(offsets), "__part")  # one row per shuffle partition: bounded
    return joined.select(*grouped.columns, *[(F.sum(c).over(inside) + F.col("__o_" + c)).alias(prefix + c) for c in sum_cols])


def with_next(rows: DataFrame, order_col: str, cols: list[str], descending: bool = False, prefix: str = "next_") -> DataFrame:
    """Each row with ``cols`` of the row that follows in the order of
    ``order_col`` (null for the last).  Inside a range this is a window; the last
    row of a range takes the first row of the next range that has one."""
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    held = ranged(rows, order)
    pick = F.max_by if descending else F.min_by
    after = Window.orderBy("__part")                                # one row per range
    firsts = held.groupBy("__part").agg(pick(F.struct(*cols), F.col(order_col)).alias("__f"))
    nexts = firsts.select("__part", F.lead("__f").over(after).alias("__f"))
    inside = Window.partitionBy("__part").orderBy(order)
    met = held.withColumn("__n", F.lead(F.struct(*cols)).over(inside)).join(F.broadcast(nexts), "__part")
    follower = F.coalesce("__n", "__f")
    return met.select(*rows.columns, *[follower[c].alias(prefix + c) for c in cols])


def average_ranks(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Distinct values of ``col`` with their average 1-based rank
    (ties share the mean of their positions), nulls excluded."""
    grouped = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sums(grouped, col, ["__n"])
    return cum.select(col, (F.col("cum___n") - F.col("__n") + (F.col("__n") + 1) / 2.0)
                      .cast("double").alias(out))


def attach(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join a per-value table back to rows.  AQE broadcasts it when its
    measured bytes are small and splits hot keys otherwise."""
    return df.join(small, key, "left")
