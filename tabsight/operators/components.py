"""Connected components of an edge table, label = smallest node."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _pointed(table: DataFrame, col: str, jump: DataFrame) -> DataFrame:
    """``table`` with ``col`` replaced by where ``jump(node, to)`` sends it."""
    j = jump.select(F.col("node").alias(col), F.col("to").alias("__to"))
    rest = [c for c in table.columns if c != col]
    return table.join(j, col, "left").select(*rest, F.coalesce("__to", col).alias(col))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``.

    Each round sends every node to its smallest neighbour below it, follows
    those jumps twice and contracts the edges to the ends of the jumps; edges
    inside a contracted node vanish, so the table shrinks to nothing.  State
    lives in checkpoints, and only whether edges are left reaches the driver.
    """
    def tidy(e: DataFrame) -> DataFrame:
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return cut_lineage(e.filter("a <> b").select(low, high).distinct())

    edges = tidy(edges)
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            return labels
        jump = cut_lineage(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        for _ in range(2):
            jump = _pointed(jump, "to", jump).select("node", "to")
        jump = cut_lineage(jump)
        labels = cut_lineage(_pointed(labels, "label", jump).select("node", "label"))
        edges = tidy(_pointed(_pointed(edges, "a", jump), "b", jump))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
