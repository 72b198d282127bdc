"""Exact top-k inner products by norm-bucketed retrieval (operator 2).

Vectors become integers, floor(scale * x).  Candidates are sorted into buckets
of similar length (norm) and cut into blocks of ``BLOCK`` rows; the stated
queries are cut into blocks too, and query blocks meet candidate blocks by an
equi-join on the block numbers, never row by row.  A task holds one candidate
block and at most ``TOGETHER`` query blocks at a time, so nothing it loads grows
with the table; a candidate block is repeated for every such group.

Two rounds.  Round one scores every query against seed blocks (the longest
vectors and one spread sample block) and so gives each query a lower bound
``theta``: the k-th best score so far.  Round two meets every (query block,
bucket) whose length bound |q| * (longest of the bucket) reaches the bound of
some query in it; inside a block each query has the local cosine threshold
theta / (|q| * longest), and the block is pruned

* by coordinate where the threshold is high: a vector with cosine c to q has
  its coordinate f within cos(arccos(q_f) +- arccos(c)), so the coordinates
  with the largest |q_f| give narrow ranges (a sorted list per coordinate), or
* by length where it is low: only vectors at least theta / |q| long.

What is left is verified with exact integer products.  A block returns at most
k rows per query, so nothing grows with ties or copies.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without id; vectors of different dimension are not compared; a query's own
rows (same id) are no candidates; equal scores go to the smaller id; repeated
ids count as separate candidates; an empty table gives an empty result.
Components whose product could leave 64 bits are an error.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import written

BLOCK = 8192         # candidates of a block
QUERY_BLOCK = 1024   # queries of a block
TOGETHER = 8         # query blocks that meet a candidate block in one group: as many rows as BLOCK
HIGH_COSINE = 0.75   # local threshold from which coordinates prune
FOCUS = 3            # coordinates looked at
SLACK = 1e-9

_OUT = "query_id long, vec_id long, score long"
_EACH = F.monotonically_increasing_id   # deals repeated rows to all blocks; written once, so blocks stay


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>, dim, norm2) of the vectors that take part."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))
    rows = df.filter(x.isNotNull() & F.col(id_col).isNotNull()).filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return rows.withColumn("dim", F.size("v")).withColumn("norm", norm)


def _pack(frames):
    """Vectors as little-endian bytes: one value per row instead of a list."""
    for pdf in frames:
        pdf = pdf.copy()
        pdf["v"] = [np.asarray(x, dtype="<i8").tobytes() for x in pdf["v"]]
        yield pdf


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i8").reshape(-1, dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where they stay exact."""
    most = [max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) for x in (q, c)]
    top = most[0] * most[1] * max(1, q.shape[1])
    if top >= 2.0 ** 63:
        raise ValueError("components too large for exact 64-bit products")
    if top < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (score, then smaller id) of one query."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        if len(near) > 4 * k:      # many ties at the bound: keep the smallest ids of it
            above = near[scores[near] > kth]
            tied = near[scores[near] == kth]
            tied = tied[np.argpartition(ids[tied], min(k, len(tied)) - 1)[:k]] if len(tied) > k else tied
            near = np.concatenate([above, tied])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_block(q: np.ndarray, qids: np.ndarray, theta: np.ndarray, c: np.ndarray, cids: np.ndarray, k: int):
    """At most k (query_id, vec_id, score) per query with score >= theta."""
    out = []
    if not len(q) or not len(c):
        return out
    qn = np.sqrt((q.astype(float) ** 2).sum(1))
    cn = np.sqrt((c.astype(float) ** 2).sum(1))
    longest = cn.max()
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * longest > 0, theta / (qn * longest), -np.inf)
    local = np.where(theta > 0, local, -np.inf)
    alive = local <= 1 + SLACK
    by_coord = alive & (local >= HIGH_COSINE)
    by_length = alive & ~by_coord

    def take(i, rows, scores):
        keep = (scores >= theta[i]) & (cids[rows] != qids[i])
        rows, scores = rows[keep], scores[keep]
        for j in _best(scores, cids[rows], k):
            out.append((int(qids[i]), int(cids[rows[j]]), int(scores[j])))

    idx = np.flatnonzero(by_length)
    if len(idx):
        # a product reaches theta only for vectors at least theta / |q| long
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(qn[idx] > 0, theta[idx] / qn[idx], -np.inf)
        rows = np.flatnonzero(cn >= least.min() * (1 - SLACK) - SLACK)
        part = c[rows]
        for s in range(0, len(idx), 128):
            got = _products(q[idx[s:s + 128]], part)
            for i, scores in zip(idx[s:s + 128], got):
                take(i, rows, scores)
    idx = np.flatnonzero(by_coord)
    if len(idx):
        unit = c / np.where(cn > 0, cn, 1.0)[:, None]
        order = np.argsort(unit, axis=0)
        ranked = np.take_along_axis(unit, order, axis=0)
        for i in idx:
            u = q[i] / qn[i]
            # c has at least the local cosine, so its coordinate f stays in this range
            focus = np.argsort(-np.abs(u))[:FOCUS]
            t = min(1.0, local[i])
            lo, hi = _range(u[focus], t)
            spans = [(np.searchsorted(ranked[:, f], a, "left"), np.searchsorted(ranked[:, f], b, "right"))
                     for f, a, b in zip(focus, lo, hi)]
            n = min(range(len(spans)), key=lambda j: spans[j][1] - spans[j][0])
            a, b = spans[n]
            rows = order[a:b, focus[n]]
            for j, f in enumerate(focus):
                if j != n:
                    x = unit[rows, f]
                    rows = rows[(x >= lo[j]) & (x <= hi[j])]
            if len(rows):
                take(i, rows, _products(q[i:i + 1], c[rows])[0])
    return out


def _range(u: np.ndarray, t: float):
    """Coordinates that a unit vector with cosine >= t to a unit vector with
    coordinate u can have: the cap of angle arccos(t) around it."""
    angle = np.arccos(np.clip(u, -1, 1))
    cap = np.arccos(min(1.0, max(-1.0, t)))
    lo = np.cos(np.minimum(np.pi, angle + cap)) - SLACK
    hi = np.cos(np.maximum(0.0, angle - cap)) + SLACK
    return lo, hi


def _blocked(rows: DataFrame, buckets: int) -> DataFrame:
    """Candidates with their length bucket and block.  Bucket bounds are
    approximate quantiles of the norm over all rows (any bounds are exact);
    equal norms may fill a bucket, so its rows are hashed into blocks."""
    probs = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("norm", probs, 1000).alias("b")).first()["b"] if buckets > 1 else []
    bounds = sorted(set(bounds or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"),
                             lambda b: b < F.col("norm")))
    rows = rows.withColumn("bucket", bucket)
    sizes = {(r["dim"], r["bucket"]): r["n"] for r in rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = rows.sparkSession
    table = spark.createDataFrame([(d, b, max(1, -(-n // BLOCK))) for (d, b), n in sizes.items()] or [(-1, -1, 1)],
                                  "dim int, bucket int, blocks int")
    return (rows.join(F.broadcast(table), ["dim", "bucket"])      # one row per dimension and bucket
            .withColumn("block", F.pmod(F.xxhash64("vec_id", _EACH()), F.col("blocks")).cast("int")).drop("blocks"))


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, buckets: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates."""
    vectors = integer_vectors(df, id_col, vec_col, scale)
    packed = "vec_id long, v binary, dim int, norm double"
    cands = written(_blocked(vectors.mapInPandas(_pack, packed), buckets), "topk_candidates")
    asks = integer_vectors(queries, id_col, vec_col, scale).mapInPandas(_pack, packed)
    n_asks = asks.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()
    most = max([r["n"] for r in n_asks], default=1)
    asks = written(asks.withColumn("qblock", F.pmod(F.xxhash64("vec_id", _EACH()), F.lit(-(-most // QUERY_BLOCK))).cast("int")),
                   "topk_queries")
    blocks = cands.groupBy("dim", "bucket", "block").agg(F.max("norm").alias("longest"))
    blocks = written(blocks, "topk_blocks")

    # round one: per dimension the longest block and one block by hash
    order = F.row_number().over
    firsts = (blocks.withColumn("by_norm", order(Window.partitionBy("dim").orderBy(F.col("longest").desc(), "bucket", "block")))
              .withColumn("by_hash", order(Window.partitionBy("dim").orderBy(F.xxhash64("bucket", "block"))))
              .filter("by_norm = 1 or by_hash = 1").select("dim", "bucket", "block"))
    none = asks.withColumn("theta", F.lit(None).cast("long"))
    seeds = _meet(cands, none, firsts.join(asks.select("dim", "qblock").distinct(), "dim"), k)
    theta = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")) \
        .select("query_id", F.try_element_at("s", F.lit(k)).alias("theta"))
    bounded = written(asks.join(theta, asks["vec_id"] == theta["query_id"], "left").drop("query_id"), "topk_bounds")

    # round two: blocks whose length bound reaches the loosest bound of a query block
    loosest = bounded.groupBy("dim", "qblock").agg(
        F.min(F.coalesce(F.col("theta").cast("double"), F.lit(float("-inf"))) / F.greatest("norm", F.lit(1e-300))).alias("ratio"))
    meets = (blocks.join(loosest, "dim").filter((F.col("ratio") <= 0) | (F.col("longest") * (1 + 1e-9) >= F.col("ratio")))
             .select("dim", "bucket", "block", "qblock"))
    found = _meet(cands, bounded, meets, k)
    # at most k rows per query and block: ranked per query
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _meet(cands: DataFrame, asks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Score query blocks against candidate blocks.  ``pairs`` names the blocks
    that meet; a group holds one candidate block and at most ``TOGETHER`` of
    the query blocks that meet it."""
    keys = ["dim", "bucket", "block", "qgroup"]
    qgroup = F.floor(F.col("qblock") / TOGETHER).cast("int").alias("qgroup")
    routed = asks.join(pairs, ["dim", "qblock"]).select("*", qgroup)
    repeated = cands.join(pairs.select(*keys[:3], qgroup).distinct(), keys[:3])

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            c, cids = _matrix(left["v"], dim), left["vec_id"].to_numpy(np.int64)
            for s in range(0, len(right), QUERY_BLOCK):
                part = right.iloc[s:s + QUERY_BLOCK]
                theta = part["theta"].astype("float64").fillna(-np.inf).to_numpy()
                out += search_block(_matrix(part["v"], dim), part["vec_id"].to_numpy(np.int64), theta, c, cids, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return repeated.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(score, _OUT)
