"""SimHash near-duplicates over vantage-point shards (operator 5).

Fingerprints.  Words (A-Z lower-cased) in runs of ``shingle`` words are hashed
with XXH64 (seed 42); a fingerprint bit is set where more than half of a
text's hashes have it.

Search.  Distinct fingerprints only.  A vantage-point tree is fitted on a
bounded hash sample (``SAMPLE`` fingerprints; it decides only where to cut,
never what is compared) and routes every fingerprint: at a node with vantage
point v and radius r, points with d(x, v) <= r go inside, the others outside,
and by the triangle inequality an inside point can have a partner outside only
if d(x, v) > r - max_bits, so just those boundary points are copied outside.
All pairs within ``max_bits`` then meet in one leaf shard, which is exact for
any tree.  Shards above ``CELL`` points are cut into blocks that meet in block
pairs, so no task holds more than two blocks.

Links.  A shard emits a spanning forest of its links, never all pairs of a
group; the forests of all shards have the same components as all links.
Components are found by distributed hooking (``connected_components``).

Defined cases: null, empty and wordless texts have fingerprint 0 and are
linked like any other; fewer words than a shingle hash as one shingle; equal
fingerprints collapse to one point before the search; repeated rows each get
a row; null ids take part, the component id is the smallest id present (null
if the component has none); an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import bounded_batches, connected_components, free_name, written

SAMPLE = 16_384      # fingerprints the tree is fitted on
LEAF_SAMPLE = 48     # stop cutting below this many sample points
LEAF_POINTS = 1_500  # ... or below this many expected points, or LEAF_ROOT times the root of all points:
LEAF_ROOT = 16       # every cut copies boundary points, so deeper trees trade comparisons for copies
MAX_DEPTH = 16
CELL = 65_536        # points of one block of an oversized shard


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype=np.uint64)
    n, total = len(h), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", keep: list[str] | None = None,
                 name: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint as a signed long."""
    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        got = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(got.view(np.int64))

    bounded_batches(docs.sparkSession)
    return docs.select(*(keep or ["doc_id"]), fp(F.col(text_col).cast("string")).alias(name))


# ---------------------------------------------------------------- the tree

class VantageTree:
    """Nodes in arrays: vantage point, radius, children (negative: leaf)."""

    def __init__(self, sample: np.ndarray, total: int, max_bits: int, seed: int = 5):
        self.max_bits = max_bits
        self.vantage, self.radius, self.inside, self.outside = [], [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        scale = total / max(1, len(sample))
        self.leaf_points = max(LEAF_POINTS, LEAF_ROOT * total ** 0.5)
        self.root = self._grow(sample, scale, rng, 0)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, pts: np.ndarray, scale: float, rng, depth: int) -> int:
        if len(pts) < LEAF_SAMPLE or len(pts) * scale < self.leaf_points or depth >= MAX_DEPTH:
            return self._leaf()
        best = None
        for v in rng.choice(pts, size=min(8, len(pts)), replace=False):
            count = np.bincount(np.bitwise_count(pts ^ v), minlength=65)
            upto = np.cumsum(count)
            for r in range(64):
                near, far = upto[r], upto[64] - upto[r]
                copied = upto[r] - (upto[r - self.max_bits] if r >= self.max_bits else 0)
                cost = float(near) ** 2 + float(far + copied) ** 2     # comparisons below, before further cuts
                if near and far and (best is None or cost < best[0]):
                    best = (cost, v, r)
        if best is None or best[0] > 0.9 * float(len(pts)) ** 2:
            return self._leaf()
        _, v, r = best
        node = len(self.vantage)
        self.vantage.append(np.uint64(v))
        self.radius.append(r)
        self.inside.append(0)
        self.outside.append(0)
        d = np.bitwise_count(pts ^ v).astype(np.int64)
        self.inside[node] = self._grow(pts[d <= r], scale, rng, depth + 1)
        self.outside[node] = self._grow(pts[d > r - self.max_bits], scale, rng, depth + 1)
        return node

    def route(self, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, leaves): every leaf that each point belongs to."""
        where, leaf, stack = [], [], [(self.root, np.arange(len(pts)))]
        while stack:
            node, idx = stack.pop()
            if not len(idx):
                continue
            if node < 0:
                where.append(idx)
                leaf.append(np.full(len(idx), -node - 1, dtype=np.int64))
                continue
            d = np.bitwise_count(pts[idx] ^ self.vantage[node]).astype(np.int64)
            stack.append((self.inside[node], idx[d <= self.radius[node]]))
            stack.append((self.outside[node], idx[d > self.radius[node] - self.max_bits]))
        if not where:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(where), np.concatenate(leaf)


def shard_forest(a: np.ndarray, b: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links within ``a`` (when
    ``b`` is empty) or between ``a`` and ``b`` (positions of b follow a)."""
    pts = np.concatenate([a, b])
    n, na = len(pts), len(a)
    step = max(1, (1 << 21) // max(1, n))
    busy = np.zeros(n, dtype=bool)
    for i in range(0, na, step):
        first = na if len(b) else i          # within one block: the upper triangle
        near = np.bitwise_count(pts[i:min(na, i + step), None] ^ pts[None, first:]) <= max_bits
        if not len(b):
            near[np.arange(len(near)), np.arange(len(near))] = False
        busy[i:i + len(near)] |= near.any(axis=1)
        busy[first:] |= near.any(axis=0)
    open_ = np.flatnonzero(busy)
    edges = []
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = np.bitwise_count(pts[open_] ^ pts[i]) <= max_bits
            if len(b):
                hit &= (open_ >= na) != (i >= na)
            found = open_[hit]
            edges.extend((int(i), int(j)) for j in found)
            queue.extend(found.tolist())
            open_ = open_[~hit]
    return edges


def links(points: DataFrame, max_bits: int = 3) -> DataFrame:
    """Forest links (a, b) between the distinct fingerprints of ``points(fp)``."""
    spark = points.sparkSession
    total = points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
    tree = VantageTree(np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64), total, max_bits)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps = pdf["fp"].to_numpy(np.int64)
            for i in range(0, len(fps), 20_000):
                part = fps[i:i + 20_000]
                at, leaf = tree.route(part.view(np.uint64))
                yield pd.DataFrame({"fp": part[at], "leaf": leaf})

    routed = written(points.select("fp").mapInPandas(route, "fp long, leaf long"), "simhash_shards")
    # oversized shards: one row per tree leaf (bounded by the tree, at most 2 ** MAX_DEPTH)
    big = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    blocks = {int(r["leaf"]): int(-(-r["n"] // CELL)) for r in big.collect()}
    k = F.lit(1)
    if blocks:
        table = spark.createDataFrame([(a, b) for a, b in blocks.items()], "leaf long, blocks int")
        routed = routed.join(F.broadcast(table), "leaf", "left")
        k = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("fp"), k).cast("int")
    cells = routed.select("leaf", "fp", block.alias("s"), k.alias("k"))
    cells = cells.select("leaf", "fp", "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t"))
    cells = cells.select("leaf", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), "s", "fp")

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps, side = pdf["fp"].to_numpy(np.int64), pdf["s"].to_numpy()
        lo, hi = key[1], key[2]
        a = fps[side == lo]
        b = fps[side == hi] if hi != lo else fps[:0]
        got = shard_forest(a.view(np.uint64), b.view(np.uint64), max_bits)
        both = np.concatenate([a, b])
        e = np.array(got, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": both[e[:, 0]], "b": both[e[:, 1]]})

    return cells.groupBy("leaf", "lo", "hi").applyInPandas(pairs, "a long, b long")


def classes(points: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, label) of the fingerprints that have a link."""
    return connected_components(links(points, max_bits)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    fps = written(fingerprints(docs, shingle, text_col, [F.col(id_col).alias("doc_id")]), "simhash_fps")
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash_points")
    linked = classes(points, max_bits)
    labelled = points.join(linked, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    comp = labelled.join(smallest, "label").select("fp", "component_id")
    return (fps.join(comp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with one row per near-duplicate group: the row with the
    smallest id (rows without id last; of rows with that same id and
    fingerprint one stays, chosen by a hash of the row)."""
    names = docs.columns
    key, tie, rank = (free_name(docs, f"near_{x}") for x in ("key", "tie", "rank"))
    id_key, row_hash = F.concat_ws("", F.lit("i"), F.col(id_col).cast("string")), F.xxhash64(*names)
    # narrow: what is written stays on disk until the scratch folder goes, the texts are read again from the input
    rows = fingerprints(docs, shingle, text_col, [F.col(id_col).alias("id"), id_key.alias("key"), row_hash.alias("tie")])
    points = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key", "tie")).alias("least")),
                     "simhash_points")
    label = F.coalesce("label", "fp")
    chosen = (points.join(classes(points, max_bits), "fp", "left").groupBy(label.alias("label"))
              .agg(F.min(F.struct("least.no", "least.id", "least.key", "fp", "least.tie")).alias("c"))
              .select(F.col("c.key").alias(key), F.col("c.tie").alias(tie)))
    kept = docs.withColumns({key: id_key, tie: row_hash}).join(chosen, [key, tie], "left_semi")
    equal = Window.partitionBy(key, tie).orderBy(tie)
    return kept.withColumn(rank, F.row_number().over(equal)).filter(F.col(rank) == 1).select(*names)
