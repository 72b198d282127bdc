"""N-gram Jaccard join over size-banded tiles (operator 12).

A document's set holds its distinct word n-grams as sorted XXH64 hashes.  Two
documents link where percent / 100 of their union is common.

Sets that link share one of the first n - ceil(percent n / 100) + 1 n-grams of
any common order, and their sizes differ by at most 100 / percent.  So a tile
is an n-gram of such a prefix and a band of sizes; a document enters the tile of
its own band and that of the band below, and each pair within reach meets.
N-grams met in many documents come last in the order (``frequent`` measures a
hash sample; it decides the order only, never what is compared), tiles with the
same documents are compared once, and equal sets are one point.

In a tile hashed bitmaps come first: a bit that only one side has is an
n-gram that only this side has, so bit counts bound the overlap from above.  A
tile emits a forest of the pairs that pass; the components of all forests hold
every link, and each document is in one of them.  Their texts are read again,
and inside a component the sorted arrays of pairs that pass the bitmaps are
intersected, until its documents are joined or all pairs are done; what leaves
the task is a forest of links, so large groups of copies stay linear.  Tiles
and components above a bounded number of rows or bytes are cut into blocks:
components first compare blocks that share a few documents, and only those
that still hold separate documents meet in block pairs.

Defined cases: null, empty and wordless texts have no set and link with
nothing; with fewer than n words the whole sequence is the one n-gram; repeated
rows each get a row and are linked (equal sets); null ids take part, the
component id is the smallest id present (null if there is none); an empty table
gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import bounded_batches, connected_components, written

SAMPLE = 2_048           # documents whose n-grams tell the frequent ones
SAMPLE_NGRAMS = 8_192    # n-grams of such a document looked at
FREQUENT = 6             # ... and in so many of them an n-gram is frequent
BLOCK_ROWS = 4_096       # a tile above this, or above BLOCK_BYTES, is cut into blocks
BLOCK_BYTES = 16 << 20
GROUP_BYTES = 24 << 20   # small tiles are gathered into groups of about this size
PIVOTS = 32              # documents that all blocks of a tile share in the first pass
MOST_BITS = 1 << 20


# ---------------------------------------------------------------- sets and bitmaps

def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-n] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[n - 1:].tolist())], dtype=np.uint64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Hashed bitmap, two to four bits an n-gram, as uint64 words."""
    bits = 64
    while bits < 2 * len(hashes) and bits < MOST_BITS:
        bits *= 2
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    held = np.zeros(bits, dtype=bool)
    held[at] = True
    return np.packbits(held, bitorder="little").view(np.uint64)


def needed(a, b, percent: int):
    """Least overlap of two linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class Maps:
    """Bitmaps of several sets; a longer one is folded (halves ORed) to meet a
    shorter one."""

    def __init__(self, maps: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        self.words = np.fromiter(map(len, maps), np.int64, len(maps))
        self.held, self.place = {}, np.zeros(len(maps), dtype=np.int64)
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.held[w] = np.stack([maps[i] for i in at])

    def _at(self, rows: np.ndarray, have: int, words: int) -> np.ndarray:
        got = self.held[have][self.place[rows]]
        return got if have == words else np.bitwise_or.reduce(got.reshape(len(rows), -1, words), axis=1)

    def possible(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of ``js`` that the bit counts leave as partners of i."""
        ok, mine = np.zeros(len(js), dtype=bool), int(self.words[i])
        for w in np.unique(self.words[js]).tolist():
            some = np.flatnonzero(self.words[js] == w)
            least = min(w, mine)
            left, right = self._at(np.array([i]), mine, least), self._at(js[some], w, least)
            both = np.bitwise_count(left & right).sum(axis=1, dtype=np.int64)
            only_left = np.bitwise_count(left).sum(dtype=np.int64) - both
            only_right = np.bitwise_count(right).sum(axis=1, dtype=np.int64) - both
            a, b = self.sizes[i], self.sizes[js[some]]
            ok[some] = np.minimum(a - only_left, b - only_right) >= needed(a, b, self.percent)
        return js[ok]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


# ---------------------------------------------------------------- sets of all documents

def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted n-grams met in at least FREQUENT of about SAMPLE documents (a hash
    sample; at most SAMPLE * SAMPLE_NGRAMS / FREQUENT of them)."""
    every = max(1, docs.count() // SAMPLE)

    def grams(frames):
        for pdf in frames:
            got = [ngram_set(t, n)[:SAMPLE_NGRAMS] for t in pdf["text"]]
            yield pd.DataFrame({"g": np.concatenate([np.empty(0, dtype=np.uint64), *got]).view(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", "text").distinct()
    met = some.select("text").mapInPandas(grams, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    rows = met.filter(F.col("c") >= FREQUENT).select("g").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def _described(late: np.ndarray, n: int, percent: int):
    """Per text: size of the set, digest, prefix and bitmap."""
    @F.pandas_udf("n long, digest binary, prefix array<long>, bits binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            h = ngram_set(text, n)
            if not len(h):
                out.append((0, None, None, None))
                continue
            last = np.zeros(len(h), dtype=bool)
            if len(late):
                at = np.searchsorted(late, h)
                at[at == len(late)] = 0
                last = late[at] == h
            first = np.concatenate([h[~last], h[last]])[:len(h) - -(-percent * len(h) // 100) + 1]
            out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), first.view(np.int64), bitmap(h).tobytes()))
        return pd.DataFrame(out, columns=["n", "digest", "prefix", "bits"])
    return run


def _arrays(n: int):
    """Sorted arrays and bitmaps of the texts whose digest is the point's."""
    def run(frames):
        for pdf in frames:
            out = []
            for rid, text, digest in zip(pdf["rid"], pdf["text"], pdf["digest"]):
                h = ngram_set(text, n)
                if xxhash.xxh3_128_digest(h.tobytes()) == bytes(digest):
                    out.append((rid, h.tobytes(), bitmap(h).tobytes()))
            yield pd.DataFrame(out, columns=["rid", "hashes", "bits"])
    return run


# ---------------------------------------------------------------- tiles

def tiles(prefixes: DataFrame, percent: int) -> DataFrame:
    """(tile, own, rid, n, c, total): documents of every tile in which a pair can
    meet, from (rid, n, prefix); c rows with total n-grams a tile."""
    rows = prefixes.select("rid", "n", F.explode("prefix").alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rid")).alias("x"),
                                  F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).filter(F.col("c") > 1)
    one = met.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")     # tiles of the same documents: one
    # bands a little wider than the ratio, so that rounding parts no pair by two bands
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100.0 / percent * 1.0001)).cast("int")
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")),
                             F.struct((band - 1).alias("band"), F.lit(False).alias("own")))).alias("b")
    # neither side has a bound: a merge join at every size
    rows = rows.join(one.hint("merge"), "key").select("key", "rid", "n", both)
    rows = written(rows.select(F.struct("key", "b.band").alias("tile"), "b.own", "rid", "n"), "jaccard_tiles")
    size = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"), F.max("own").alias("any"))
    return rows.join(size.filter((F.col("c") > 1) & F.col("any")).drop("any"), "tile")


def _cells(rows: DataFrame, bytes_each: float, paired: bool = True) -> DataFrame:
    """Rows (tile, c, total, rid, n, ...) with the group (cell, lo, hi) they are
    compared in and their side s.  Small tiles are gathered; large ones are cut
    into blocks, which meet in pairs or (``paired`` false) only share a few rows."""
    spread = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    k = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("total") * bytes_each / BLOCK_BYTES)).cast("int")
    all_bytes = rows.agg(F.sum(F.col("n") * bytes_each).alias("b")).first()["b"] or 0
    groups = max(int(spread), math.ceil(all_bytes / GROUP_BYTES))
    rows = rows.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("rid"), k).cast("int"))
    cell = F.when(F.col("k") == 1, F.pmod(F.xxhash64("tile"), F.lit(groups))).otherwise(F.xxhash64("tile")).alias("cell")
    blocks = F.sequence(F.lit(0), F.col("k") - 1)
    if paired:
        rows = rows.select("*", cell, F.explode(blocks).alias("other"))
        return rows.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                           F.col("block").alias("s")).drop("k", "block", "other", "c", "total")
    pivot = F.pmod(F.xxhash64("rid", F.lit(7)), F.col("c")) < PIVOTS
    rows = rows.select("*", cell, F.explode(F.when(pivot, blocks).otherwise(F.array("block"))).alias("lo"))
    return rows.select("*", F.col("lo").alias("hi"), F.col("lo").alias("s")).drop("k", "block", "c", "total")


def _forest(percent: int, exact: bool):
    """Per group: a forest (a, b) over the components of its rows, of pairs that
    pass the bitmaps and, if ``exact``, whose arrays overlap enough."""
    def run(key, pdf):
        edges, two = [], key[1] != key[2]
        code = np.unique(pdf["at"].to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        n, comp, own = pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["own"].to_numpy().astype(bool)
        left = pdf["s"].to_numpy() == key[1]
        for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            root = np.unique(comp[at], return_inverse=True)[1]
            if len(at) < 2 or not root.any():
                continue
            sizes = n[at]
            maps = Maps([np.frombuffer(b, dtype=np.uint64) for b in pdf["bits"].iloc[at]], sizes, percent)
            sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["hashes"].iloc[at]] if exact else None
            for i in range(len(at) - 1):
                js = np.flatnonzero(root[i + 1:] != root[i]) + i + 1
                ok = (100 * np.minimum(sizes[i], sizes[js]) >= percent * np.maximum(sizes[i], sizes[js])) & (own[at[i]] | own[at[js]])
                if two:
                    ok &= left[at[i]] != left[at[js]]
                js = js[ok]
                for j in maps.possible(i, js) if len(js) else ():
                    if root[i] != root[j] and (not exact or overlap(sets[i], sets[j]) >= needed(sizes[i], sizes[j], percent)):
                        edges.append((comp[at[i]], comp[at[j]]))
                        root[root == root[j]] = root[i]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
    return run


def _linked(cells: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(node, label) of the components that the forests of all groups join."""
    rows = cells.withColumn("at", F.xxhash64("tile")).drop("tile")
    edges = rows.groupBy("cell", "lo", "hi").applyInPandas(_forest(percent, exact), "a long, b long")
    return connected_components(written(edges, "jaccard_links"))


def similar_sets(points: DataFrame, prefixes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(rid, comp) of the points that link with another one."""
    rows = written(tiles(prefixes, percent), "jaccard_rows")
    cells = _cells(rows, 0.5).withColumn("comp", F.col("rid")).join(points.select("rid", "bits"), "rid")
    near = written(_linked(cells, percent, exact=False), "jaccard_candidates")

    group = near.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    asked = near.join(group, "label").select(F.col("node").alias("rid"), F.col("label").alias("tile"), "c")
    asked = asked.join(points.select("rid", "n", "key", "digest"), "rid")
    size = asked.groupBy("tile").agg(F.sum("n").alias("total"))
    asked = written(asked.join(size, "tile").withColumn("own", F.lit(True)), "jaccard_asked")
    texts = docs.join(asked.select("rid", "key", "digest").hint("merge"), "key").select("key", "rid", "digest", "text").dropDuplicates(["key", "rid"])
    arrays = written(texts.mapInPandas(_arrays(n), "rid long, hashes binary, bits binary"), "jaccard_arrays")

    # blocks of a component share a few documents: most large groups are joined here
    rows = asked.select("tile", "c", "total", "own", "rid", "n", F.col("rid").alias("comp"))
    first = _linked(_cells(rows, 8.5, paired=False).join(arrays, "rid"), percent, exact=True)
    comp = written(rows.select("rid").join(first.select(F.col("node").alias("rid"), "label"), "rid", "left")
                   .select("rid", F.coalesce("label", "rid").alias("comp")), "jaccard_first")
    # components of several blocks that still hold separate documents: all block pairs
    rows = rows.drop("comp").join(comp, "rid").filter((F.col("c") > BLOCK_ROWS) | (F.col("total") * 8.5 > BLOCK_BYTES))
    open_ = rows.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("tile")
    rows = written(rows.join(open_, "tile"), "jaccard_open")
    if rows.isEmpty():
        return comp
    second = _linked(_cells(rows, 8.5).join(arrays, "rid"), percent, exact=True)
    return (comp.join(second.withColumnRenamed("node", "comp"), "comp", "left")
            .select("rid", F.coalesce("label", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    bounded_batches(docs.sparkSession)
    late = frequent(docs, n)
    described = docs.select("doc_id", "key", _described(late, n, percent)("text").alias("m")).select("doc_id", "key", "m.*")
    sets = written(described.withColumn("row", F.monotonically_increasing_id()), "jaccard_sets")
    some = sets.filter("n > 0").groupBy("digest")
    points = written(some.agg(F.min("row").alias("rid"), F.first("n").alias("n"), F.first("bits").alias("bits"),
                              F.min_by("key", "row").alias("key")), "jaccard_points")
    prefixes = some.agg(F.min("row").alias("rid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    comps = similar_sets(points, prefixes, docs.select("key", "text"), n, percent)
    ids = sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    member = (ids.join(points.select("digest", "rid"), "digest").join(comps, "rid", "left")
              .select("digest", "first_id", F.coalesce("comp", "rid").alias("comp")))
    smallest = member.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    linked = written(member.join(smallest, "comp").select("digest", "component_id"), "jaccard_components")
    return (sets.select("doc_id", "n", "digest").join(linked, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
