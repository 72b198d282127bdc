"""Ranked lexical search over bit-sliced Bloom signatures (operator 11).

Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased.  A document's score for an item sums, over the item's terms
(repeats included), w * ((10^9 tf) div (1000 tf + 12 m)) in 64-bit integers,
with w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 75 + ((25 n N) div L).

Index (one scan of the documents, independent of any item).  Documents of
similar vocabulary size share a block.  A document's signature holds each of
its terms, and the term once more for every level of ``LEVELS`` that its
frequency reaches.  A block stores its signatures transposed: one slice per
signature bit, one bit per document.  The same scan counts the documents of
every term.

Search.  ANDing the slices of a term gives the documents that may hold it; the
ANDed slices of its levels bound its frequency.  Weighted by w these bounds
add up to an upper bound of every document's score, never below the score.
The best bounds of each item are scored exactly first; their k-th best score
excludes every document whose bound is smaller, and all others are scored
exactly from their whole texts.

Items are taken in blocks (``ITEMS`` items or ``ITEM_TERMS`` distinct terms),
so what a task holds of them is bounded; documents never reach the driver.

Defined cases: null, empty and termless texts are no documents and no items;
repeated rows count as separate documents; items with equal ids are ranked
separately; null document ids come last among equal scores; an empty table
gives an empty result; very long texts only widen their block's signatures, up
to ``MOST_BITS`` (beyond that bounds are looser, results the same).
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import bounded_batches, free_name, written

LEVELS = [1, 2, 3, 5, 9, 17, 33, 65, 129]    # a level is held where the frequency reaches it
HASHES = 4                                   # bits of an entry
LEAST_BITS, MOST_BITS = 512, 1 << 20         # bits of a signature
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 20    # a block ends at either
VOCABULARY = 200_000                         # terms a task counts before it hands them on
ITEMS, ITEM_TERMS = 512, 1 << 17             # a block of items ends at either
SEEDS = 32                                   # documents of an item that are scored first, over k at least

# Everything but ASCII letters, digits and bytes beyond ASCII ends a term.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LEVEL_STEPS = np.arange(len(LEVELS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(entries x HASHES) bits of a signature, by double hashing."""
    z = hashes ^ (hashes >> np.uint64(31))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(29)
    step = (z >> np.uint64(32)) | np.uint64(1)
    return ((z[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def signature_bits(entries: int) -> int:
    """8 bits an entry, in steps of four."""
    bits = LEAST_BITS
    while bits < 8 * entries and bits < MOST_BITS:
        bits *= 4
    return min(bits, MOST_BITS)


# ---------------------------------------------------------------- index

class _Block:
    def __init__(self, bits: int):
        self.bits, self.keys, self.sizes, self.hashes, self.docs, self.entries = bits, [], [], [], [], 0

    def add(self, key: int, n: int, hashes: np.ndarray):
        self.docs.append(np.full(len(hashes), len(self.keys), dtype=np.int64))
        self.hashes.append(hashes)
        self.keys.append(key)
        self.sizes.append(n)
        self.entries += len(hashes)

    def row(self) -> pa.RecordBatch:
        width = -(-len(self.keys) // 8)
        slices = np.zeros(self.bits * width, dtype=np.uint8)
        doc = np.concatenate(self.docs)
        at = positions(np.concatenate(self.hashes), self.bits)
        bit = (np.uint8(1) << (doc & 7).astype(np.uint8))
        for j in range(HASHES):
            np.bitwise_or.at(slices, at[:, j] * width + (doc >> 3), bit)
        return _batch(bits=[self.bits], keys=[np.array(self.keys, dtype="<i8").tobytes()],
                      sizes=[np.array(self.sizes, dtype="<i8").tobytes()], slices=[slices.tobytes()],
                      n_docs=[len(self.keys)], n_terms=[int(sum(self.sizes))])


_INDEX = "term binary, df long, bits long, keys binary, sizes binary, slices binary, n_docs long, n_terms long"


def _batch(**columns) -> pa.RecordBatch:
    """Rows of the index; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    fields = [c.split() for c in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields],
                                      names=[c for c, _ in fields])


def _build(batches):
    """Term counts and signature blocks of a task's documents."""
    df, hash_of, blocks = Counter(), {}, {}
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            text = text.as_py()
            words = terms(text)
            if not words:
                continue
            count = Counter(words)
            df.update(count.keys())
            for w in [w for w in count if w not in hash_of]:
                hash_of[w] = digest(w)
            h = np.fromiter(map(hash_of.__getitem__, count), np.uint64, len(count))
            tf = np.fromiter(count.values(), np.int64, len(count))
            entries = [h]
            for level, add in zip(LEVELS[1:], _LEVEL_STEPS[1:]):
                more = h[tf >= level]
                if not len(more):
                    break
                entries.append(more + add)
            entries = np.concatenate(entries)
            bits = signature_bits(len(entries))
            block = blocks.setdefault(bits, _Block(bits))
            block.add(key, len(words), entries)
            if len(block.keys) >= BLOCK_DOCS or block.entries >= BLOCK_ENTRIES:
                yield blocks.pop(bits).row()
            if len(df) >= VOCABULARY:
                yield _batch(term=list(df), df=list(df.values()))
                df, hash_of = Counter(), {}
    for block in blocks.values():
        yield block.row()
    if df:
        yield _batch(term=list(df), df=list(df.values()))


class Index:
    """Signature blocks and document frequencies of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        bounded_batches(docs.sparkSession)
        text = F.col(text_col).cast("string")
        self.docs = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"))
        rows = written(self.docs.select("key", "text").mapInArrow(_build, _INDEX), "ranked_index")
        self.blocks = rows.filter("n_docs is not null").select("bits", "keys", "sizes", "slices", "n_docs", "n_terms")
        self.counted = rows.filter("df is not null").select("term", "df")
        total = self.blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        self.n_docs, self.n_terms = total["n"] or 0, total["l"] or 0

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(term, df) of the terms of ``asked``."""
        return self.counted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


# ---------------------------------------------------------------- bounds

class Asked:
    """A bounded block of items: the weight of every term for every item."""

    def __init__(self, rows, n_docs: int, n_terms: int):
        """``rows`` of (item, term, times, df)."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = sorted({r[0] for r in rows})
        self.by_item: dict[int, list[tuple[bytes, int]]] = {}
        at, by_term = {q: i for i, q in enumerate(self.items)}, {}
        for q, term, times, df in rows:
            w = times * weight(n_docs, df)
            if w > 0:
                self.by_item.setdefault(q, []).append((term, w))
                by_term.setdefault(term, []).append((at[q], w))
        self.terms = sorted(by_term)
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], dtype=np.uint64)
        self.uses = [by_term[t] for t in self.terms]

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return 75 + 25 * sizes * self.n_docs // self.n_terms

    def bounds(self, bits: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """(items x documents) upper bounds of the scores of one block."""
        n = len(sizes)
        table = np.frombuffer(slices, dtype=np.uint8).reshape(bits, -1)
        m = self.lengths(sizes)
        # the most a term can give where its frequency reaches a level but not the next
        most = [np.minimum(sizes, above - 1) for above in LEVELS[1:]] + [sizes]
        gain = [10 ** 9 * tf // (1000 * tf + 12 * m) for tf in most]
        at = [positions(self.hashes + step, bits) for step in _LEVEL_STEPS]
        out = np.zeros((len(self.items), n), dtype=np.int64)
        for t, uses in enumerate(self.uses):
            held = np.bitwise_and.reduce(table[at[0][t]], axis=0)
            if not held.any():
                continue
            docs = np.flatnonzero(np.unpackbits(held, bitorder="little", count=n))
            value, reach = gain[0][docs], np.arange(len(docs))
            for level in range(1, len(LEVELS)):
                held = held & np.bitwise_and.reduce(table[at[level][t]], axis=0)
                if not held.any():
                    break
                reach = reach[np.unpackbits(held, bitorder="little", count=n)[docs[reach]].astype(bool)]
                value[reach] = gain[level][docs[reach]]
            for i, w in uses:
                out[i, docs] += w * value
        return out

    def score(self, item: int, count: Counter, m: int) -> int:
        return sum(w * (10 ** 9 * count[t] // (1000 * count[t] + 12 * m)) for t, w in self.by_item.get(item, ()) if t in count)


def _unpacked(frames):
    for pdf in frames:
        for bits, keys, sizes, slices in zip(pdf["bits"], pdf["keys"], pdf["sizes"], pdf["slices"]):
            yield int(bits), np.frombuffer(keys, dtype="<i8"), np.frombuffer(sizes, dtype="<i8"), slices


def _best_bounds(asked: Asked, most: int):
    """Per task and item the ``most`` documents with the largest bounds."""
    def run(frames):
        n = len(asked.items)
        bound, key = np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0), dtype=np.int64)
        for bits, keys, sizes, slices in _unpacked(frames):
            bound = np.concatenate([bound, asked.bounds(bits, sizes, slices)], axis=1)
            key = np.concatenate([key, np.broadcast_to(keys, (n, len(keys)))], axis=1)
            if bound.shape[1] > most:
                top = np.argpartition(-bound, most - 1, axis=1)[:, :most]
                bound, key = np.take_along_axis(bound, top, axis=1), np.take_along_axis(key, top, axis=1)
        rows, cols = np.nonzero(bound > 0)
        yield pd.DataFrame({"item": np.array(asked.items, dtype=np.int64)[rows], "key": key[rows, cols], "bound": bound[rows, cols]})
    return run


def _reaching(asked: Asked, theta: dict[int, int]):
    """Every (item, document) whose bound reaches the item's threshold."""
    least = np.array([max(1, theta.get(q, 1)) for q in asked.items], dtype=np.int64)[:, None]
    items = np.array(asked.items, dtype=np.int64)

    def run(frames):
        for bits, keys, sizes, slices in _unpacked(frames):
            rows, cols = np.nonzero(asked.bounds(bits, sizes, slices) >= least)
            yield pd.DataFrame({"item": items[rows], "key": keys[cols]})
    return run


def _scored(texts: DataFrame, asked: Asked) -> DataFrame:
    """(item, doc_id, key, score) of rows (doc_id, key, text, asks array<long>)."""
    def run(frames):
        for pdf in frames:
            out = []
            for doc, key, text, asks in zip(pdf["doc_id"], pdf["key"], pdf["text"], pdf["asks"]):
                words = terms(text)
                count, m = Counter(words), int(asked.lengths(np.array([len(words)]))[0])
                out += [(int(q), doc, key, s) for q in asks if (s := asked.score(int(q), count, m)) > 0]
            yield pd.DataFrame(out, columns=["item", "doc_id", "key", "score"]).astype({"doc_id": pdf["doc_id"].dtype})

    kind = texts.schema["doc_id"].dataType
    text_id = F.col("doc_id").cast("string").alias("doc_id")      # ids beyond 2^53 beside nulls stay exact
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.StringType()),
                           T.StructField("key", T.LongType()), T.StructField("score", T.LongType())])
    got = texts.select(text_id, "key", "text", "asks").mapInPandas(run, schema)
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(index: Index, asked: Asked, k: int) -> DataFrame:
    """The k best documents of a block of items: (item, rank, doc_id, score)."""
    most = max(SEEDS, k)
    best = index.blocks.mapInPandas(_best_bounds(asked, most), "item long, key long, bound long")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "key")
    seeds = (best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
             .groupBy("key").agg(F.collect_set("item").alias("asks")))
    # at most ITEMS * most rows
    first = _scored(index.docs.join(F.broadcast(seeds), "key"), asked)
    kth = _top(first, k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
    theta = {r["item"]: r["s"] for r in kth.collect()}           # one row an item of the block
    reach = index.blocks.mapInPandas(_reaching(asked, theta), "item long, key long")
    asks = reach.groupBy("key").agg(F.collect_set("item").alias("asks"))
    return _top(_scored(index.docs.join(asks, "key"), asked), k).select("item", "rank", "doc_id", "score")


def _item_terms(frames):
    for pdf in frames:
        out = [(q, t, n) for q, text in zip(pdf["item"], pdf["text"]) for t, n in Counter(terms(text)).items()]
        yield pd.DataFrame(out, columns=["item", "term", "times"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item`` id, ``rank``, document id and ``score`` of each item's k best documents."""
    index = Index(docs, id_col, text_col)
    asks = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"),
                                F.col(item_text).cast("string").alias("text")), "ranked_items")
    wanted = written(asks.select("item", "text").mapInPandas(_item_terms, "item long, term binary, times long"), "ranked_terms")
    held = written(wanted.join(index.frequencies(wanted), "term"), "ranked_item_terms")
    size = held.agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("terms")).first()
    blocks = max(-(-size["items"] // ITEMS), -(-size["terms"] // ITEM_TERMS))
    found = None
    for b in range(blocks):
        mine = held.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = [(r["item"], bytes(r["term"]), r["times"], r["df"]) for r in mine.collect()]
        if not rows:
            continue
        part = _search(index, Asked(rows, index.n_docs, index.n_terms), k)
        part = written(part, "ranked_found") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        none = docs.select(F.lit(0).cast("long").alias("item"), F.lit(0).alias("rank"), F.col(id_col).alias("doc_id"),
                           F.lit(0).cast("long").alias("score"))
        found = none.limit(0)
    out = free_name(docs.select(id_col), item_col)
    return (found.join(asks.select("item", F.col("item_id").alias(out)), "item")
            .select(out, F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score"))
