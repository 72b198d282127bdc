"""Shared helpers of the training-data operators: table paths, word rules,
written intermediate tables and connected components."""
from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.session import cut_lineage, scratch_path, table_path

# The word rule of the contracts: runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
PART_ROWS = 250_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as an empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so later
    readers (and retries after a lost executor) start from files."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    held = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")       # the files are the result: its shuffles may go at once
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (inputs may carry any extra columns)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def per_process(name: str, key, make):
    """One object per Python worker, kept between its tasks (functions travel
    by value, so globals of their modules do not last).  Another ``key``
    replaces it."""
    state = sys.modules.setdefault("tabsight_worker_state", ModuleType("tabsight_worker_state"))
    held = state.__dict__.get(name)
    if held is None or held[0] != key:
        held = None
        state.__dict__.pop(name, None)      # the old object goes before the new one is made
        gc.collect()
        held = (key, make())
        state.__dict__[name] = held
    return held[1]


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most ``BATCH_BYTES`` (Spark
    counts rows only, and ten thousand long texts fill a worker)."""
    held = (spark.conf.get(_BATCH) or "").rstrip("bB")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def batches_of(frames: Iterator, rows: int):
    """Cut each pandas frame into slices of at most ``rows`` rows."""
    for pdf in frames:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i:i + rows]


def strings_of(texts: pa.Array | pa.ChunkedArray) -> list[str]:
    """Arrow texts as a list (``to_pylist`` makes a scalar of each first)."""
    return (texts.to_numpy(zero_copy_only=False) if isinstance(texts, pa.Array) else texts.to_numpy()).tolist()


def any_of(texts: pa.Array, *parts: str) -> np.ndarray:
    """Which Arrow texts hold one of ``parts``."""
    return pc.match_substring_regex(texts, "|".join(map(re.escape, parts))).to_numpy(zero_copy_only=False)


def ids_of_texts(texts: pa.Array, odd: np.ndarray, whole, first, rest, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch of Arrow texts, one text after the other, and the number of ids before each text.

    Texts are cut at every space.  A distinct chunk is looked up once a batch:
    ``rest`` gives its ids as int32 bytes, ``first`` those of the chunk that opens
    a text.  ``odd`` texts are no sequence of such chunks and go to ``whole``.
    ``end`` follows each text."""
    n = len(texts)
    cut = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), " ")     # an odd text: one chunk
    places, at = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
    coded = places.dictionary_encode()
    entries = [rest(c) for c in strings_of(coded.dictionary)]
    codes = coded.indices.to_numpy().astype(np.int64)
    codes[at[:-1]] = len(entries) + np.arange(n)
    entries += [whole(texts[i].as_py()) if odd[i] else first(c) for i, c in enumerate(strings_of(places.take(pa.array(at[:-1]))))]
    if end:
        codes = np.insert(codes, at[1:], len(entries))
        entries.append(end)
        at = at + np.arange(n + 1)
    taken = pa.array(entries, pa.large_binary()).take(pa.array(codes))
    before = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1) // 4
    ids = np.frombuffer(taken.buffers()[2], dtype=np.int32, count=before[-1]) if before[-1] else np.empty(0, np.int32)
    return ids, before[at]


def id_lists(ids: np.ndarray, before: np.ndarray) -> pa.Array:
    """The ids of each text as an Arrow list."""
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids))


def slices_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``rows`` rows."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``; the label is the
    smallest node of its component.

    Each round every root hooks to its smallest smaller neighbour, the links
    are followed twice, and the edges are contracted to the new roots, so the
    edge table shrinks until it is empty.  All state is tables in the shared
    checkpoint folder; only the count of remaining edges reaches the driver.
    The tables of a round go to as many files as its edges fill (``PART_ROWS``
    each, two a core at least), however many shuffle partitions there are.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def kept(df: DataFrame, rows: int) -> DataFrame:
        return cut_lineage(df.coalesce(max(2 * cores, -(-rows // PART_ROWS))))

    edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"),
                                                      F.greatest("a", "b").alias("b")).distinct())
    first = n = edges.count()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = kept(nodes.select("node", F.col("node").alias("label")), 2 * first)
    for _ in range(max_rounds):
        if not n:
            return labels
        # b > a on every edge: each b hooks to its smallest neighbour below it
        hook = kept(edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up")), n)
        for _ in range(2):
            up = hook.select(F.col("root").alias("up"), F.col("up").alias("up2"))
            hook = hook.join(up, "up", "left").select("root", F.coalesce("up2", "up").alias("up"))
        hook = kept(hook, n)
        labels = kept(labels.join(hook.withColumnRenamed("root", "label"), "label", "left")
                      .select("node", F.coalesce("up", "label").alias("label")), 2 * first)
        ha = hook.select(F.col("root").alias("a"), F.col("up").alias("ua"))
        hb = hook.select(F.col("root").alias("b"), F.col("up").alias("ub"))
        mapped = (edges.join(ha, "a", "left").join(hb, "b", "left")
                  .select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")))
        edges = kept(mapped.filter("x <> y").select(F.least("x", "y").alias("a"),
                                                    F.greatest("x", "y").alias("b")).distinct(), n)
        n = edges.count()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
