"""Token-id files: Parquet list columns (operator 8).

Layout of a token folder (``<path>/tokens``): one row per document with
``row`` (file shard in the upper bits, place in the shard below: the order of
the corpus), ``doc_id``, ``n_tokens`` and ``ids``.  Ids are dictionary encoded
(at most one vocabulary per column chunk), row, doc_id and n_tokens are delta
encoded (format v2, no dictionary); row groups and pages are small, and the
page indexes let a reader fetch single documents or only the metadata columns.
``<path>/shards`` has one row per shard: documents, ids and the ids before it.

Rows are dealt by range of doc_id before they are tokenised, so the sampling
pass and the shuffle move texts, never ids, and each task writes one sorted
shard.

Encoding.  A byte-level BPE encodes chunks between white space or marks
independently (its split pattern never joins text across a chunk border), so a
task encodes each distinct chunk once with the library and looks the rest up, each
distinct word once a batch; the memory is bounded (a full table takes no more, long
chunks are never kept).
Texts with control characters on which white-space rules differ, and texts that
hold an added token of the file (``<|endoftext|>``), are encoded whole.

Defined cases: null and empty texts hold only the end id; equal doc_ids are
ordered by a hash of the text; null doc_ids come first; an empty table gives
empty files.
"""
from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import any_of, bounded_batches, id_lists, ids_of_texts, per_process, slices_of

# Chunk borders are borders of the split pattern too: white space, and a letter followed by an ASCII mark.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
CHUNK = re.compile(rf" ?[{_LETTERS}]++(?=[!-/:-@\[-`{{-~])| ?\S+|\s+(?!\S)|\s+")
_MARKS = frozenset(string.punctuation)
_UNLIKE = "\x1c\x1d\x1e\x1f\x85"   # white space for one rule set and not for the other
LONGEST_KEPT = 48
MOST_WORDS = 600_000   # frequent words come early: a full table is kept, the rest is encoded again
MOST_CHUNKS = 100_000
SLICE_ROWS = 500

SCHEMA = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other
    bytes for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder(dict):
    """chunk -> ids as little-endian int32 bytes (a fraction of a list's
    memory); encodes a chunk with a tokenizers file when it is first asked for."""

    def __init__(self, model: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(model)
        setup = json.loads(model)
        pre = setup.get("pre_tokenizer") or {}
        # an added token is cut out before the split pattern is; a normalizer may make one of any text
        added = [t["content"] for t in setup.get("added_tokens") or []]
        self.uncut = [*_UNLIKE, *(added if setup.get("normalizer") is None else [""] * bool(added))]
        # then a plain chunk is one piece, and the model may be asked directly
        self.direct = (setup.get("normalizer") is None and pre.get("type") == "ByteLevel"
                       and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        self.pieces, self.letters = self.tok.model.tokenize, _byte_letters()
        self.words = _Words(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def one(self, chunk: str) -> bytes:
        spaced = chunk[0] == " "
        if not self.direct or not (chunk[1:] if spaced else chunk).isalpha():
            return self.whole(chunk)
        # letters are one piece of the split pattern
        if not chunk.isascii():
            mapped = chunk.encode().decode("latin-1").translate(self.letters)
        else:
            mapped = self.letters[32] + chunk[1:] if spaced else chunk
        return array("i", [t.id for t in self.pieces(mapped)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk[0] == " " and chunk[1:].isalpha():
            return self.words[chunk[1:]]
        ids = self.one(chunk)
        if len(chunk) <= LONGEST_KEPT and len(self) < MOST_CHUNKS:
            self[chunk] = ids
        return ids

    def chunks(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))

    def text(self, text: str) -> bytes:
        """Ids of a text that is no sequence of words behind single spaces."""
        return self.whole(text) if any(map(text.__contains__, self.uncut)) else self.chunks(text)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        ids, before = self.batch(pa.array(texts, pa.string()))
        return (ids[a:b] for a, b in zip(before[:-1], before[1:]))

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the ids before each; without two spaces in a row every space opens a chunk."""
        return ids_of_texts(texts, any_of(texts, "  ", *self.uncut), self.text, self.chunks, self.words.__getitem__, end)


class _Words(dict):
    """word -> ids of the word with a space before it."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if not word.isalpha():      # cheap: its parts are looked up in turn
            if word[-1:] in _MARKS and word.isascii() and word[:-1].isalpha():
                return self[word[:-1]] + self.encoder[word[-1]]
            return self.encoder.chunks(" " + word)
        ids = self.encoder.one(" " + word)
        if len(word) <= LONGEST_KEPT and len(self) < MOST_WORDS:
            self[word] = ids
        return ids


def _encoded(model: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process("token_files", zlib.crc32(model.encode()), lambda: Encoder(model))
        end = np.array([end_id], dtype=np.int32).tobytes()
        for batch in batches:
            ids, before = encoder.batch(batch["text"], end)
            out = pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(before)), id_lists(ids, before)],
                                             ["doc_id", "n_tokens", "ids"])
            yield from slices_of(out, SLICE_ROWS)
    return run


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) in ascending doc_id order, one range of ids per partition."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        model = f.read()                       # the file itself travels with the tasks
    bounded_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return rows.mapInArrow(_encoded(model, end_id), "doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, row_group: int = 16 << 20, page: int = 128 << 10, **kw) -> None:
    """Write the token folder of ``docs`` at ``path``."""
    rows = encode(docs, **kw).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens", "ids")
    writer = (rows.write.option("compression", "zstd").option("parquet.writer.version", "v2")
              .option("parquet.block.size", row_group).option("parquet.page.size", page)
              .option("parquet.dictionary.page.size", 1 << 20))
    for c in ("row", "doc_id", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(f"{path}/tokens")
    meta = read_metadata(docs.sparkSession, path)
    sums = (meta.groupBy(F.shiftright("row", 33).alias("shard"))
            .agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"),
                 F.max("doc_id").alias("last_id")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)     # one row per shard
    sums.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """row, doc_id and n_tokens without touching the ids."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/tokens").select("row", "doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Ids, of all documents or of the given ones (pushed to the page indexes)."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(np.asarray(x, dtype="<u4").tobytes()) for x in ids], dtype="int64")


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` (with row and n_tokens) plus ``start``, the ids before each document."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("shard", F.shiftright("row", 33)).join(shards, "shard")
            .withColumn("start", F.col("shard_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .drop("shard", "shard_start"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = read_tokens(spark, path).select("row", "doc_id", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
    return with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
