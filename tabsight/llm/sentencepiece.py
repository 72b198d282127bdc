"""SentencePiece encoding and decoding over a relational lattice (operator 1).

Encoding.  A text falls into words (a word keeps the spaces before it, as the
normaliser's U+2581).  All words of all documents are counted (tasks cut texts
at spaces, then each distinct chunk into words, and shuffle sums); the most
frequent ones, at most ``TABLE_WORDS`` (a fixed bound, so the result can be
broadcast), are exploded into substrings of bounded length, which are
equi-joined to the piece table; the matches of a word are its lattice edges,
grouped by word, and a higher-order ``aggregate`` folds them into the word's
ids.  Documents then take their ids from that word table in the scan: texts
are never shuffled.  Words outside the table (rare ones, and those above
``LONG`` code points, for which an array fold is quadratic) are folded in the
task over the same piece table, by the same rules, each once per batch at most.

Two folds over the same lattice:

* unigram models: Viterbi, the best sum of piece scores at every position;
* BPE models (the public ``piece_bpe_32k`` is one): the best-scoring adjacent
  pair is merged, leftmost first, until no pair is a piece.  For them Viterbi
  does not give the tokenizer's ids, see the README.

Words never interact: a piece holds U+2581 only at its start, never a line
break (checked when the model is read), and never a letter followed by one of
the marks at which words are cut.

Decoding joins the bytes of the pieces (one lookup per id).

Defined cases: null and empty texts have no ids and decode to an empty text;
characters without a piece become byte pieces; a U+2581 in a text decodes as a
space; equal rows each get a row; an empty table gives an empty result.
"""
from __future__ import annotations

import heapq
import re
import string
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import (any_of, bounded_batches, free_name, id_lists, ids_of_texts, per_process, slices_of,
                                 strings_of, written)

TABLE_WORDS = 1 << 18
MEMO_WORDS = 120_000
COUNT_WORDS = 300_000     # words that a task counts before it passes them on
SLICE_ROWS = 500
SLICE_BYTES = 5 << 19      # of text that a task encodes at once
LONG = 64
WIDTH = 128          # edge key: start * WIDTH + length
SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
NORMAL, BYTE = 1, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class PieceModel:
    """The piece table of a model file."""
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    pattern: str
    longest: int

    @staticmethod
    def load(path: str | None = None, proto: bytes | None = None) -> "PieceModel":
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        if proto is None:
            with open(path or default_model(), "rb") as f:
                proto = f.read()
        m.ParseFromString(proto)
        pieces = tuple((p.piece, p.score, p.type) for p in m.pieces)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type not in (UNIGRAM, BPE) or not m.trainer_spec.byte_fallback:
            raise ValueError("unigram and BPE models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if any(t in (4, 5) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = [p for p, _, t in pieces if t == NORMAL]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("a piece crosses a word border")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal):
            raise ValueError("a piece joins several spaces with a word")
        follows = set(re.findall(rf"[{LETTERS}](?=([^\w\s]))", "\n".join(normal)))
        marks = "".join(re.escape(c) for c in string.punctuation if c != "_" and c not in follows)
        cut = f"{SPACE}*+[{LETTERS}]++(?=[{marks}])|" if marks else ""     # possessive: no way back into a word
        return PieceModel(pieces, m.trainer_spec.model_type, f"{cut}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n",
                          max(map(len, normal)))

    @property
    def byte_base(self) -> int:
        base = next(i for i, p in enumerate(self.pieces) if p[2] == BYTE)
        if [p[0] for p in self.pieces[base:base + 256]] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("byte pieces are not in order")
        return base

    def priorities(self) -> dict[str, tuple[int, int, float]]:
        """piece -> (merge priority, id, score); equal scores share a priority."""
        normal = [(s, p, i) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL]
        rank = {s: r for r, s in enumerate(sorted({s for s, _, _ in normal}))}
        return {p: (rank[s], i, s) for s, p, i in normal}

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table: (piece, edge, score), edge = priority * 2^20 + id."""
        rows = [(p, (r << 20) | i, float(s)) for p, (r, i, s) in self.priorities().items()]
        return spark.createDataFrame(rows, "piece string, edge long, score double")


# ------------------------------------------------------------------ the words

def words_of(text: Column, model: PieceModel) -> Column:
    normal = F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))
    return F.when(F.length(text) > 0, F.regexp_extract_all(normal, F.lit(model.pattern), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))


def lattice(words: DataFrame, model: PieceModel, keys: list[str]) -> DataFrame:
    """Edges of each word: (keys, word, edges: map of start * WIDTH + length to
    edge, scores alike).  ``words`` has ``keys`` and ``word``, distinct."""
    rows = words.filter(F.length("word") <= LONG)
    size = F.length("word")
    rows = rows.select(*keys, "word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    room = F.least(F.lit(model.longest), F.length("word") - F.col("at") + 1)
    rows = rows.select(*keys, "word", "at", F.explode(F.sequence(F.lit(1), room)).alias("n"))
    rows = rows.select(*keys, "word", ((F.col("at") - 1) * WIDTH + F.col("n")).alias("key"),
                       F.col("word").substr(F.col("at"), F.col("n")).alias("piece"))
    pieces = F.broadcast(model.table(words.sparkSession))     # the vocabulary: fixed by the model file
    found = rows.join(pieces, "piece")
    return found.groupBy(*keys, "word").agg(F.map_from_entries(F.collect_list(F.struct("key", "edge"))).alias("edges"),
                                            *([F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("scores")]
                                              if model.kind == UNIGRAM else []))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _edge(start: Column, end: Column) -> Column:
    return F.try_element_at(F.col("edges"), start * WIDTH + (end - start))


def _byte_ids(ch: Column, base: int) -> Column:
    code = F.hex(F.encode(ch, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), F.octet_length(ch) - 1),
                       lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + base)


def _ids_of(bounds: Column, model: PieceModel) -> Column:
    """Ids of the segments between consecutive bounds of ``word``."""
    def one(start, end):
        ch = F.col("word").substr(start + 1, F.lit(1))
        return _let(_edge(start, end), lambda e: F.when(e.isNull(), _byte_ids(ch, model.byte_base)).otherwise(
            F.array((e % (1 << 20)).cast("int"))))
    n = F.size(bounds) - 1
    return F.flatten(F.transform(F.slice(bounds, F.lit(1), n),
                                 lambda start, j: one(start, F.element_at(bounds, j + 2))))


def bpe_ids(model: PieceModel) -> Column:
    """Merge fold.  State: segment bounds ``b`` and the merge priority ``p`` of
    each adjacent pair (-1 where the pair is no piece)."""
    size = F.length("word")

    def look(start, end):
        return F.coalesce(F.shiftright(_edge(start, end), 20), F.lit(-1).cast("long"))

    b0 = F.sequence(F.lit(0), size)
    p0 = F.when(size >= 2, F.transform(F.sequence(F.lit(0), size - 2), lambda j: look(j, j + 2))) \
        .otherwise(F.array().cast("array<bigint>"))

    def merged(b, p, i):
        at = lambda k: F.element_at(b, k)
        none = F.array().cast("array<bigint>")
        left = F.when(i >= 2, F.array(look(at(F.greatest(i - 1, F.lit(1))), at(i + 2)))).otherwise(none)
        right = F.when(i + 3 <= F.size(b), F.array(look(at(i), at(F.least(i + 3, F.size(b)))))).otherwise(none)
        return F.struct(
            F.concat(F.slice(b, F.lit(1), i), F.slice(b, i + 2, F.size(b))).alias("b"),
            F.concat(F.slice(p, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right,
                     F.slice(p, i + 2, F.size(p) + 1)).alias("p"))

    def step(s, _):
        best = F.coalesce(F.array_max(s["p"]), F.lit(-1).cast("long"))
        return _let(best, lambda top: F.when(top < 0, s).otherwise(
            _let(F.array_position(s["p"], top).cast("int"), lambda i: merged(s["b"], s["p"], i))))

    steps = F.when(size >= 2, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(steps, F.struct(b0.alias("b"), p0.alias("p")), step)
    return _let(done["b"], lambda b: _ids_of(b, model))


def viterbi_ids(model: PieceModel) -> Column:
    """Viterbi fold.  State: the best score ``s`` of every prefix and the start
    ``f`` of its last piece; an unknown character costs the lowest score - 10."""
    size = F.length("word")
    unknown = F.lit(min(s for _, s, t in model.pieces if t == NORMAL) - 10.0)

    def step(state, end):
        starts = F.sequence(F.greatest(end - model.longest, F.lit(0)), end - 1)

        def reach(start):
            own = F.try_element_at(F.col("scores"), start * WIDTH + (end - start))
            score = F.coalesce(own, F.when(end - start == 1, unknown))
            # ties go to the longer last piece
            return F.struct((F.element_at(state["s"], start + 1) + score).alias("s"), (-start).alias("f"))

        best = F.array_max(F.filter(F.transform(starts, reach), lambda r: r["s"].isNotNull()))
        return _let(best, lambda r: F.struct(F.array_append(state["s"], r["s"]).alias("s"),
                                             F.array_append(state["f"], -r["f"]).alias("f")))

    zero = F.struct(F.array(F.lit(0.0)).alias("s"), F.array(F.lit(-1)).alias("f"))
    done = F.aggregate(F.sequence(F.lit(1), size), zero, step)

    def back(f):
        bounds = F.aggregate(F.sequence(F.lit(1), size), F.array(size),
                             lambda b, _: F.when(F.element_at(b, 1) <= 0, b).otherwise(
                                 F.concat(F.array(F.element_at(f, F.element_at(b, 1) + 1)), b)))
        return _let(bounds, lambda b: _ids_of(b, model))
    return _let(done["f"], back)


def encode_words(words: DataFrame, model: PieceModel, keys: list[str] | None = None) -> DataFrame:
    """(keys, word, ids) of distinct words up to ``LONG`` code points that
    have at least one edge."""
    keys = keys or []
    ids = viterbi_ids(model) if model.kind == UNIGRAM else bpe_ids(model)
    return lattice(words, model, keys).select(*keys, "word", ids.alias("ids"))


class OtherWords:
    """The same folds for single words outside the table."""

    def __init__(self, model: PieceModel):
        self.model, self.table, self.base = model, model.priorities(), model.byte_base
        self.rank = {p: r for p, (r, _, _) in self.table.items()}
        self.low = min(s for _, _, s in self.table.values()) - 10.0

    def _segments(self, parts) -> list[int]:
        out = []
        for p in parts:
            known = self.table.get(p)
            out += [known[1]] if known else [b + self.base for b in p.encode("utf-8", "surrogatepass")]
        return out

    def encode(self, word: str) -> list[int]:
        return self._segments(self._bpe(word) if self.model.kind == BPE else self._viterbi(word))

    def _bpe(self, word: str) -> list[str]:
        n = len(word)
        part = list(word)
        if n <= LONG:
            rank = self.rank.get
            pairs = [rank(word[i:i + 2], -1) for i in range(n - 1)]
            while pairs and (best := max(pairs)) >= 0:
                i = pairs.index(best)
                part[i] = both = part[i] + part[i + 1]
                del part[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = rank(part[i - 1] + both, -1)
                if i < len(pairs):
                    pairs[i] = rank(both + part[i + 1], -1)
            return part
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def push(i):
            j = nxt[i]
            if j < n:
                known = self.table.get(part[i] + part[j])
                if known:
                    heapq.heappush(heap, (-known[0], i, j, part[i] + part[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or nxt[i] != j or part[j] is None or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [p for p in part if p is not None]

    def _viterbi(self, word: str) -> list[str]:
        n = len(word)
        score, start = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.model.longest), e):
                known = self.table.get(word[s:e])
                x = score[s] + (known[2] if known else self.low if e - s == 1 else float("-inf"))
                if x > score[e]:
                    score[e], start[e] = x, s
        out, e = [], n
        while e:
            out.append(word[start[e]:e])
            e = start[e]
        return out[::-1]


# ------------------------------------------------------------------ documents

def joined_words(texts: pa.Array) -> np.ndarray:
    """Texts whose words may reach over a single space (Arrow): two spaces in a
    row, one at the start (after the dummy one), a U+2581 of the text's own.  Empty ones, without words, too."""
    bare = pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    return any_of(texts, "  ", SPACE) | bare


def split_text(split: re.Pattern, text: str) -> list[str]:
    """The words of a whole text."""
    return split.findall(SPACE + text.replace(" ", SPACE)) if text else []


def word_counts(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, words up to ``LONG`` code points."""
    bounded_batches(docs.sparkSession)
    pattern = model.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = re.compile(pattern), Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            words, n = pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return slices_of(pa.RecordBatch.from_arrays([words, n], ["word", "n"]), 10_000)

        for batch in batches:
            texts = batch[0]
            odd = joined_words(texts)
            chunks = pc.split_pattern(texts.filter(pa.array(~odd)), " ").flatten().value_counts()
            for chunk, n in zip(strings_of(chunks.field("values")), chunks.field("counts").to_numpy().tolist()):
                for word in split.findall(SPACE + chunk):
                    if len(word) <= LONG:
                        counts[word] += n
            for text in strings_of(texts.filter(pa.array(odd))):
                counts.update(w for w in split_text(split, text) if len(w) <= LONG)
            if len(counts) > COUNT_WORDS:
                yield from passed_on()
        yield from passed_on()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(text.alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, model: PieceModel, text_col: str = "text", most: int = TABLE_WORDS) -> DataFrame:
    """(word, ids) of the most frequent words, at most ``most``: all words
    above the smallest count that keeps within the bound."""
    counts = written(word_counts(docs, model, text_col).filter("n > 1"), "sp_counts")
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    running = F.sum("words").over(Window.orderBy(F.col("n").desc()))       # one row per distinct count
    least = levels.withColumn("running", running).filter(F.col("running") <= most).agg(F.min("n").alias("n")).first()["n"]
    chosen = counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)
    spread = 8 * docs.sparkSession.sparkContext.defaultParallelism
    return written(encode_words(chosen.select("word").repartition(spread, "word"), model), "sp_words")


class _Words(dict):
    """The word table and a bounded number of other words that tasks have folded."""

    def __init__(self, table: pa.Table, model: PieceModel):
        ids = table["ids"].combine_chunks()
        held, at = ids.flatten().to_numpy().astype(np.int32).tobytes(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
        super().__init__(zip(strings_of(table["word"]), (held[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))))
        self.other, self.split, self.most = OtherWords(model), re.compile(model.pattern), len(self) + MEMO_WORDS

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.other.encode(word)).tobytes()
        if len(word) <= LONG and len(self) < self.most:
            self[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text between two spaces."""
        known = self.get(SPACE + chunk)
        return b"".join(map(self.__getitem__, self.split.findall(SPACE + chunk))) if known is None else known

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split_text(self.split, text)))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return ids_of_texts(texts, joined_words(texts), self.text, self.chunk, self.chunk)


def encode(docs: DataFrame, model: PieceModel | None = None, text_col: str = "text",
           keep: list[str] | None = None, ids_name: str = "ids", most: int = TABLE_WORDS,
           verify: str | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) and the ids of the text.
    ``verify`` names a boolean column: the ids were decoded again in the task
    and give the text (spaces for U+2581)."""
    bounded_batches(docs.sparkSession)
    model = model or PieceModel.load()
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    texts = free_name(docs, "sp_text")
    # at most ``most`` words of at most LONG code points, as Arrow columns: rows would fill the driver
    rows = word_table(docs, model, text_col, most).toArrow()
    table, run_id = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids_name, T.ArrayType(T.IntegerType())),
                           *([T.StructField(verify, T.BooleanType())] if verify else [])])
    back = piece_bytes(model) if verify else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process("sentencepiece", run_id, lambda: _Words(table.value, model))
        pieces = pa.array(back, pa.large_binary())
        for batch in batches:
            for part in slices_of(batch, max(1, batch.num_rows * SLICE_BYTES // max(1, batch[texts].nbytes))):
                ids, before = words.batch(part[texts])
                columns = [*(part[c] for c in keep), id_lists(ids, before)]
                if verify:
                    columns.append(pa.array(gives_texts(ids, before, pieces, back, part[texts])))
                # small results: ids are larger than the text
                yield from slices_of(pa.RecordBatch.from_arrays(columns, names=schema.names), SLICE_ROWS)

    src = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(texts))
    return src.mapInArrow(run, schema)


def gives_texts(ids: np.ndarray, before: np.ndarray, pieces: pa.Array, back: list[bytes], texts: pa.Array) -> list[bool]:
    """Whether each text's ids decode to it: the bytes of all ids of a batch are
    put together at once; where they differ from the text's, it is decoded alone."""
    taken = pieces.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)[before].tolist()
    whole = taken.buffers()[2].to_pybytes() if at[-1] else b""

    def same(i: int, text: str) -> bool:
        got = whole[at[i]:at[i + 1]]
        return (got[1:] if got[:1] == b" " else got) == text.encode() \
            or text_of(ids[before[i]:before[i + 1]], back) == text.replace(SPACE, " ")

    return [same(i, t) for i, t in enumerate(strings_of(texts))]


def piece_bytes(model: PieceModel) -> list[bytes]:
    """What each id stands for."""
    def one(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode() if kind == NORMAL else b"" if kind == 3 else " \u2047 ".encode()
    return [one(p, t) for p, _, t in model.pieces]


def text_of(ids, table: list[bytes]) -> str:
    """Text of one row's ids: their bytes, the dummy space dropped."""
    whole = b"".join(map(table.__getitem__, ids.tolist()))
    return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def decoded(ids: Column, model: PieceModel | None = None) -> Column:
    """Text of an id array; null ids decode to an empty text."""
    table = piece_bytes(model or PieceModel.load())

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        return pd.Series(["" if v is None else text_of(v, table) for v in values], dtype=object)

    return text(ids)
