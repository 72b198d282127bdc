"""Vector codes by slice-and-intersect bitmasks (operator 13).

Vectors become integers, floor(scale * x), and are cut into ``parts``
consecutive parts (equal ones; where the dimension is no multiple of ``parts``
the first parts hold one component more).  Each part has a codebook of at most
``entries`` entries that starts as the vectors with the smallest ids and is
refined in ``rounds`` rounds: every part goes to its nearest entry, every entry
becomes the floored mean of its parts.

Nearest entry.  Per codebook and component the entries are sorted and carry
prefix masks: bit e of mask i is set where entry e is among the first i.  An
initial radius is the distance to the better of the two entries next to the
part in the widest component; an entry farther than that in any one component
cannot be nearer.  So each component selects one range of sorted entries, the
difference of two prefix masks; the ranges of all components ANDed are the
candidates, and only those are measured (integers, ties to the lower index).

Spark keeps the vectors packed in files; a round is one scan in which a task
adds up counts and sums per entry, so only numbers per codebook entry are
shuffled and reach the driver, never rows.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part; repeated ids and rows each take part; a null id takes part and
comes last in the order of ids (equal ids by vector); fewer vectors than
``entries`` give a shorter codebook; vectors of different dimension have
codebooks of their own (at most ``MAX_DIMS`` dimensions, else an error); empty
vectors have code zero and error zero; components too large for exact 64-bit
distances are an error; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import written

MAX_DIMS = 64
SLICE = 65_536       # vectors measured at a time


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of every part."""
    each, more = divmod(dim, parts)
    ends = [each * (p + 1) + min(p + 1, more) for p in range(parts)]
    return list(zip([0, *ends[:-1]], ends))


class Codebook:
    """Entries of one part with their sorted components and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        k, d = self.entries.shape
        self.words = -(-k // 64)
        own = np.zeros((k, self.words), dtype=np.uint64)
        own[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, self.order, axis=0)
        self.prefix = []
        for j in range(d):
            masks = np.zeros((k + 1, self.words), dtype=np.uint64)
            np.bitwise_or.accumulate(own[self.order[:, j]], axis=0, out=masks[1:])
            self.prefix.append(masks)
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if d else 0

    def _distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """Largest whole distance in one component that can still be as near as
        the better neighbour in the widest component."""
        k, j = len(self.entries), self.widest
        at = np.searchsorted(self.sorted[:, j], x[:, j])
        near = np.minimum(self._distance(x, self.order[np.maximum(at - 1, 0), j]),
                          self._distance(x, self.order[np.minimum(at, k - 1), j]))
        r = np.floor(np.sqrt(near.astype(np.float64))).astype(np.int64)
        r -= r * r > near
        return r + ((r + 1) * (r + 1) <= near)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries that can be nearest."""
        r, masks = self.radius(x), None
        for j, prefix in enumerate(self.prefix):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - r, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + r, "right")
            between = prefix[high] ^ prefix[low]
            masks = between if masks is None else masks & between
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row."""
        index, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        if not len(x) or not x.shape[1]:
            return index, best
        masks = self.candidates(x)
        best[:] = np.iinfo(np.int64).max
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            gap = x[rows] - entry
            far = (gap * gap).sum(axis=1)
            better = far < best[rows]
            index[rows[better]], best[rows[better]] = e, far[better]
        return index, best


def _packed(v) -> bytes:
    """A vector as little-endian bytes; refuses what 64 bits cannot measure."""
    x = np.asarray(v, dtype=np.int64)
    top = int(np.abs(x).max(initial=0))
    if top > 2 ** 30 or (2 * top) ** 2 * max(1, len(x)) >= 1 << 62:
        raise ValueError(f"a component of {top} is too large for exact 64-bit distances")
    return x.astype("<i4").tobytes()


def packed_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(vec_id, label, v, dim) of the vectors that take part."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-4e18), F.least(F.lit(4e18), e.cast("double") * float(scale)))).cast("long"))

    @F.pandas_udf(T.BinaryType())
    def pack(vs: pd.Series) -> pd.Series:
        return pd.Series([_packed(x) for x in vs], dtype=object)

    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return (df.filter(x.isNotNull()).filter(F.coalesce(finite, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), pack(v).alias("v"), F.size(x).alias("dim")))


def _slices(packed: pd.Series):
    """(dim, positions, matrix) of packed vectors, bounded slices of one dimension each."""
    dims = packed.map(len).to_numpy(dtype=np.int64) // 4
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        for i in range(0, len(at), SLICE):
            rows = at[i:i + SLICE]
            blob = b"".join(packed.iloc[rows])
            yield int(dim), rows, np.frombuffer(blob, dtype="<i4").reshape(len(rows), int(dim)).astype(np.int64)


def _sums(books: dict):
    """Per task: (dim, part, entry, component, total); component -1 counts."""
    def run(frames):
        held = {d: [np.zeros((len(b.entries), b.entries.shape[1] + 1), dtype=np.int64) for b in bs] for d, bs in books.items()}
        for pdf in frames:
            for dim, _, x in _slices(pdf["v"]):
                for p, (a, b) in enumerate(cuts(dim, len(books[dim]))):
                    part = x[:, a:b]
                    index, _ = books[dim][p].nearest(part)
                    total = held[dim][p]
                    total[:, 0] += np.bincount(index, minlength=len(total))
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    total[used, 1:] += np.add.reduceat(part[order], first, axis=0)
        rows = [(d, p, e, c - 1, int(t[e, c])) for d, ts in held.items() for p, t in enumerate(ts)
                for e, c in zip(*np.nonzero(t))]
        yield pd.DataFrame(rows, columns=["dim", "part", "entry", "component", "total"])
    return run


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> dict[int, list[Codebook]]:
    """Codebooks of every dimension, from packed vectors (kept by the caller)."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = vectors.select("dim", "vec_id", "v").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= entries)
    start: dict[int, list] = {}
    for r in first.orderBy("dim", "r").limit(entries * (MAX_DIMS + 1)).collect():
        start.setdefault(r["dim"], []).append(np.frombuffer(r["v"], dtype="<i4").astype(np.int64))
    if len(start) > MAX_DIMS:
        raise ValueError(f"more than {MAX_DIMS} different dimensions")
    books = {d: [Codebook(np.stack(vs)[:, a:b]) for a, b in cuts(d, parts)] for d, vs in start.items()}
    for _ in range(rounds if books else 0):
        partial = vectors.select("v").mapInPandas(_sums(books), "dim int, part int, entry int, component int, total long")
        sums = partial.groupBy("dim", "part", "entry", "component").agg(F.sum("total").alias("total"))
        fresh = {d: [b.entries.copy() for b in bs] for d, bs in books.items()}
        counts, rest = {}, []
        for d, p, e, c, total in sums.collect():         # one number per codebook component
            if c < 0:
                counts[d, p, e] = total
            else:
                rest.append((d, p, e, c, total))
        for d, p, e in counts:
            fresh[d][p][e] = 0                           # sums of zero are not sent
        for d, p, e, c, total in rest:
            fresh[d][p][e, c] = total // counts[d, p, e]
        books = {d: [Codebook(e) for e in es] for d, es in fresh.items()}
    return books


def digest(books: list[Codebook]) -> str:
    """SHA-256 of the entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for e in b.entries for c in e.tolist()).encode()).hexdigest()


def assign(vectors: DataFrame, books: dict[int, list[Codebook]]) -> DataFrame:
    """``vec_id``, ``label``, ``dim``, ``code`` (two hex digits a part) and ``error``."""
    width = max([2] + [len(f"{len(b.entries) - 1:x}") for bs in books.values() for b in bs])

    @F.pandas_udf("code string, error long")
    def coded(vs: pd.Series) -> pd.DataFrame:
        codes, errors = np.empty(len(vs), dtype=object), np.zeros(len(vs), dtype=np.int64)
        for dim, rows, x in _slices(vs):
            index = []
            for b, (s, e) in zip(books[dim], cuts(dim, len(books[dim]))):
                i, far = b.nearest(x[:, s:e])
                index.append(i)
                errors[rows] += far
            codes[rows] = ["".join(f"{i:0{width}x}" for i in row) for row in np.stack(index, axis=1).tolist()]
        return pd.DataFrame({"code": codes, "error": errors})

    return vectors.select("vec_id", "label", "dim", coded("v").alias("m")).select("vec_id", "label", "dim", "m.code", "m.error")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
             scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of
    every vector that takes part."""
    vectors = written(packed_vectors(df, id_col, vec_col, label_col, scale), "code_vectors")
    books = train(vectors, parts, entries, rounds)
    coded = written(assign(vectors, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sha = F.lit(None).cast("string")
    for d, bs in books.items():
        sha = F.when(F.col("dim") == d, F.lit(digest(bs))).otherwise(sha)
    return (coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]), "left")
            .select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256")))
