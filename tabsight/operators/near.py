"""Exact neighbour joins over pivot partitions.

Points are dealt to the nearest of some pivots (a hash sample of bounded size:
it decides where space is cut, never what is compared).  Two facts of any
metric then prune: a point within e of x whose home is pivot p has
d(x, p) <= d(x, home of x) + 2e, and d(x, p) <= radius of p + e.

* Epsilon join: a point is copied to the partitions of lower number for which
  both hold, so each pair meets in exactly one partition.
* k nearest: a query first meets the nearest partitions that hold enough rows;
  its k-th distance is the e of a second round over the other partitions.

A task holds at most two blocks of ``BLOCK`` rows: larger partitions are cut
into blocks that meet in block pairs, and equal points collapse to one weighted
point before the epsilon join, so copies cost nothing.  Norms 1 and 2.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, dealt

MAX_PIVOTS = 1_024       # pivots travel with the tasks
ROWS_A_PIVOT = 1_000
BLOCK = 4_096
STEP = 256               # rows measured at a time
SLACK = 1e-9


def point(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def whole(x: Column) -> Column:
    """Points without null, NaN or infinite components take part."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray, norm: int) -> np.ndarray:
    """(len(a) x len(b)) distances, component by component (no cancellation)."""
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        d += gap * gap if norm == 2 else np.abs(gap)
    return np.sqrt(d) if norm == 2 else d


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.empty((0, 0))


def pivots(points: DataFrame) -> np.ndarray:
    """Distinct points of a hash sample, one for about ROWS_A_PIVOT rows."""
    n = points.count()
    want = int(min(MAX_PIVOTS, max(1, -(-n // ROWS_A_PIVOT))))
    rows = points.select("x", F.xxhash64("x").alias("h")).distinct().orderBy("h", "x").limit(want).collect()
    return np.array([r["x"] for r in rows], dtype=float) if rows else np.empty((0, 0))


def homes(points: DataFrame, at: np.ndarray, norm: int) -> DataFrame:
    """``points`` with ``home`` (nearest pivot, the first of equals) and ``far``."""
    @F.pandas_udf("home int, far double")
    def nearest(xs: pd.Series) -> pd.DataFrame:
        out = [(np.empty(0, dtype=int), np.empty(0))]
        for i in range(0, len(xs), STEP):
            d = distances(_matrix(xs.iloc[i:i + STEP]), at, norm)
            out.append((d.argmin(axis=1), d.min(axis=1)))
        return pd.DataFrame({"home": np.concatenate([o[0] for o in out]), "far": np.concatenate([o[1] for o in out])})

    return points.withColumn("__h", nearest("x")).select(*points.columns, "__h.home", "__h.far")


@dataclass
class Cut:
    """The partitions: pivots, and radius and rows of each."""
    at: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    norm: int


def cut(points: DataFrame, norm: int) -> tuple[DataFrame, Cut]:
    """Points with their homes (kept once) and the partitions."""
    at = pivots(points)
    placed = cut_lineage(homes(points, at, norm))
    radius, rows = np.full(len(at), -np.inf), np.zeros(len(at), dtype=np.int64)
    for r in placed.groupBy("home").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["home"]], rows[r["home"]] = r["r"], r["n"]        # one row a pivot
    return placed, Cut(at, radius, rows, norm)


def _blocked(rows: DataFrame, salt: Column) -> DataFrame:
    """Rows of (cell) with the block pair (lo, hi) they meet in and their side s."""
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).collect()}
    k = F.lit(1)                                                   # at most one entry a pivot
    for c, n in sizes.items():
        k = F.when(F.col("cell") == c, F.lit(int(-(-n // BLOCK)))).otherwise(k)
    rows = rows.withColumn("s", F.pmod(salt, k).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), k - 1)))
    return rows.withColumn("lo", F.least("s", "t")).withColumn("hi", F.greatest("s", "t")).drop("t")


# ---------------------------------------------------------------- epsilon join

def epsilon_cells(points: DataFrame, eps: float, norm: int = 2) -> DataFrame:
    """(cell, lo, hi, s, own, far, rid, x, w) from ``points(rid, x, w)``: the groups
    in which all pairs within ``eps`` meet exactly once."""
    placed, c = cut(points, norm)

    @F.pandas_udf("array<struct<cell: int, own: boolean, far: double>>")
    def route(xs: pd.Series, home: pd.Series, far: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(xs), STEP):
            d = distances(_matrix(xs.iloc[i:i + STEP]), c.at, norm)
            h, own = home.to_numpy()[i:i + STEP], far.to_numpy()[i:i + STEP]
            slack = SLACK * (1 + d)
            goes = (d <= own[:, None] + 2 * eps + slack) & (d <= c.radius[None, :] + eps + slack) & (np.arange(len(c.at)) < h[:, None])
            for j, (mine, f) in enumerate(zip(h, own)):
                out.append([{"cell": int(mine), "own": True, "far": float(f)}]
                           + [{"cell": int(p), "own": False, "far": float(d[j, p])} for p in np.flatnonzero(goes[j])])
        return pd.Series(out, dtype=object)

    rows = placed.select("rid", "x", "w", F.explode(route("x", "home", "far")).alias("g")).select("rid", "x", "w", "g.*")
    return cut_lineage(_blocked(cut_lineage(rows), F.xxhash64("rid")))


def _within(pdf: pd.DataFrame, key: tuple, eps: float, norm: int):
    """(i, j, distance) arrays of the pairs of a group within eps, each once."""
    far, own, left = pdf["far"].to_numpy(), pdf["own"].to_numpy().astype(bool), pdf["s"].to_numpy() == key[1]
    x, two = _matrix(pdf["x"]), key[1] != key[2]
    for a in range(0, len(pdf), STEP):
        b = min(len(pdf), a + STEP)
        # sorted by distance to the pivot: partners lie within eps of it
        end = int(np.searchsorted(far, far[b - 1] + eps + SLACK * (1 + far[b - 1]), "right"))
        d = distances(x[a:b], x[a:end], norm)
        ok = (d <= eps) & (np.arange(a, end)[None, :] > np.arange(a, b)[:, None]) & (own[a:b, None] | own[None, a:end])
        if two:
            ok &= left[a:b, None] != left[None, a:end]
        i, j = np.nonzero(ok)
        yield i + a, j + a, d[i, j]


def epsilon_pairs(df: DataFrame, features: list[str], eps: float, id_col: str, norm: int = 2) -> DataFrame:
    """(a, b, distance), a < b, of all rows within ``eps`` of each other
    (ids are taken to be unique; rows with missing components have no pairs)."""
    points = df.select(F.col(id_col).alias("rid"), point(features).alias("x"), F.lit(1).cast("long").alias("w")).filter(whole(F.col("x")))
    kind = points.schema["rid"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.DoubleType())])

    def pairs(key, pdf):
        pdf = pdf.sort_values("far", kind="stable")
        rid, out = pdf["rid"].to_numpy(), []
        for i, j, d in _within(pdf, key, eps, norm):
            out.append(pd.DataFrame({"a": rid[i], "b": rid[j], "distance": d}))
        return pd.concat(out) if out else pd.DataFrame({"a": rid[:0], "b": rid[:0], "distance": []})

    got = epsilon_cells(points, eps, norm).drop("w").groupBy("cell", "lo", "hi").applyInPandas(pairs, schema)
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


# ---------------------------------------------------------------- k nearest

def _bounds(y: np.ndarray, x: np.ndarray, k: int):
    """Places of ``y`` that can hold one of the ``k`` nearest of a chunk ``x`` of
    queries, given upper bounds of their k-th distances (NaN: none yet): no
    component of a partner is further away than the bound."""
    axis = int((y.max(axis=0) - y.min(axis=0)).argmax())
    by = np.argsort(y[:, axis], kind="stable")
    line = y[by, axis]

    def window(theta: np.ndarray, part: np.ndarray, kth) -> np.ndarray:
        low, high = part[:, axis].min(), part[:, axis].max()
        if np.isnan(theta).any():              # the k-th distance among the rows at hand bounds the true one
            a, b = max(0, np.searchsorted(line, low) - k), np.searchsorted(line, high, "right") + k
            theta = np.fmin(theta, kth(by[a:b]))
        far = theta.max()
        if not np.isfinite(far):
            return np.arange(len(y))
        far += SLACK * (1 + far + abs(low) + abs(high))
        return np.sort(by[np.searchsorted(line, low - far):np.searchsorted(line, high + far, "right")])

    return window, np.argsort(x[:, axis], kind="stable")


def nearest_rows(held: DataFrame, asked: DataFrame, k: int, norm: int = 2) -> DataFrame:
    """C4: (qid, d, hid, o, n): the ``k`` nearest rows of ``held(hid, x, o,
    apart)`` for every row of ``asked(qid, x, apart)``; n counts from 1, equal
    distances by o.  Rows whose ``apart`` is equal and not null do not meet.

    Of equal held points only the first ``k`` can be an answer, so only those are
    kept.  A block of a partition meets at most ``BLOCK`` queries at a time: rows
    that are sent grow with the rows of the tables, not with their product."""
    first = Window.partitionBy("x", "apart").orderBy("o", "hid")
    held = held.withColumn("__first", F.row_number().over(first)).filter(F.col("__first") <= k).drop("__first")
    held, c = cut(held, norm)
    total, queries = int(c.rows.sum()), asked.count()
    asked = cut_lineage(homes(dealt(asked, queries), c.at, norm).withColumnRenamed("far", "near")) if total else asked
    fields = [asked.schema["qid"], T.StructField("d", T.DoubleType()), held.schema["hid"], held.schema["o"]]
    schema = T.StructType(fields)
    if not total:
        return asked.select("qid", F.lit(0).alias("n"), F.lit(0.0).alias("d"), *[F.lit(None).cast(f.dataType).alias(f.name)
                                                                                for f in fields[2:]]).limit(0)
    # rows of each partition that a query may meet: all, or those of the other sides (one row a pivot and side)
    per = held.filter(F.col("apart").isNotNull()).groupBy("apart", "home").agg(F.count(F.lit(1)).alias("n")).collect()
    sides = np.array(sorted({r["apart"] for r in per}), dtype=float)
    may = np.tile(c.rows, (len(sides) + 1, 1))                      # the last line is for queries without a side
    for r in per:
        may[np.searchsorted(sides, r["apart"]), r["home"]] -= r["n"]

    def visits(first: bool):
        @F.pandas_udf("array<int>")
        def go(xs: pd.Series, home: pd.Series, apart: pd.Series, theta: pd.Series) -> pd.Series:
            out, home, theta, apart = [], home.to_numpy(), theta.to_numpy(dtype=float), apart.to_numpy(dtype=float, na_value=np.nan)
            side = np.searchsorted(sides, apart)
            side = np.where(np.isin(apart, sides), side, len(sides))
            for i in range(0, len(xs), STEP):
                own, mine = home[i:i + STEP], side[i:i + STEP]
                short = may[mine, own] < 2 * k                       # the nearest partition does not hold 2k rows
                if first and not short.any():
                    out += [[int(h)] for h in own]
                    continue
                d = distances(_matrix(xs.iloc[i:i + STEP]), c.at, norm)
                seen = np.zeros(d.shape, dtype=bool)
                seen[np.arange(len(own)), own] = True
                if short.any():
                    near = np.argsort(d[short], axis=1, kind="stable")
                    rows_ = np.take_along_axis(may[mine[short]], near, axis=1)
                    some = np.zeros(near.shape, dtype=bool)
                    np.put_along_axis(some, near, np.cumsum(rows_, axis=1) - rows_ < 2 * k, axis=1)      # the first ones that do
                    seen[short] = some
                if not first:
                    e = theta[i:i + STEP, None] + SLACK * (1 + d)
                    e = np.where(np.isnan(e), np.inf, e)
                    seen = ~seen & (d - c.radius[None, :] <= e) & (d - d[np.arange(len(own)), own][:, None] <= 2 * e)
                out += [np.flatnonzero(r).tolist() for r in seen & (c.rows > 0)]
            return pd.Series(out, dtype=object)
        return go

    def meet(key, left, right):
        found = []
        if len(left) and len(right):
            left = left.sort_values(["o", "hid"], kind="stable")
            y, la, hid, o = _matrix(left["x"]), left["apart"].to_numpy(dtype=float, na_value=np.nan), left["hid"].to_numpy(), left["o"].to_numpy()
            x, ra = _matrix(right["x"]), right["apart"].to_numpy(dtype=float, na_value=np.nan)
            qid, theta = right["qid"].to_numpy(), right["theta"].to_numpy(dtype=float)
            window, turn = _bounds(y, x, k)

            def gaps(i, j):
                d = distances(x[i], y[j], norm)
                return np.where(ra[i, None] == la[None, j], np.inf, d) if len(sides) else d       # null equals nothing

            def kth(d):
                return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.nan)

            for s in range(0, len(turn), STEP):
                i = turn[s:s + STEP]
                j = window(theta[i], x[i], lambda at: kth(gaps(i, at)))
                d = gaps(i, j)
                most = np.fmin(np.fmin(theta[i], kth(d)), np.finfo(float).max)
                q, at = np.nonzero(d <= most[:, None])
                order = np.lexsort((d[q, at], q))                     # stable: equal distances stay in the order of left
                q, at = q[order], at[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, at = q[best], at[best]
                found.append(pd.DataFrame({"qid": qid[i[q]], "d": d[q, at], "hid": hid[j[at]], "o": o[j[at]]}))
        return pd.concat(found) if found else pd.DataFrame({f.name: [] for f in schema.fields})

    blocks = {p: int(-(-n // BLOCK)) for p, n in enumerate(c.rows) if n > BLOCK}
    parts = _of_cell(blocks)
    rows = held.select("hid", "x", "o", "apart", F.col("home").alias("cell"))
    rows = cut_lineage(rows.withColumn("block", F.pmod(F.xxhash64("hid", "o"), parts).cast("int")))
    best = Window.partitionBy("qid").orderBy("d", "o", "hid")

    def ranked(found: DataFrame) -> DataFrame:
        return dealt(found, queries * k, "qid").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)

    def round_(rest: DataFrame, first: bool) -> DataFrame:
        calls = cut_lineage(rest.withColumn("cell", F.explode(visits(first)("x", "home", "apart", "theta"))).select("qid", "x", "apart", "theta", "cell"))
        many = {r["cell"]: r["n"] for r in calls.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}       # one row a pivot
        groups = {p: int(-(-n // BLOCK)) for p, n in many.items() if n > BLOCK}
        met_rows = sum(n * blocks.get(p, 1) for p, n in many.items())
        calls = (calls.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
                 .withColumn("qb", F.pmod(F.xxhash64("qid"), _of_cell(groups)).cast("int")))
        met = rows.filter(F.col("cell").isin([int(p) for p in many])).withColumn("qb", F.explode(F.sequence(F.lit(0), _of_cell(groups) - 1)))
        keys = ["cell", "block", "qb"]
        met, calls = dealt(met, met_rows, *keys), dealt(calls, met_rows, *keys)
        return met.groupBy(*keys).cogroup(calls.groupBy(*keys)).applyInPandas(meet, schema)

    one = cut_lineage(ranked(round_(asked.withColumn("theta", F.lit(None).cast("double")), True)))
    theta = one.filter(F.col("n") == k).select("qid", F.col("d").alias("theta"))
    two = round_(asked.join(theta, "qid", "left"), False)
    return ranked(one.drop("n").unionByName(two))


def _of_cell(numbers: dict[int, int]) -> Column:
    """The number of a row's cell, 1 where none is given (at most one entry a pivot)."""
    if not numbers:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for p, n in numbers.items() for v in (int(p), int(n))])
    return F.coalesce(F.element_at(table, F.col("cell")), F.lit(1))
