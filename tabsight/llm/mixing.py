"""Mixing sources to target weights by weighted fair queueing (operator 6).

Every source is a flow with a target in words.  Its documents queue in a
hashed (shuffled) order, again for every further pass over the source, and a
queued packet has the virtual finish time

    words of its source up to and including it / target of its source.

All packets of all sources are then sorted by finish time over ranges, running
totals go across the ranges, and the order is truncated where the total reaches
the budget (the sum of the whole-word targets): ``cut_time``.  What finishes
later is not taken.  A document is one packet, but one in which its source's
target lies is two, as a router splits a packet: so each source is served to
the word, and every target is met by the one global cut.  Only DataFrame
functions are used.

Hot sources: the queue position is a prefix sum over (source, slice of the
hash range).  A source's slices hold equal shares of it whatever its size, so
one source with a third of all rows is spread over ``SLICES`` groups; slice
totals (one row per source and slice) carry the offsets.

Defined cases: null text has size 0; null source is a source of its own, last
in order; sources whose words are all zero get target 0; documents of size 0
are never taken; repeated rows and repeated ids queue once each (ties by id,
size and text hash, equal rows are interchangeable); an empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions.ranks import running_sums
from tabsight.llm.common import WHITE, free_name, word_count
from tabsight.session import cut_lineage

SLICES = 1024
WEIGHTS = (3, 1, 2)


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 hash bits of the id as a long: the shuffled order of a source."""
    text = F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Water-filling.  ``sizes`` has one row per source: ``key``, ``source``,
    ``source_size``; returns it with ``weight`` and ``target``.

    The sources share ``share`` of all words by weight; a target stops at
    ``cap`` times its source, and the level rises for the others until no
    target is above its stop.  Ordered by stop / weight, the stopped sources
    are a prefix, so one window pass finds the level.  The windows run over
    one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1))
    s = s.withColumn("stop", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("key"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everyone) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
                     / F.sum("weight").over(onward))
    fits = F.when(F.col("level") < F.col("stop") / F.col("weight"), F.col("level"))
    s = s.withColumn("water", F.first(fits, ignorenulls=True).over(everyone))
    target = F.least(F.col("stop"), F.coalesce(F.col("water") * F.col("weight"), F.col("stop")))
    return s.select("key", "source_size", "weight", target.alias("target"))


_BASE = ("key", "slice", "size", "h", "tie", "ahead", "source_size", "target", "source")


def _rows(docs: DataFrame, keep: list[str], seed: int, id_col: str, text_col: str, source_col: str):
    """``docs`` with source key, slice, size and queue order, and the names of those columns."""
    names = {"doc_id": id_col, **{b: free_name(docs.select(*keep), f"mix_{b}") for b in _BASE}}
    src, h = F.col(source_col), shuffle_key(F.col(id_col), seed)
    rows = docs.select(
        *keep,
        F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), src.cast("string"))).alias(names["key"]),
        src.alias(names["source"]), word_count(F.col(text_col)).alias(names["size"]), h.alias(names["h"]),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(names["tie"]))
    return rows.withColumn(names["slice"], F.floor(F.col(names["h"]) / F.lit((1 << 60) // SLICES)).cast("int")), names


def _slices(rows: DataFrame, names: dict[str, str], weights, share, cap) -> DataFrame:
    """One row per source and slice: the words of the slices before it, source size and target."""
    key, part, size = names["key"], names["slice"], names["size"]
    totals = (rows.groupBy(F.col(key).alias("key"), F.col(part).alias("slice"))
              .agg(F.first(names["source"]).alias("source"), F.sum(size).alias("words")))
    totals = cut_lineage(totals)
    targets = source_targets(totals.groupBy("key").agg(F.first("source").alias("source"),
                                                       F.sum("words").alias("source_size")), weights, share, cap)
    ahead = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return (totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
            .join(targets, "key").select("key", "slice", "ahead", "source_size", "target"))


def _queue(rows: DataFrame, slices: DataFrame, names: dict[str, str], cap: float) -> DataFrame:
    """``rows`` with source size, target and their packets (pass, finish, words)."""
    key, part, size, h, tie = (names[k] for k in ("key", "slice", "size", "h", "tie"))
    slices = slices.select(*[F.col(c).alias(names[c]) for c in ("key", "slice", "ahead", "source_size", "target")])
    queue = Window.partitionBy(key, part).orderBy(h, F.col(names["doc_id"]), size, tie).rowsBetween(
        Window.unboundedPreceding, -1)
    queued = (rows.join(slices, [key, part])
              .withColumn(names["ahead"], F.col(names["ahead"]) + F.coalesce(F.sum(size).over(queue), F.lit(0))))
    target, time = F.col(names["target"]), F.nullif(F.col(names["target"]), F.lit(0.0))
    packets = []
    for p in range(max(1, int(-(-cap // 1)))):
        start = F.col(names["ahead"]) + p * F.col(names["source_size"])
        first = F.greatest(F.lit(0), F.least(F.col(size), F.floor(target) - start))
        for words, end in ((first, start + first), (F.col(size) - first, start + F.col(size))):
            packets.append(F.struct(F.lit(p).alias("pass"), F.coalesce(end / time, F.lit(float("inf"))).alias("finish"),
                                    words.cast("long").alias("words")))
    return queued.withColumn(names["ahead"], F.filter(F.array(*packets), lambda x: x["words"] > 0))


def cut_time(packets: DataFrame, budget: int) -> float:
    """Finish time of the last of ``packets(finish, words)`` that the budget
    serves: a sort over ranges of finish time, running totals across them,
    truncated at the budget.  Packets that finish together go together; -1 if
    the first is too large."""
    together = packets.groupBy("finish").agg(F.sum("words").alias("words"))
    served = running_sums(together, "finish", ["words"]).filter(F.col("cum_words") <= F.lit(budget))
    last = served.agg(F.max("finish")).first()[0]
    return -1.0 if last is None else last


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 6,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target`` and
    ``served``: an array of (pass, finish, words) for each pass that takes
    words of it, finish in virtual time.  ``carry`` names more input columns
    to keep under a prefix-free name (used to mix whole rows); queue and cut
    are found on narrow rows first."""
    keep = carry if carry is not None else [id_col]
    narrow, names = _rows(docs, [id_col], seed, id_col, text_col, source_col)
    narrow = cut_lineage(narrow)          # the texts are read once
    slices = _slices(narrow, names, weights, share, cap)
    queued = _queue(narrow, slices, names, cap)
    if carry is None:
        queued = cut_lineage(queued)      # read twice: for the cut and for the result
    budget = slices.select("key", "target").distinct().agg(F.sum(F.floor("target"))).first()[0] or 0
    cut = cut_time(queued.select(F.explode(names["ahead"]).alias("x")).select("x.finish", "x.words"), int(budget))
    if carry is not None:
        rows, names = _rows(docs, keep, seed, id_col, text_col, source_col)
        queued = _queue(rows, slices, names, cap)
    served = F.filter(names["ahead"], lambda x: x["finish"] <= F.lit(cut))
    size, total, target = (F.col(names[k]) for k in ("size", "source_size", "target"))
    return queued.select(*keep, size.alias(names["size"]), total.cast("long").alias(names["source_size"]),
                         target.alias(names["target"]), served.alias(free_name(docs.select(*keep), "mix_served")))


def mixed_ledger(docs: DataFrame, **kw) -> DataFrame:
    """The mix per document, in global order of virtual finish time (a range
    sort): doc_id, size, source_size, target, taken, finish."""
    m = mix(docs, **kw)
    id_col = kw.get("id_col", "doc_id")
    taken = F.aggregate("mix_served", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return (m.select(F.col(id_col).alias("doc_id"), F.col("mix_size").alias("size"),
                     F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                     taken.alias("taken"), F.try_element_at("mix_served", F.lit(1))["finish"].alias("finish"))
            .orderBy(F.col("finish").asc_nulls_last(), "doc_id"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus itself: the input rows, once for each pass that takes
    them, in order of virtual finish time; a row cut by the budget keeps the
    text up to its last taken word.  Same columns as the input."""
    cols = docs.columns
    text_col = kw.get("text_col", "text")
    m = mix(docs, carry=cols, **kw)
    item, served, size = free_name(docs, "mix_item"), free_name(docs, "mix_served"), free_name(docs, "mix_size")
    rows = m.withColumn(item, F.explode(served))
    pieces = F.split(F.col(text_col), rf"(?<!{WHITE})(?={WHITE})")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(item)["words"].cast("int")), "")
    rows = rows.withColumn(text_col, F.when(F.col(item)["words"] >= F.col(size), F.col(text_col)).otherwise(cut))
    if "n_chars" in cols and "n_chars" != text_col:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.orderBy(F.col(item)["finish"], kw.get("id_col", "doc_id")).select(*cols)
