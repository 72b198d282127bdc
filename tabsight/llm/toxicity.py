"""Toxicity by gradient-boosted trees over dense features (operator 4).

Every whole text becomes a short row of rates: lexicon densities (a fixed seed
list, and words and word beginnings learned from labelled rows), how close
second-person words stand to lexicon words, capitals, punctuation and
obfuscation (digits or symbols for letters, spelled-out words).  Spark's
gradient-boosted trees score the row and isotonic regression turns the score
into a probability.

Labelled rows are split by crc32(doc_id as text) mod 5: 0 is held out and never
read; 1 and 2 give the learned lexicon; 3 trains the trees; 4 fits the
calibration, so no part is fitted on rows another part has already seen.  The
labelled rows used are a hash sample of at most ``LABELLED_ROWS`` (the
documented bound of the fit), half of it kept for each label where there are
so many; trees and calibration weight the rows back to the table's shares.
Scoring covers every row.  Labels, lang, source and doc_id are never features.

Defined cases: null and empty texts get an all-zero row and the score the
model gives it; labels outside 0/1 or without a document are ignored, of
repeated labels of one id the largest counts; a null id counts as held out;
with too few labelled rows of either class the score comes from the seed
lexicon alone; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import bounded_batches, written

LABELLED_ROWS = 24_000   # labelled rows used by the fit
LEXICON_SIZE = 400       # learned terms kept
MIN_DOCS = 6             # toxic documents a learned term needs
MIN_ODDS = 2.0           # log odds a learned term needs
MIN_CLASS = 20           # labelled rows of either class below which only the seed list counts
STEMS = (5, 6, 7)        # lengths of learned word beginnings

# Seed insults and second-person words.
SEED = frozenset("""idiot idiots moron morons stupid dumb fool loser losers scum trash garbage worthless pathetic disgusting
clown filth filthy vermin creep liar coward imbecile retard bastard bitch crap shit fuck fucking asshole dickhead hate hateful
ugly freak jerk pig die kill idiota estúpido estúpida basura imbécil asqueroso dummkopf idioten dumm abschaum arschloch
müll schwachkopf idiote stupide ordure connard minable dégoûtant""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton vous vos votre tú usted ti".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_TOKEN = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*")
_ODD = re.compile(r"[0-9@$!*]")
_REPEAT = re.compile(r"([!?])\1")

FEATURES = ["seed_density", "seed_hits", "term_density", "stem_density", "learned_weight", "learned_hits", "near_person",
            "person_density", "capitals", "upper_words", "exclaims", "repeated_marks", "masked_density", "spelled_density",
            "log_words"]


def _spelled(tokens: list[str]) -> list[str]:
    """Words spelled as single letters (``i d i o t``), at least four letters."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        if len(run) >= 4:
            out.append("".join(run))
        run = []
    return out


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The feature row of one whole text.  ``lexicon``: learned term -> log
    odds, word beginnings with a trailing ``*``."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    tokens = _TOKEN.findall(low)
    n = max(1, len(tokens))
    counts = Counter(tokens)
    seed = term = stem = masked = person = 0
    weight, hot = 0.0, set()
    for w, c in counts.items():
        if w in SECOND_PERSON:
            person += c
        if w in SEED:
            seed += c
            hot.add(w)
        elif _ODD.search(w):
            plain = re.sub(r"[^\w]", "", w.translate(_LEET))
            star = "*" in w and any(len(s) == len(w) and s[0] == w[0] and s[-1] == w[-1] for s in SEED)
            if plain != w and plain in SEED or star:
                masked += c
                hot.add(w)
        if lexicon:
            if w in lexicon:
                term += c
                weight += c * lexicon[w]
                hot.add(w)
            else:
                best = max((lexicon.get(w[:k] + "*", 0.0) for k in STEMS if len(w) >= k), default=0.0)
                if best:
                    stem += c
                    weight += c * best
                    hot.add(w)
    near = 0
    if hot and person:
        last, pending = -10, []
        for i, w in enumerate(tokens):
            if w in SECOND_PERSON:
                last = i
                near += sum(i - p <= 5 for p in pending)
                pending = []
            elif w in hot:
                if i - last <= 5:
                    near += 1
                else:
                    pending = [p for p in pending if i - p <= 5] + [i]
    spelled = sum(s in SEED or s in lexicon for s in _spelled(tokens)) if any(len(t) == 1 for t in counts) else 0
    letters = sum(map(str.isalpha, text))
    caps = sum(map(str.isupper, text)) if text != low else 0
    upper = sum(1 for w in text.split() if len(w) > 1 and w.isupper()) if caps else 0
    return [seed / n, math.log1p(seed), term / n, stem / n, weight / n, math.log1p(term + stem), near / n, person / n,
            caps / max(1, letters), upper / n, (text.count("!") + text.count("?")) / n,
            len(_REPEAT.findall(text)) / n if "!" in text or "?" in text else 0.0, masked / n, spelled / n,
            math.log1p(len(tokens))]


def _rows(lexicon: dict[str, float]):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon) for t in texts], dtype=object)
    return rows


def _terms(text: str | None) -> set[str]:
    words = {w for w in _TOKEN.findall((text or "").lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _term_counts(frames):
    for pdf in frames:
        toxic, clean = Counter(), Counter()
        for text, label in zip(pdf["text"], pdf["toxic"]):
            (toxic if label else clean).update(_terms(text))
        yield pd.DataFrame([(t, toxic[t], clean[t]) for t in toxic.keys() | clean.keys()], columns=["term", "toxic", "clean"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms whose document frequency is much higher in toxic rows.  Counted
    per batch, then by Spark; at most ``LEXICON_SIZE`` terms reach the driver."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    terms = (rows.mapInPandas(_term_counts, "term string, toxic long, clean long").groupBy("term")
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    best = (terms.filter(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
            .orderBy(F.col("odds").desc(), "term").limit(LEXICON_SIZE))
    return {r["term"]: float(r["odds"]) for r in best.collect()}


def remainder(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """The bounded sample of labelled rows outside the held-out fold:
    (part, text, toxic, weight).  A label rarer than half the bound is kept
    whole; ``weight`` is the number of labelled rows a row stands for."""
    good = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = {0: 0, 1: 0, **{r["toxic"]: r["n"] for r in good.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}}
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(4)), F.col("doc_id")]
    kept = {t: min(n[t], max(most // 2, most - n[1 - t])) for t in (0, 1)}
    first, second = [good.filter(F.col("toxic") == t).orderBy(*order).limit(kept[t])
                     .withColumn("weight", F.lit(n[t] / max(1, kept[t]))) for t in (0, 1)]
    sample = first.union(second)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id")    # at most ``most`` ids
    return written(rows.select(remainder(F.col("doc_id")).alias("part"), "text", "toxic", "weight").repartition(12), "toxic_rows")


class ToxicityModel:
    """Learned lexicon, trees and calibration; ``score`` adds the score column."""

    def __init__(self, lexicon, trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        rows = df.withColumn("f", _rows(self.lexicon)(F.col(text_col).cast("string")))
        if self.trees is None:
            return rows.withColumn("score", F.lit(1.0) - F.exp(F.lit(-1.0) * F.col("f")[1])).drop("f")
        rows = _assembled(rows)
        raw = self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        out = self.calibration.transform(raw)
        return (out.withColumn("score", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)))
                .drop("f", "x", "raw", "probability", "rawPrediction", "prediction", "calibrated", *FEATURES))


def _assembled(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", *[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)])
    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        most: int = LABELLED_ROWS, trees: int = 20, depth: int = 4, seed: int = 4) -> ToxicityModel:
    rows = labelled(docs, labels, id_col, text_col, most)
    n = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon = learn_lexicon(rows.filter("part in (1, 2)").select("text", "toxic"))
    if min(n.get((p, t), 0) for p in (3, 4) for t in (0, 1)) < MIN_CLASS:
        return ToxicityModel(lexicon, None, None)
    made = rows.filter("part in (3, 4)").select("part", F.col("toxic").cast("double").alias("label"), "weight",
                                                _rows(lexicon)("text").alias("f"))
    made = _assembled(written(made, "toxic_features"))
    gbt = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed,
                        subsamplingRate=0.8, minInstancesPerNode=5)
    model = gbt.fit(made.filter("part = 3").select("x", "label", "weight").repartition(6))
    rest = model.transform(made.filter("part = 4")).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(rest)
    return ToxicityModel(lexicon, model, calibration)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, **kw)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = model.score(rows)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
