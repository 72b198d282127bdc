"""Personal data by weak supervision (operator 3).

``candidates`` scans every whole text once.  Base spans (email, ip, card,
phone) follow fixed rules and always stay.  Weaker candidates (secrets, social
security numbers, IBANs) and the base spans are each judged by labelers that
vote yes, no or abstain: checks on the match itself (regex), lists of known
prefixes and endings (gazetteer) and the words around it (context).

``fit`` counts vote patterns over all candidates (a Spark aggregate; the table
is bounded by kinds x 3 ** labelers x buckets, not by the data), estimates each
labeler's reliability per kind by expectation-maximisation (binary
Dawid-Skene), and trains the final span classifier (logistic regression on
votes, kind and size bucket) on the posteriors.  The classifier is then a
column expression over the candidates: a span is reported if it is a base span
or its probability is at least one half.

Defined cases: null is an empty text, an empty text has no spans; overlapping
spans of different kinds are all reported and merged when redacted; no
candidate at all leaves the classifier unused; repeated rows and ids give one
row each; positions are code points, the end is exclusive.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import bounded_batches, written

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "secret", "ssn")
KINDS = BASE_KINDS + EXTRA_KINDS
LABELERS = ("pattern", "checksum", "gazetteer", "cue_before", "edges", "negative_cue")
ABSTAIN, NO, YES = 0, 1, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LONG = re.compile(r"[A-Za-z0-9_-]{20,}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")

# Endings, prefixes and cue words the labelers know.
_TLDS = frozenset("com org net edu gov mil int info biz io co de fr es it uk nl pl us ca eu ch at be se no dk fi".split())
_DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48",
         "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
_IBAN_LANDS = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
_SECRET_PREFIX = ("sk", "pk", "ghp", "gho", "xox", "AKIA", "eyJ", "AIza")
_CUES = {
    "email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "secret", "key", "passw", "auth", "bearer", "credential"),
    "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"),
}
_NEGATIVE = ("version", "sha", "md5", "commit", "checksum", "digest", "page", "isbn", "figure", "section")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _octet(part: str) -> bool:
    """At most 255, whatever the number of zeros before it."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, pos = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = pos + sum(map(len, four)) + 3
            if all(_octet(p) for p in four):
                yield pos, end
            pos = end + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 16:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _ips(text)]
        out += [("card", a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [("phone", a, b) for a, b in _phones(text)]
    return out


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base rules."""
    if not _DIGIT.search(text):
        return []
    out = [("iban", *m.span()) for m in _IBAN.finditer(text)]
    out += [("secret", *m.span()) for m in _LONG.finditer(text)
            if _DIGIT.search(m.group()) and not m.group().isdigit()]
    out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    return out


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s)))


def _say(yes: bool, no: bool = False) -> int:
    return YES if yes else NO if no else ABSTAIN


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler of ``LABELERS``."""
    s = text[start:end]
    before, after = text[max(0, start - 40):start].lower(), text[end:end + 1]
    cue = any(c in before for c in _CUES[kind])
    negative = _say(False, any(c in before for c in _NEGATIVE))
    opened = text[start - 1:start] if start else ""
    quoted = bool(opened) and opened in "\"'`" and after == opened
    apart = not (opened.isalnum() or after.isalnum())
    edges = _say(quoted or apart, not apart)
    checksum = listed = ABSTAIN
    if kind == "email":
        pattern = _say("." in s.rpartition("@")[2], ".." in s)
        listed = _say(s.rpartition(".")[2].lower() in _TLDS, s.rpartition(".")[2].isdigit())
    elif kind == "ip":
        pattern = _say(all(p == "0" or p[0] != "0" for p in s.split(".")), True)
        listed = _say(False, s.startswith(("0.", "255.")))
    elif kind == "card":
        digits = s.replace(" ", "").replace("-", "")
        pattern, checksum = _say(len(digits) == 16), _say(luhn(digits), True)
        listed = _say(digits[0] in "3456", digits[0] in "0789")
    elif kind == "phone":
        digits = re.sub(r"[^0-9]", "", s)
        pattern = _say(len(digits) >= 10, len(digits) < 9)
        listed = _say(digits.startswith(_DIAL))
    elif kind == "iban":
        moved = s[4:] + s[:4]
        pattern = _say(15 <= len(s) <= 34)
        checksum = _say(int("".join(str(int(c, 36)) for c in moved)) % 97 == 1, True)
        listed = _say(s[:2] in _IBAN_LANDS, True)
    elif kind == "secret":
        letters = sum(map(str.isalpha, s))
        mixed = 0.15 <= letters / len(s) <= 0.9
        one = s.isupper() or s.islower() or "_" not in s and "-" not in s
        pattern = _say(mixed and _entropy(s[:200]) >= 3.3 and one, not mixed or _entropy(s[:200]) < 2.6)
        listed = _say(s.startswith(_SECRET_PREFIX) or bool(re.fullmatch(r"(?:[0-9a-f]{2}){16,}", s)), "--" in s)
    else:
        area, group, serial = s.split("-")
        pattern = _say(area not in ("000", "666") and area < "900" and group != "00" and serial != "0000", True)
    return pattern, checksum, listed, _say(cue), edges, negative


_SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("bucket", T.IntegerType())])


def scan(text: str | None) -> list[dict]:
    """All judged candidates of one text, base spans first."""
    if not text:
        return []
    found = [(k, a, b, True) for k, a, b in base_spans(text)] + [(k, a, b, False) for k, a, b in weak_spans(text)]
    return [{"kind": k, "start": a, "end": b, "base": base, "votes": "".join(map(str, votes(text, k, a, b))),
             "bucket": min(3, (b - a) // 16)} for k, a, b, base in found]


@F.pandas_udf(T.ArrayType(_SPAN))
def _scan(texts: pd.Series) -> pd.Series:
    return pd.Series([scan(t) for t in texts], dtype=object)


def candidates(docs: DataFrame, text_col: str = "text", keep: list | None = None, name: str = "spans") -> DataFrame:
    """``keep`` columns and the array of judged candidates, written once."""
    bounded_batches(docs.sparkSession)
    return written(docs.select(*(keep or ["doc_id"]), _scan(F.col(text_col).cast("string")).alias(name)), "pii_spans")


# ------------------------------------------------------- weak supervision

@dataclass
class SpanModel:
    """``reliability[kind][labeler]`` = (P(yes | personal), P(no | not personal));
    ``weights`` of the classifier over ``features``."""
    reliability: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)

    def probability(self, span: Column) -> Column:
        """The classifier as a column over one candidate struct."""
        if not self.weights:
            return F.lit(0.0)
        z = F.lit(0.0)
        for w, (test, *arg) in zip(self.weights, _FEATURES):
            if test == "one":
                z = z + F.lit(w)
            elif test == "kind":
                z = z + F.when(span["kind"] == arg[0], F.lit(w)).otherwise(F.lit(0.0))
            elif test == "bucket":
                z = z + F.when(span["bucket"] == arg[0], F.lit(w)).otherwise(F.lit(0.0))
            else:
                z = z + F.when(F.substring(span["votes"], arg[0] + 1, 1) == str(arg[1]), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


_FEATURES = ([("one",)] + [("kind", k) for k in KINDS] + [("bucket", b) for b in range(4)]
             + [("vote", j, v) for j in range(len(LABELERS)) for v in (NO, YES)])


def _features(kind: str, pattern: str, bucket: int) -> list[float]:
    row = []
    for test, *arg in _FEATURES:
        row.append(1.0 if test == "one" or test == "kind" and kind == arg[0] or test == "bucket" and bucket == arg[0]
                   or test == "vote" and pattern[arg[0]] == str(arg[1]) else 0.0)
    return row


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = 60):
    """Binary Dawid-Skene on vote patterns: v (patterns x labelers), count.
    Returns (posterior, prior, [(sensitivity, specificity)])."""
    yes, no = v == YES, v == NO
    q = np.clip((yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1.0), 0.05, 0.95)
    rel, prior = None, 0.5
    for _ in range(rounds):
        prior = float((count @ q + 1.0) / (count.sum() + 2.0))
        cq, cn = count * q, count * (1 - q)
        # labelers are taken to be better than chance: 7 of 10 right before any data
        sens = (yes.T @ cq + 7.0) / ((yes | no).T @ cq + 10.0)
        spec = (no.T @ cn + 7.0) / ((yes | no).T @ cn + 10.0)
        rel = list(zip(sens.tolist(), spec.tolist()))
        z = (math.log(prior) - math.log(1 - prior) + yes @ np.log(sens / (1 - spec)) + no @ np.log((1 - sens) / spec))
        new = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return q, prior, rel


def train(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - y)) + ridge * w
        hess = (x * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(found: DataFrame, name: str = "spans") -> SpanModel:
    """Reliabilities and classifier from all candidates (counts per pattern)."""
    rows = (found.select(F.explode(name).alias("s")).groupBy("s.kind", "s.votes", "s.bucket")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "bucket").collect())
    model, x, y, c = SpanModel(), [], [], []
    for kind in KINDS:
        mine = [r for r in rows if r["kind"] == kind]
        if not mine:
            continue
        v = np.array([[int(ch) for ch in r["votes"]] for r in mine])
        n = np.array([r["n"] for r in mine], dtype=float)
        q, model.prior[kind], model.reliability[kind] = estimate(v, n)
        x += [_features(kind, r["votes"], r["bucket"]) for r in mine]
        y += q.tolist()
        c += n.tolist()
    if x:
        model.weights = train(np.array(x), np.array(y), np.array(c)).tolist()
    return model


def reported(spans: Column, model: SpanModel, at_least: float = 0.5) -> Column:
    """The spans that count: base ones and those the classifier accepts, by
    kind as listed, then start."""
    kept = F.filter(spans, lambda s: s["base"] | (model.probability(s) >= at_least))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(kept, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"),
                                                 s["kind"].alias("kind"), s["base"].alias("base")))
    return F.array_sort(keyed)


def _written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of base spans, the digest of the base spans and
    all spans as text."""
    found = candidates(docs, text_col, [F.col(id_col).alias("doc_id")])
    model = fit(found)
    rows = found.select("doc_id", reported(F.col("spans"), model).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    def count(kind):
        return F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(_written_out(base), 256).alias("base_sha256"),
                       _written_out(F.col("s")).alias("spans"))


def _redact(text: str, kinds, starts, ends) -> str:
    out, at = [], 0
    for a, b, k in sorted(zip(starts, ends, kinds)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def accepted(found: DataFrame, model: SpanModel, name: str = "spans", at_least: float = 0.5) -> set[tuple[str, str, int]]:
    """The (kind, votes, bucket) of the candidates that the classifier accepts
    (as bounded as the patterns of ``fit``)."""
    s = F.col("s")
    rows = found.select(F.explode(name).alias("s")).filter(~s["base"]).select("s.kind", "s.votes", "s.bucket").distinct()
    rows = rows.select(F.struct("kind", "votes", "bucket").alias("s")).filter(model.probability(s) >= at_least)
    return {(r["kind"], r["votes"], r["bucket"]) for r in rows.select("s.*").collect()}


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by its kind in brackets;
    same columns (``n_chars``, if there, follows the new text)."""
    names = docs.columns
    # only the candidates are written: texts would stay on disk until the scratch folder goes
    found = candidates(docs, text_col, [F.lit(1).alias("one")])
    yes = accepted(found, fit(found))

    # scan and redaction in one step: a task would hold a Python worker for either, and executors keep them
    @F.pandas_udf(T.StringType())
    def changed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            s = [x for x in scan(t) if x["base"] or (x["kind"], x["votes"], x["bucket"]) in yes]
            out.append(_redact(t, [x["kind"] for x in s], [x["start"] for x in s], [x["end"] for x in s]) if s else None)
        return pd.Series(out, dtype=object)

    rows = docs.withColumn(text_col, F.coalesce(changed(F.col(text_col).cast("string")), F.col(text_col)))
    if "n_chars" in names and text_col != "n_chars":
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)
