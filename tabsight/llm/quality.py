"""Rule bitmask ledger for quality rules (operator 9).

``ledger`` measures every text once and evaluates every rule once: the result
holds the measurements and one failure bit per rule.  ``apply_policy`` reads
only the ledger: a policy is a named, versioned set of rules, so a new policy
or an ablation never touches the texts again (``stored_ledger`` is a table).  ``ablations`` counts, with
bitwise aggregation over distinct bit patterns, what each rule rejects, what
it alone rejects and what a policy without it would keep.

Defined cases: a null or empty text has no words and every measurement 0; a
measurement never looks at a prefix; repeated rows give repeated ledger rows;
an empty table gives an empty ledger.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import bounded_batches, written

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words",
            "n_alpha_words", "top_word"]


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measure(text: str | None) -> tuple:
    """All measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(text.count, _SPACES))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    counts = Counter(words)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    alpha = sum(c for w, c in counts.items() if w[0] > 127 or w[:1].isalpha())
    return (len(words), len(text) - spaces, sum(map(text.count, _SYMBOLS)), dup, repeated_words(words), lines,
            upper, alpha, max(counts.values(), default=0))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""
    name: str
    fails: str


# Bit k of ``fail_bits`` belongs to RULES[k]; append only, so old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("shouting", "2 * n_upper_words > n_words"),
    Rule("few_alphabetic", "10 * n_alpha_words < 5 * n_words"),
    Rule("one_word_dominates", "10 * top_word > 4 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any rule of ``rejects``."""
    name: str
    version: int
    rejects: tuple[str, ...]

    def mask(self, rules=RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(r) for r in set(self.rejects))


DEFAULT = Policy("default", 1, tuple(r.name for r in RULES))
# Version 2 keeps upper-case texts and texts led by one word (tables, refrains).
DEFAULT_2 = Policy("default", 2, tuple(r.name for r in RULES if r.name not in ("shouting", "one_word_dominates")))


def _measures(columns: list[str]):
    def run(frames):
        for pdf in frames:
            got = pd.DataFrame([measure(t) for t in pdf.pop("__text")], columns=MEASURES, index=pdf.index)
            yield pd.concat([pdf, got], axis=1)[columns + MEASURES]
    return run


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` (long) of every document."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]
                          + [T.StructField(m, T.LongType()) for m in MEASURES])
    return src.mapInPandas(_measures(["doc_id"]), schema).withColumn("fail_bits", fail_bits(rules))


def stored_ledger(docs: DataFrame, **kw) -> DataFrame:
    """The ledger as a table in the shared folder: policies and ablations read it."""
    return written(ledger(docs, **kw), "quality_ledger")


def fail_bits(rules=RULES) -> Column:
    bits = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def apply_policy(entries: DataFrame, policy: Policy = DEFAULT, rules=RULES) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy`` from the failure bits."""
    base = Policy("base", 1, BASE_RULES).mask(rules)
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(base).cast("long")) != 0
    return (entries.withColumn("base_failed", base_failed)
            .withColumn("kept", ~(hit | base_failed))
            .withColumn("policy", F.lit(f"{policy.name}@{policy.version}")))


def ablations(entries: DataFrame, policy: Policy = DEFAULT, rules=RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects,
    and documents kept with and without it.  Works on counts per distinct bit
    pattern (at most 2 ** rules rows)."""
    mask = policy.mask(rules)
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    mine = [(k, r.name) for k, r in enumerate(rules) if mask >> k & 1]
    each = patterns.select("n", hit.alias("hit"), F.explode(F.array(
        *[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(n).alias("rule")) for k, n in mine])).alias("r"))
    bit = F.col("r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("hit").bitwiseAND(bit) != 0).alias("n_failed"),
        total(F.col("hit") == bit).alias("n_only"),
        total(F.col("hit") == 0).alias("n_kept"),
        total((F.col("hit") == 0) | (F.col("hit") == bit)).alias("n_kept_without"))


def with_ablation(judged: DataFrame, policy: Policy = DEFAULT, rules=RULES) -> DataFrame:
    """Adds to each entry ``only_rule``, the rule that alone makes the policy
    reject it (else null), and ``only_rule_docs``, how many documents the
    policy would win without that rule, out of ``ablations``."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))
    only = F.coalesce(*[F.when(hit == (1 << k), F.lit(r.name)) for k, r in enumerate(rules)])
    won = F.broadcast(ablations(judged, policy, rules).select(         # one row per rule
        F.col("rule").alias("only_rule"), F.col("n_only").alias("only_rule_docs")))
    return judged.withColumn("only_rule", only).join(won, "only_rule", "left")


def kept_documents(docs: DataFrame, policy: Policy = DEFAULT, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` the policy keeps, same columns.  The verdict is taken
    row by row (no join), so repeated or null ids cannot mix verdicts."""
    @F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=MEASURES)

    bounded_batches(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("doc"), measured(F.col(text_col).cast("string")).alias("m"))
    judged = apply_policy(packed.select("doc", "m.*").withColumn("fail_bits", fail_bits()), policy)
    return judged.filter("kept").select("doc.*")
