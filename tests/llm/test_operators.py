"""Each training-data operator against a brute-force version on awkward rows."""
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.helpers import WORDS, empty_documents, key, lower, odd_documents, odd_rows, prose
from tabsight.llm import (licenses, mixing, pii, quality, sentencepiece, simhash, token_files, topk, toxicity, warc)
from tabsight.llm.common import connected_components
from tabsight.session import scratch_path


# ------------------------------------------------------------- op1

def _library(kind=None):
    import public_tokenizers as P
    import sentencepiece as sp
    return sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_sentencepiece_ids_equal_the_library(spark):
    model, lib = sentencepiece.PieceModel.load(), _library()
    docs = odd_documents(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    coded = sentencepiece.encode(docs, model, keep=["doc_id", "word"], most=200, verify="same")     # some words outside the table
    rows = coded.withColumn("back", sentencepiece.decoded(F.col("ids"), model)).collect()
    assert len(rows) == len(odd_rows()) and all(r["same"] for r in rows)
    for r in rows:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]]
            assert list(r["ids"]) == lib.encode(text)
            assert r["back"] == text.replace("▁", " ")


_WIDE = ["a b", "a  b", " a", "a ", "", "a\n b \nc", "x▁y z", "end. of, (it) don't", "é, ç. naïve", "\n", " ", "w" * 70 + " tail", "a b"]


def test_sentencepiece_counts_equal_the_words_of_whole_texts(spark):
    model = sentencepiece.PieceModel.load()
    docs = spark.createDataFrame([(t,) for t in [*_WIDE, None]], "text string")
    got = {r["word"]: r["n"] for r in sentencepiece.word_counts(docs, model).collect()}
    want = Counter(w for t in _WIDE for w in sentencepiece.split_text(re.compile(model.pattern), t) if len(w) <= sentencepiece.LONG)
    assert got == want and want["▁a"] == 5


def test_sentencepiece_batch_equals_the_library_and_checks_texts():
    model, lib = sentencepiece.PieceModel.load(), _library()
    texts, none = pa.array(_WIDE, pa.string()), pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    words = sentencepiece._Words(none, model)
    looked = []
    words.chunk = lambda c, chunk=words.chunk: looked.append(c) or chunk(c)
    ids, before = words.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [lib.encode(t) for t in _WIDE]
    back = sentencepiece.piece_bytes(model)
    pieces = pa.array(back, pa.large_binary())
    assert all(sentencepiece.gives_texts(ids, before, pieces, back, texts))
    wrong = pa.array(["no", *_WIDE[1:]], pa.string())
    assert sentencepiece.gives_texts(ids, before, pieces, back, wrong) == [False] + [True] * (len(_WIDE) - 1)
    ids, before = words.batch(pa.array(["same words"] * 50))     # a chunk of a batch is looked up once, and once where it opens a text
    assert len(ids) == 50 * len(lib.encode("same words")) and looked.count("words") == 1


def test_word_table_reaches_the_driver_as_arrow(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words again") for i in range(3)], "doc_id long, text string")
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: pytest.fail("rows of words") if "word" in self.columns else collect(self))
    coded = sentencepiece.encode(docs, verify="same").toArrow()
    assert coded["same"].to_pylist() == [True] * 3 and coded["ids"].to_pylist() == [_library().encode("some words again")] * 3
    assert sentencepiece.encode(docs.limit(0)).toArrow().num_rows == 0


def test_sentencepiece_lattice_fold_equals_the_library(spark):
    model, lib = sentencepiece.PieceModel.load(), _library()
    rng = random.Random(3)
    words = {"▁" + w for w in prose(rng, 400).split()} | {"▁▁▁x", "▁日本語", "▁😀", "▁don", "'t", "▁a.b", "aaaaaaaaaaaaaaaa"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: list(r["ids"]) for r in sentencepiece.encode_words(df, model).collect()}
    other = sentencepiece.OtherWords(model)
    assert set(got) >= {w for w in words if w[0] == "▁"}
    for w, ids in got.items():
        if w[0] == "▁":
            assert ids == lib.encode(w[1:].replace("▁", " "))
        assert ids == other.encode(w)


def test_sentencepiece_viterbi_fold_is_optimal(spark):
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(sentencepiece.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = sentencepiece.UNIGRAM
    model = sentencepiece.PieceModel.load(proto=m.SerializeToString())
    rng = random.Random(5)
    words = {"▁" + w for w in prose(rng, 60).split() if len(w) <= 9}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table, score = model.priorities(), {i: s for i, (_, s, _) in enumerate(model.pieces)}

    def best(word):
        if not word:
            return 0.0
        return max(table[word[:n]][2] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in table)

    for r in sentencepiece.encode_words(df, model).collect():
        assert sum(score[i] for i in r["ids"]) == pytest.approx(best(r["word"]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("theanr  ▁\n.,'")), max_size=120))
def test_other_words_equal_the_library(text):
    model, lib = _models()
    split = re.findall(model.pattern, "▁" + text.replace(" ", "▁")) if text else []
    other = sentencepiece.OtherWords(model)
    assert [i for w in split for i in other.encode(w)] == lib.encode(text)


_CACHE = []


def _models():
    if not _CACHE:
        _CACHE.append((sentencepiece.PieceModel.load(), _library()))
    return _CACHE[0]


def test_long_words_fold_alike():
    model, lib = _models()
    for w in ("the" * 100, "ab" * 150, "x" * 1000, "日本" * 80):
        assert sentencepiece.OtherWords(model).encode("▁" + w) == lib.encode(w)


# ------------------------------------------------------------- op2

def _top_brute(vectors, k):
    ok = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in vectors
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted(set(ok)):
        if q % 50 == 0:
            c = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(c)[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]                       # one very common vector
    rows += [(500 + i, [float(x) + 0.01 for x in rows[50][1]]) for i in range(8)]
    rows += [(600, None), (601, []), (602, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (603, [float("inf")] * 6), (650, [0.0] * 6),
             (700, [1.0, 2.0]), (701, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("block", F.lit(2))
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), buckets=4)
    assert sorted(map(tuple, got.collect())) == _top_brute([(i, v) for i, v in rows if v != []], 5)
    none = df.filter("vec_id < 0")
    assert topk.top_k(none, none).collect() == []


def test_top_k_keeps_ids_beside_null_ids_and_repeated_rows(spark):
    high = 1 << 53
    rows = [(50, [1.0, 2.0]), (None, [9.0, 9.0]), (high + 1, [3.0, 1.0]), (high + 3, [2.0, 2.0]), (None, None)]
    rows += [(7, [0.5, 0.5])] * 40                                           # one row many times
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r)[1:3] for r in topk.top_k(df, df.filter("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(1, high + 3), (2, high + 1), (3, 7), (4, 7), (5, 7)]
    with pytest.raises(Exception, match="too large for exact"):
        big = spark.createDataFrame([(50, [1e30]), (51, [1e30])], "vec_id long, embedding array<double>")
        topk.top_k(big, big).collect()


def test_top_k_groups_do_not_grow_with_the_queries(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    plain, most = PandasCogroupedOps.applyInPandas, 100

    def watched(self, func, schema):
        def run(key, left, right):
            assert len(right) <= most, f"{len(right)} queries in one group"
            return func(key, left, right)
        return plain(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", watched)
    got = topk.top_k(df, df.filter("vec_id % 2 = 0"), buckets=2).collect()
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    want = []
    for q in range(0, 600, 2):
        best = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def test_search_block_prunes_without_loss():
    rng = np.random.default_rng(1)
    for trial in range(60):
        d, n, m = int(rng.integers(1, 9)), int(rng.integers(1, 300)), int(rng.integers(1, 20))
        c = rng.integers(-20, 20, (n, d))
        if trial % 3 == 0:
            c[rng.integers(0, n, n // 2)] = c[0]
        q = c[rng.integers(0, n, m)] + rng.integers(-1, 2, (m, d)) if trial % 2 else rng.integers(-20, 20, (m, d))
        cids, qids = rng.permutation(n) + 100, np.arange(m) + (100 if trial % 5 == 0 else 10_000)
        s, theta, truth = q @ c.T, np.full(m, -np.inf), []
        for i in range(m):
            o = [j for j in np.lexsort((cids, -s[i])) if cids[j] != qids[i]][:5]
            truth += [(int(qids[i]), int(cids[j]), int(s[i, j])) for j in o]
            if len(o) == 5 and trial % 4:
                theta[i] = s[i, o[-1]] - trial % 7
        assert sorted(topk.search_block(q, qids, theta, c, cids, 5)) == sorted(truth)


# ------------------------------------------------------------- op3

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _base_brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-+ 0123456789()é%_", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == _base_brute(text)


@pytest.mark.parametrize("n", [5000, 4301])
def test_long_digit_runs_do_not_stop_the_scan(n):
    zero, nine = "0" * n, "9" * n
    for text in [f"x {zero}.1.1.1 y", f"1.{zero}255.1.{zero}", f"1.1.1.{nine} 10.1.1.1", f"+{nine} +{zero}1", f"{nine} {zero}-{zero}",
                 f"DE{zero}", f"a@{zero}.{nine}", f"token {zero}a{nine}"]:
        spans = pii.scan(text)
        assert [(s["kind"], s["start"], s["end"]) for s in spans if s["base"]] == pii.base_spans(text)
    assert pii.base_spans(f"x {zero}.1.1.1 y") == [("ip", 2, n + 8)]
    assert pii.base_spans(f"1.1.1.{nine}") == []


def test_personal_data_on_odd_rows(spark):
    docs = odd_documents(spark)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in rows:
        if r["doc_id"] is None:
            continue
        base = _base_brute(texts[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))
    secret = [r for r in rows if r["doc_id"] == 16][0]
    assert "secret:9:49" in secret["spans"]
    assert pii.personal_data(empty_documents(spark)).collect() == []


def test_redaction_keeps_columns_and_other_text(spark):
    docs = odd_documents(spark)
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = [r for r in out.collect() if r["doc_id"] == 15][0]
    assert row["text"] == "mail me: [EMAIL], call [PHONE] or [IP], card [CARD]."
    assert row["n_chars"] == len(row["text"])


def test_redaction_runs_one_python_step_a_task(spark):
    """Each Python step of a plan takes a worker of its own, and executors keep them all."""
    docs = odd_documents(spark)
    out = pii.redacted(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs.filter("doc_id is not null")).collect()}
    changed = {r["doc_id"] for r in out.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").filter("text <> was").collect()}
    assert changed and changed == {i for i, s in spans.items() if s}


def test_estimate_finds_the_better_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < acc, truth, ~truth) for acc in (0.95, 0.9, 0.6)], axis=1)
    v = np.where(votes, pii.YES, pii.NO)
    pats, n = np.unique(v, axis=0, return_counts=True)
    q, prior, rel = pii.estimate(pats, n.astype(float))
    assert rel[0][0] > rel[2][0] + 0.2 and abs(prior - 0.4) < 0.05


# ------------------------------------------------------------- op4

def _toxic_tables(spark, n=1500):
    rng, rows, labels = random.Random(7), [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zarkon", "moron", "blixword"]))
        rows.append((i, " ".join(words), "en", "s"))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    rows += [(n, None, None, None), (n + 1, "", "en", "s"), (None, "you idiot", "en", "s")]
    labels += [(n, 1, None), (None, 1, 1), (99_999, 1, 1), (1, 1, 7)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x")),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _toxic_tables(spark)
    rows = toxicity.score(docs, labels, trees=8, depth=3).collect()
    assert len(rows) == 1503 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 1500 and r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum((r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held) >= 0.97 * len(held)
    none = labels.limit(0)
    weak = {r["doc_id"]: r for r in toxicity.score(docs, none).collect()}
    assert weak[0]["score"] > weak[1]["score"] and len(weak) == 1503
    assert toxicity.score(docs.limit(0), none).collect() == []


def _features_plain(text, lexicon):
    """Every rate of a text, token by token, as the feature list words it."""
    text = text or ""
    if not text:
        return [0.0] * len(toxicity.FEATURES)
    tokens = re.findall(r"[^\W_]+(?:[@$!*'][^\W_]+)*", text.lower())
    n = max(1, len(tokens))

    def masks_seed(w):
        if w in toxicity.SEED or not any(c in "0123456789@$!*" for c in w):
            return False
        plain = "".join(c for c in w.translate(str.maketrans("013457@$!", "oieastasi")) if c.isalnum() or c == "_")
        return plain != w and plain in toxicity.SEED or "*" in w and any(
            len(s) == len(w) and s[0] == w[0] and s[-1] == w[-1] for s in toxicity.SEED)

    def stem_odds(w):
        return 0.0 if w in lexicon else max([lexicon.get(w[:k] + "*", 0.0) for k in (5, 6, 7) if len(w) >= k] or [0.0])

    seed = [w in toxicity.SEED for w in tokens]
    masked, term = [masks_seed(w) for w in tokens], [w in lexicon for w in tokens]
    stem = [stem_odds(w) > 0 for w in tokens]
    person = [w in toxicity.SECOND_PERSON for w in tokens]
    hot = [a or b or c or d for a, b, c, d in zip(seed, masked, term, stem)]
    near = sum(hot[i] and not person[i] and any(person[max(0, i - 5):i + 6]) for i in range(len(tokens)))
    runs = ["".join(g) for single, g in itertools.groupby(tokens, lambda t: len(t) == 1 and t.isalpha()) if single]
    spelled = sum(len(r) >= 4 and (r in toxicity.SEED or r in lexicon) for r in runs)
    caps = sum(c.isupper() for c in text)
    marks = sum(text.count(c) for c in "!?")
    doubled = sum(len(r) // 2 for c in "!?" for r in re.findall(re.escape(c) + "+", text))
    weight = sum(lexicon.get(w, 0.0) + stem_odds(w) for w in tokens)
    return [sum(seed) / n, math.log1p(sum(seed)), sum(term) / n, sum(stem) / n, weight / n, math.log1p(sum(term) + sum(stem)),
            near / n, sum(person) / n, caps / max(1, sum(c.isalpha() for c in text)),
            sum(len(w) > 1 and w.isupper() for w in text.split()) / n, marks / n, doubled / n, sum(masked) / n, spelled / n,
            math.log1p(len(tokens))]


def test_toxic_features_equal_a_plain_count():
    rng = random.Random(12)
    lexicon = {"grumble": 2.5, "zork": 3.0, "blath*": 2.1, "blather*": 4.0, "you": 2.2}
    parts = ["you", "YOUR", "idiot", "1d1ot", "m*ron", "sh!t", "zork", "Blathering", "blathy", "grumble", "i d i o t", "z o r k",
             "the", "house", "É", "été", "ÇA", "!!!", "??!", "x_y", "12", "a'b", "f*ck", "\n", ".", "word", "du", "S", "tú"]
    for n in [0, 1, 2, 3] * 30 + [20] * 200 + [300] * 20:
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "", ", ", "\t"]) for _ in range(n))
        for words in (lexicon, {}):
            assert toxicity.features(text, words) == pytest.approx(_features_plain(text, words)), text


def test_toxicity_features_see_disguise():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d1ot and a m*ron! i d i o t", {})))
    assert f["masked_density"] > 0 and f["spelled_density"] > 0 and f["person_density"] > 0
    assert toxicity.features(None, {}) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_fit_keeps_rare_labels(spark):
    docs, labels = _toxic_tables(spark, 3000)
    rare = labels.filter("toxic = 0 or doc_id % 12 = 0")      # about 250 toxic rows
    rows = toxicity.labelled(docs, rare, "doc_id", "text", 400).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    got = {r["toxic"]: (r["n"], round(r["w"])) for r in rows.collect()}
    all_rows = {r["toxic"]: r["n"] for r in toxicity.labelled(docs, rare, "doc_id", "text", 10_000).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n for n, _ in got.values()) == 400 and got[1][0] == min(200, all_rows[1])
    assert {t: w for t, (_, w) in got.items()} == all_rows
    assert toxicity.fit(docs, rare, most=400, trees=2, depth=2).trees is not None


def test_toxicity_rates_do_not_jump_with_length():
    short, long = (dict(zip(toxicity.FEATURES, toxicity.features("ABc 12, de. " * n, {}))) for n in (10, 1000))
    assert short["capitals"] == long["capitals"] == 0.4


# ------------------------------------------------------------- op5

def _fp_brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 13]
    docs = odd_documents(spark).filter("doc_id is null or doc_id <> 13")
    got = simhash.near_duplicates(docs).collect()
    fps = [_fp_brute(r[1]) for r in rows]
    label = _groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    least = defaultdict(list)
    for r, g in zip(rows, label):
        if r[0] is not None:
            least[g].append(r[0])
    want = [(r[0], f"{f:016x}", min(least[g], default=None)) for r, f, g in zip(rows, fps, label)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty_documents(spark)).collect() == []


def test_simhash_links_planted_fingerprints(spark):
    rng = random.Random(4)
    pts = {rng.getrandbits(64) for _ in range(800)}
    for p in list(pts)[:200]:
        for _ in range(rng.randint(1, 4)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                p ^= 1 << b
            pts.add(p)
    pts = sorted(pts)
    a = np.array(pts, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    want = _groups(len(pts), zip(*np.nonzero(np.triu(near, 1))))
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    old = simhash.LEAF_POINTS, simhash.LEAF_SAMPLE, simhash.LEAF_ROOT, simhash.CELL
    simhash.LEAF_POINTS, simhash.LEAF_SAMPLE, simhash.LEAF_ROOT, simhash.CELL = 30, 8, 1, 40    # deep tree, split shards
    try:
        got = {r["fp"]: r["label"] for r in simhash.classes(df).collect()}
    finally:
        simhash.LEAF_POINTS, simhash.LEAF_SAMPLE, simhash.LEAF_ROOT, simhash.CELL = old
    signed = a.view(np.int64).tolist()
    size = Counter(want)
    classes = defaultdict(set)
    for x, g in zip(signed, want):
        if size[g] > 1:
            classes[g].add(x)
    mine = defaultdict(set)
    for x, g in got.items():
        mine[g].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, classes.values()))


def test_one_per_group(spark):
    docs = odd_documents(spark)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    comp = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    rows = kept.collect()
    n_groups = len({(c, None if c is not None else f) for (_, f), c in comp.items()})
    assert len(rows) == n_groups
    assert all(r["doc_id"] in comp.values() or r["doc_id"] is None for r in rows)
    assert simhash.one_per_group(empty_documents(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(n)} == {0} and {got[i] for i in (1000, 1001, 1002)} == {1000}


# ------------------------------------------------------------- op6

def _targets_brute(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not full:
            target.update({s: level * w[s] for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_hits_its_targets(spark):
    docs = odd_documents(spark)
    rows = mixing.mixed_ledger(docs).collect()
    brute = [(r[0], len(WORDS.findall(r[1] or "")), r[3]) for r in odd_rows()]
    sizes = Counter()
    for _, n, s in brute:
        sizes[s] += n
    target = _targets_brute(sizes)
    assert sorted(key((r["doc_id"], r["size"])) for r in rows) == sorted(key(x[:2]) for x in brute)
    by_size = {sizes[s]: s for s in sizes}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in rows:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mixed_ledger(docs.repartition(5)).collect()
    assert sorted(map(key, map(tuple, rows))) == sorted(map(key, map(tuple, again)))
    assert mixing.mixed_ledger(empty_documents(spark)).collect() == []


def test_mixed_documents_repeat_and_cut_rows(spark):
    docs = odd_documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = defaultdict(set)
    for r in odd_rows():
        texts[r[0]].add(r[1])
    words, rows = Counter(), out.collect()
    for r in rows:
        assert any(t is not None and t.startswith(r["text"]) for t in texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and r["text"]
        words[r["source"]] += len(WORDS.findall(r["text"]))
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    for s, t in _targets_brute(sizes).items():
        assert abs(words[s] - t) <= 1


def test_mix_cuts_the_global_order_at_the_budget(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400) / 100, rng.randrange(1, 30)) for _ in range(3000)]
    packets = spark.createDataFrame(rows, "finish double, words long").repartition(7)
    sums = Counter()
    for finish, words in rows:
        sums[finish] += words
    for budget in (0, 1, 500, 20_000, sum(sums.values()), 10**9):
        total, want = 0, -1.0
        for finish in sorted(sums):
            total += sums[finish]
            if total > budget:
                break
            want = finish
        assert mixing.cut_time(packets, budget) == want
    assert mixing.cut_time(packets.limit(0), 5) == -1.0
    # a mix takes what finishes first over all sources, and the whole budget
    docs = odd_documents(spark)
    served = mixing.mix(docs).select("mix_source_size", "mix_target", F.explode("mix_served").alias("x")).collect()
    targets = {r["mix_source_size"]: int(r["mix_target"]) for r in mixing.mix(docs).collect()}
    assert sum(r["x"]["words"] for r in served) == sum(targets.values())
    assert max(r["x"]["finish"] for r in served) <= 1


# ------------------------------------------------------------- op7

def _pages(spark):
    big, other = "<p>" + "é" * 700 + "</p>", "<p>" + "x" * 2000 + "</p>"
    rng = random.Random(9)
    huge = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(200_000))
    rows = [(1, "http://a.example.com/x", big), (2, "https://b.example.com:8080/x?y=1", big), (3, None, big), (4, "http://a.example.com/x", "small"),
            (5, "http://c.example.org", "small"), (6, "", None), (7, "http://d.example.org/\r\nWARC/1.0", ""), (8, "http://e.example/é ü", other),
            (9, "http://user@f.example/", huge), (9, "http://user@f.example/", huge), (10, "x", "WARC/1.1\r\n\r\n" + other),
            (-5, "http://g.example", other), (None, "http://h.example", "none"), (11, "http://A.example.com/x", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).repartition(3), rows


def test_warc_round_trip(spark):
    pages, rows = _pages(spark)
    path = scratch_path(spark, "warc_test")
    warc.write_archives(pages, f"{path}/a")
    warc.write_index(spark, f"{path}/a", f"{path}/i")
    got = warc.read_back(spark, f"{path}/a", f"{path}/i", pages).collect()
    last, first = {}, Counter()
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    want = []
    for i, u, h in rows:
        h = h or ""
        b = h.encode()
        revisit = h in last and (last[h] != i or first[(h, i)] > 0)
        first[(h, i)] += 1
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    one = spark.createDataFrame([(warc.capture_key("http://c.example.org", 5),), ("nowhere",)], "ckey string")
    places = warc.lookup(spark, f"{path}/i", one).collect()
    assert len(places) == 1
    none = pages.limit(0)
    path = scratch_path(spark, "warc_none")
    warc.write_archives(none, f"{path}/a")
    warc.write_index(spark, f"{path}/a", f"{path}/i")
    assert warc.read_back(spark, f"{path}/a", f"{path}/i", none).collect() == []


def test_warc_reads_only_the_ranges_it_needs(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    monkeypatch.setattr(warc, "FILE_BLOCKS", 3)
    rows = [(i, f"http://host{i % 17}.example/{i}", f"<p>{i} " + "word " * (i % 50)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = scratch_path(spark, "warc_ranges")
    warc.write_archives(pages, f"{path}/a")
    warc.write_index(spark, f"{path}/a", f"{path}/i")
    directory = spark.read.parquet(f"{path}/i/directory").collect()
    assert sum(r["n"] for r in directory) == 400 and max(r["n"] for r in directory) <= 10
    assert max(Counter(r["path"] for r in directory).values()) <= 3
    # everything but the asked block and the asked record is overwritten on disk
    wanted = warc.capture_key(*reversed(rows[123][:2]))
    block = next(r for r in directory if r["first_key"] <= wanted <= r["last_key"])
    _spoil_except(directory, block["path"], block["offset"], block["length"])
    places = warc.lookup(spark, f"{path}/i", spark.createDataFrame([(wanted,)], "ckey string")).collect()
    assert [r["ckey"] for r in places] == [wanted]
    record = places[0]
    _spoil_except([record], record["path"], record["offset"], record["length"])
    got = warc.read_records(spark, f"{path}/a", spark.createDataFrame(places)).collect()
    html = rows[123][2].encode()
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got] == [
        (123, len(html), hashlib.sha1(html).hexdigest())]


def _spoil_except(files, path, offset, length):
    for name in {r["path"] for r in files}:
        with open(name.removeprefix("file:").replace("//", "/"), "r+b") as f:
            size = f.seek(0, 2)
            at, n = (offset, length) if name == path else (0, 0)
            f.seek(0)
            f.write(b"?" * at)
            f.seek(at + n)
            f.write(b"?" * (size - at - n))


def test_ranges_that_touch_are_read_at_once(tmp_path, monkeypatch):
    data = bytes(range(256)) * 40
    (tmp_path / "f").write_bytes(data)
    for limit in (1, 100, 1 << 20):
        monkeypatch.setattr(warc, "READ_BYTES", limit)
        ranges = [(0, 10), (10, 90), (100, 5), (300, 700), (9000, 1240)]
        assert list(warc.read_ranges(f"file:{tmp_path}/f", ranges)) == [data[a:a + n] for a, n in ranges]
    assert list(warc.read_ranges(f"file:{tmp_path}/f", [])) == []


def test_warc_records_parse():
    payload = b"a\r\n\r\nb" * 10
    data = warc.record(3, "http://x/\n", payload, "00", None, None, 1, False)
    head, body = warc.parse(data)
    assert body == payload and head["WARC-Target-URI"] == "http://x/%0A"
    blob = warc.member(data) + warc._EMPTY + warc.member(b"second")
    parts = list(warc.members(blob))
    assert [p[2] for p in parts] == [data, b"second"] and blob[-1] == 0
    assert sum(p[1] for p in parts) == len(blob)


def test_capture_keys_sort_by_host():
    assert warc.capture_key("https://u@News.Example.com:80/a?b", 1).startswith("com,example,news)/a?b\t")
    keys = [warc.capture_key("http://x.org/", i) for i in (-3, 0, 2, 10)]
    assert keys == sorted(keys)


# ------------------------------------------------------------- op8

def _tok():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    tok.encode_special_tokens = True
    return tok


def test_token_files_equal_the_library(spark):
    docs, tok = odd_documents(spark), _tok()
    path = scratch_path(spark, "tokens_test")
    token_files.write_tokens(docs, path)
    got = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_files.digest(spark, path).collect()}
    assert len(got) == len(odd_rows())
    ids = {}
    for r in odd_rows():
        x = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        ids.setdefault(r[0], []).append((len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
    at = 0
    for (doc, start), value in sorted(got.items(), key=lambda x: x[0][1]):
        assert start == at and value in ids[doc]
        at += value[0]
    order = [d for d, _ in sorted(got, key=lambda x: x[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    some = token_files.read_tokens(spark, path, [4, 5]).collect()
    assert sorted(r["doc_id"] for r in some) == [4, 5]
    assert sum(r["n_tokens"] for r in token_files.read_metadata(spark, path).collect()) == at


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "tokens_none")
    token_files.write_tokens(empty_documents(spark), path)
    assert token_files.digest(spark, path).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\x1c\x85\xa0'sab12!?")), max_size=60), max_size=4))
def test_encoder_equals_the_library(texts):
    if not _ENCODERS:
        with open(token_files.default_tokenizer(), encoding="utf-8") as f:
            _ENCODERS.append((token_files.Encoder(f.read()), _tok()))
    enc, tok = _ENCODERS[0]
    assert [x.tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


_ENCODERS = []


def test_encoder_asks_once_for_a_word_with_and_without_its_mark():
    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        enc, tok = token_files.Encoder(f.read()), _tok()
    asked = []
    enc.one = lambda chunk, one=enc.one: asked.append(chunk) or one(chunk)
    texts = ["go wurble, wurble. wurble", "é, wurble é", "", "wurble's wurble\nwurble", "a  wurble"] * 20
    ids, before = enc.batch(pa.array(texts, pa.string()), b"\2\0\0\0")
    assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert asked.count(" wurble") == 1 and len(enc.words) < 10


def test_added_tokens_equal_the_unmodified_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b  c", "x <|endoftext|><|endoftext|>\n", "<|endoftext|",
             "plain words", "tail <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in token_files.encode(docs).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert got[0] == [505, 220, 50256, 734, 2]


# ------------------------------------------------------------- op9

def _measures_brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x0b\x1c ", max_size=80))
def test_measures_equal_brute_force(text):
    assert quality.measure(text)[:5] == _measures_brute(text)


def test_quality_ledger_policies_and_ablations(spark):
    docs = odd_documents(spark)
    entries = quality.apply_policy(quality.ledger(docs))
    rows = entries.collect()
    want = Counter((r[0], *_measures_brute(r[1])) for r in odd_rows())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(tuple(r[n] for n in names) for r in rows) == want
    for r in rows:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and r["kept"] == (r["fail_bits"] == 0)
    bits = {r.name: 1 << i for i, r in enumerate(quality.RULES)}
    for r in quality.ablations(entries).collect():
        b = bits[r["rule"]]
        assert r["n_failed"] == sum(bool(x["fail_bits"] & b) for x in rows)
        assert r["n_only"] == sum(x["fail_bits"] == b for x in rows)
        assert r["n_kept_without"] == sum(x["fail_bits"] & ~b == 0 for x in rows)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    stored = quality.stored_ledger(docs)
    second = quality.apply_policy(stored, quality.DEFAULT_2).collect()
    assert sum(r["kept"] for r in second) >= kept.count()
    dropped = bits["shouting"] | bits["one_word_dominates"]
    assert all(r["kept"] == (r["fail_bits"] & ~dropped == 0) for r in second)
    ablated = quality.with_ablation(quality.apply_policy(stored)).collect()
    assert len(ablated) == len(second)
    patterns, names = Counter(r["fail_bits"] for r in ablated), {b: n for n, b in bits.items()}
    for r in ablated:
        assert r["only_rule"] == names.get(r["fail_bits"])
        assert r["only_rule_docs"] == (patterns[r["fail_bits"]] if r["only_rule"] else None)
    lenient = quality.Policy("words", 2, ("few_words",))
    assert quality.kept_documents(docs, lenient).count() >= kept.count()
    assert quality.ledger(empty_documents(spark)).collect() == []


# ------------------------------------------------------------- op10

def _license_brute(text):
    w = licenses.template_words(text or "")
    places = [(i, v) for p, v in licenses.BASE_PHRASES.items() for k in [p.split()] for i in range(len(w)) if w[i:i + len(k)] == k]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))


def test_license_scan_equals_brute_force(spark):
    docs = odd_documents(spark)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    rows = licenses.scan(docs).collect()
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((r[0], *_license_brute(r[1])) for r in odd_rows())
    assert licenses.scan(empty_documents(spark)).collect() == []


def test_license_spans_survive_edits(spark):
    mit = licenses.TEMPLATES["mit"][0].split()
    edited = " ".join(["intro words here"] + mit[:8] + ["extra"] + mit[8:20] + mit[21:] + ["the end"])
    texts = [edited, " ".join(mit[:6]), "Licensed under CC BY-NC 4.0.", "the the of and to", "GNU Lesser General Public License under the terms of the GNU Lesser General Public License"]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["labels"] == "mit" and 0.7 <= rows[0]["score"] < 1 and rows[0]["base_labels"] == ""
    assert rows[1]["labels"] == "" and rows[1]["score"] < 0.5
    assert rows[2]["labels"] == "cc-by-nc" and rows[3]["score"] == 0
    assert rows[4]["labels"] == "gpl,lgpl"
