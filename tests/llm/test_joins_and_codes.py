"""Operators 11 to 13 against brute force on awkward rows."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.helpers import WORDS, empty_documents, lower, odd_documents, odd_rows, prose
from tabsight.llm import codes, jaccard, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------- op11

def plain_ranking(docs, items, k):
    """[(item_id, rank, doc_id, score)] by scoring every document."""
    counts = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total, df = len(counts), sum(x[2] for x in counts), Counter()
    for _, c, _ in counts:
        df.update(c.keys())
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall(lower(text or ""))), []
        for doc, c, size in counts:
            m = 75 + 25 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], str(r[2])))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aZ09 .-_\x1c\x7f`")), max_size=40).filter(
    lambda t: not re.search("[\ud800-\udfff]", t)))
def test_terms_equal_the_pattern(text):
    assert [t.decode() for t in ranked.terms(text)] == TERM.findall(lower(text))


def test_ranking_equals_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 8)
    rows = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "the the an er on tion"), (2, None), (None, "mit license"), (3, ""), (4, "… --- !"), (1, "the the an er on tion"),
             (5, rows[6][1]), (6, rows[13][1]), (7, "日本語 x from idiot"), (8, "absent zzzz")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 3, 20):
        got = [tuple(r) for r in ranked.search(odd_documents(spark), asked, k).collect()]
        assert ordered(got) == ordered(plain_ranking(rows, items, k))


def test_ranking_cuts_items_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS", 2)
    monkeypatch.setattr(ranked, "SEEDS", 1)
    rng = random.Random(4)
    rows = [((1 << 53) + i, prose(rng, rng.choice([3, 30, 300]))) for i in range(120)]
    rows += [(900 + i, rows[5][1]) for i in range(30)]                          # copies: ties by id
    items = [(i, rows[7 * i][1][:80]) for i in range(9)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item long, score string").repartition(5)
    got = [tuple(r) for r in ranked.search(docs, spark.createDataFrame(items, "item_id long, text string"), 5).collect()]
    assert ordered(got) == ordered(plain_ranking(rows, items, 5))


def test_ranking_of_nothing(spark):
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(empty_documents(spark), some).count() == 0
    out = ranked.search(odd_documents(spark), some.limit(0))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_exclude_most_documents_and_no_match():
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([5, 50, 200])) for _ in range(300)]
    blocks = {}
    for i, t in enumerate(texts):
        c = Counter(ranked.terms(t))
        h = np.array([ranked.xxhash.xxh64_intdigest(x) for x in c], dtype=np.uint64)
        tf = np.array(list(c.values()))
        entries = np.concatenate([h[tf >= level] + step for level, step in zip(ranked.LEVELS, ranked._LEVEL_STEPS)])
        bits = ranked.signature_bits(len(entries))
        blocks.setdefault(bits, ranked._Block(bits)).add(i, sum(c.values()), entries)
    df = Counter(x for t in texts for x in set(ranked.terms(t)))
    total = sum(len(ranked.terms(t)) for t in texts)
    asked = ranked.Asked([(0, t, n, df[t]) for t, n in Counter(ranked.terms(texts[3])).items()], len(texts), total)
    loose = 0
    for b in blocks.values():
        row = b.row().to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], dtype="<i8")
        bound = asked.bounds(row["bits"], sizes, row["slices"])[0]
        for i, n, u in zip(b.keys, sizes, bound):
            score = asked.score(0, Counter(ranked.terms(texts[i])), int(asked.lengths(np.array([n]))[0]))
            assert u >= score
            loose += u > 1.3 * score + 1
    assert loose < 60


# ------------------------------------------------------------- op12

def plain_sets(rows, n=5):
    out = []
    for _, text in rows:
        w = WORDS.findall(lower(text or ""))
        out.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def plain_components(rows, percent=80):
    sets, root = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def joined(df, **kw):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df, **kw).collect()), key=str)


def test_jaccard_equals_brute_force_on_odd_rows(spark):
    assert joined(odd_documents(spark)) == plain_components([(r[0], r[1]) for r in odd_rows()])
    assert jaccard.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("rows_of_a_block", [4096, 7])
def test_jaccard_of_edited_copies(spark, monkeypatch, rows_of_a_block):
    """Chains, near misses and a large group around the threshold."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_of_a_block)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "SAMPLE", 64)
    rng, rows = random.Random(21), []
    passage = prose(rng, 60)
    for g in range(6):
        words = prose(rng, rng.choice([12, 60, 240])).split()
        for _ in range(40 if g == 0 else 12):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma", "Delta"])
            if rng.random() < 0.3:
                words = w                                       # drift: a chain of links
            rows.append(((1 << 53) + len(rows), " ".join(w)))
    rows += [(len(rows) + i, prose(rng, rng.choice([4, 20, 80])) + " " + passage) for i in range(40)]
    rng.shuffle(rows)
    got = joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == plain_components(rows)
    assert 8 < len({c for _, _, c in got}) < len(rows)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=90), st.sets(st.integers(0, 400), max_size=90))
def test_bit_counts_bound_the_overlap(a, b):
    def hashed(s):
        return np.sort(np.array([ranked.xxhash.xxh64_intdigest(str(x)) for x in s], dtype=np.uint64))
    x, y = hashed(a), hashed(b)
    assert jaccard.overlap(x, y) == len(a & b)
    if a and b:
        maps = jaccard.Maps([jaccard.bitmap(x), jaccard.bitmap(y)], np.array([len(a), len(b)]), 80)
        if 100 * len(a & b) >= 80 * len(a | b):
            assert list(maps.possible(0, np.array([1]))) == [1]


# ------------------------------------------------------------- op13

def plain_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype="<i4").tobytes()))
    out = {}
    for dim in {len(r[1]) for r in kept}:
        mine = [r for r in kept if len(r[1]) == dim]
        at = codes.cuts(dim, parts)
        books = [[r[1][a:b] for r in mine[:entries]] for a, b in at]

        def near(x, book):
            d = [sum((p - q) ** 2 for p, q in zip(x, e)) for e in book]
            return d.index(min(d)), min(d)
        for _ in range(rounds):
            for p, (a, b) in enumerate(at):
                own = defaultdict(list)
                for r in mine:
                    own[near(r[1][a:b], books[p])[0]].append(r[1][a:b])
                for e, xs in own.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for n, r in enumerate(mine):
            got = [near(r[1][a:b], books[p]) for p, (a, b) in enumerate(at)]
            out[dim, n] = (r[0], "".join(f"{i:02x}" for i, _ in got), sum(d for _, d in got), r[2], sha)
    total = Counter()
    for r in out.values():
        total[r[3]] += r[2]
    return sorted(((i, c, e, total[lab], s) for i, c, e, lab, s in out.values()), key=str)


def test_codes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [((1 << 53) + 2 * i + 1 if i % 7 else i, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([1, 1, 2, None])) for i in range(120)]
    rows += [(None, rows[3][1], 1), rows[5], (7, None, 1), (8, [0.1] * 15 + [None], 2), (9, [float("nan")] * 16, 2),
             (10, [float("inf")] + [0.0] * 15, 1), (11, [0.5] * 16, None), (12, [0.5] * 16, None),
             (13, [0.25, -0.5, 1.0], 3), (14, [0.2, 0.5, -1.0], 3), (15, [], 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<float>, label int, code string, dim int").repartition(4)
    assert sorted((tuple(r) for r in codes.compress(df).collect()), key=str) == plain_codes(rows)
    assert codes.compress(df.limit(0)).count() == 0


def test_codes_refuse_what_64_bits_cannot_measure(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large for exact"):
        codes.compress(df).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.integers(1, 4), st.integers(0, 10 ** 6))
def test_masks_keep_the_nearest_entry(k, d, seed):
    rng = np.random.default_rng(seed)
    span = int(rng.choice([3, 50, 10 ** 5]))
    entries, x = rng.integers(-span, span, (k, d)), rng.integers(-span, span, (50, d))
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    index, best = codes.Codebook(entries).nearest(x)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def test_masks_leave_few_entries():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-200, 200, (2000, 8))
    masks = codes.Codebook(centres).candidates(x)
    assert np.bitwise_count(masks).sum(1).mean() < 8
