"""Registered queries of the training-data operators and their DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import (codes, jaccard, licenses, mixing, pii, quality, ranked, sentencepiece, simhash, token_files, topk,
                          toxicity, warc)
from tabsight.llm.common import load
from tabsight.session import scratch_path


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return mixing.mixed_ledger(docs, weights=(3, 1, 2), share=1.5, cap=2.0).drop("finish")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policy versions and the ablation of the first, all from the stored ledger."""
    entries = quality.stored_ledger(load(spark, sf_dir, "documents"))
    second = quality.apply_policy(entries, quality.DEFAULT_2).withColumnRenamed("kept", "kept_v2")
    judged = quality.with_ablation(quality.apply_policy(second.drop("base_failed", "policy")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "fail_bits", "kept_v2", "only_rule", "only_rule_docs")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it again."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece.encode(docs, keep=["doc_id"], verify="round_trip")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = load(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_archives(pages, f"{path}/archives")
    warc.write_index(spark, f"{path}/archives", f"{path}/index")
    return warc.read_back(spark, f"{path}/archives", f"{path}/index", pages)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    token_files.write_tokens(load(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.digest(spark, path)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=20)


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), n=5, percent=80)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(load(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_pii, op4_toxicity, op5_simhash, op6_mixing, op7_warc,
                                   op8_token_files, op9_quality, op10_licenses, op11_ranked, op12_jaccard, op13_codes)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')"


def _codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round written out: nearest entries, then floored means."""
    near = lambda book: f"""SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
            SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN {book} b ON p.part = b.part) GROUP BY 1, 2"""  # noqa: E731
    out = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, g.part, list_slice(x, g.part * len(x) // {parts} + 1, (g.part + 1) * len(x) // {parts}) AS x
            FROM v, (SELECT unnest(range({parts})) AS part) g),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS r
            FROM p) WHERE r <= {entries})"""]
    for i in range(rounds):
        out.append(f"""a{i} AS MATERIALIZED ({near(f'b{i}')}),
        m{i} AS (SELECT part, entry, list(s ORDER BY j) AS x FROM (SELECT a.part, a.entry, j, CAST(floor(sum(p.x[j]) / count(*)) AS BIGINT) AS s
            FROM a{i} a JOIN p USING (vec_id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS j) WHERE j <= len(p.x)
            GROUP BY ALL) GROUP BY 1, 2),
        b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (part, entry))""")
    return "WITH " + ",\n        ".join(out) + f""",
        f AS MATERIALIZED ({near(f'b{rounds}')}),
        c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM c JOIN v USING (vec_id), h"""


SQL: dict[str, str] = {
    "op11_ranked": f"""
        WITH d AS (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)),
        s AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS l FROM d),
        f AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM d GROUP BY 1, 2),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
              FROM f GROUP BY 1),
        q AS (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT docs FROM s)) // (SELECT l FROM s)))))::BIGINT
              AS score FROM q JOIN w USING (term) JOIN f USING (term) GROUP BY 1, 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 20""",
    "op12_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM w),
        u AS MATERIALIZED (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM s),
        l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        c AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.other = l.a)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(other) FROM c WHERE c.doc_id = s.doc_id) AS component_id FROM s""",
    "op13_codes": _codes_sql(),
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                     ('0x' || substr(md5('6:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
                     2.0 * source_size AS stop FROM s),
        l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, source
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY stop / weight, source
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT min_by(level, stop / weight) FILTER (level < stop / weight) AS water FROM l),
        t AS (SELECT source, source_size, least(stop, coalesce(water * weight, stop)) AS target FROM l, f),
        q AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, floor(target) - ahead))
                + greatest(0, least(size, floor(target) - ahead - source_size)))::BIGINT AS taken FROM q""",
    "op9_quality": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        v AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u
              WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM v WHERE c IS NOT NULL),
        r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
              FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM g WHERE n > 1) GROUP BY 1),
        t AS (SELECT doc_id, max(n) AS top_word, sum(n) FILTER (strlen(word) > 1 AND regexp_matches(word, '[A-Z]')
                AND NOT regexp_matches(word, '[a-z]')) AS n_upper,
                sum(n) FILTER (regexp_matches(word, '^[A-Za-z]') OR unicode(word) > 127) AS n_alpha
              FROM (SELECT doc_id, word, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
        m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                coalesce(n_lines, 0) AS n_lines, coalesce(n_upper, 0) AS n_upper, coalesce(n_alpha, 0) AS n_alpha,
                coalesce(top_word, 0) AS top_word
              FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)),
        b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
                + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
                + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT + 32 * (2 * n_upper > n_words)::BIGINT
                + 64 * (10 * n_alpha < 5 * n_words)::BIGINT + 128 * (10 * top_word > 4 * n_words)::BIGINT AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
               fail_bits = 0 AS kept, fail_bits, fail_bits & 95 = 0 AS kept_v2, o.rule AS only_rule,
               CASE WHEN o.rule IS NOT NULL THEN count(*) OVER (PARTITION BY fail_bits) END AS only_rule_docs
        FROM b LEFT JOIN (VALUES (1, 'few_words'), (2, 'repeated_windows'), (4, 'symbols'), (8, 'duplicate_lines'), (16, 'word_length'),
               (32, 'shouting'), (64, 'few_alphabetic'), (128, 'one_word_dominates')) o(bit, rule) ON bit = fail_bits""",
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
                     max(page_id) OVER (PARTITION BY h) AS last_id, count(*) OVER (PARTITION BY h) AS n FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM g""",
}
