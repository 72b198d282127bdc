"""Small fixtures and brute-force rules shared by the tests."""
import random
import re
import string

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("fp", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("mix_size", T.StringType()),
    T.StructField("pii_spans", T.StringType()), T.StructField("near_key", T.StringType()), T.StructField("sp_text", T.StringType()),
    T.StructField("word", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("target", T.StringType()),
])


def lower(text):
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def prose(rng, n):
    syll = ["the", "an", "er", "on", "ré", "tion", "sch", "ó", "ing", "eau"]
    return " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Documents with every awkward case: nulls, empty, blank, long, repeated,
    near copies, ties, control and wide characters."""
    rng = random.Random(11)
    base = [prose(rng, 80) for _ in range(6)]
    long = prose(rng, 30_000)
    texts = [None, "", " ", "\t\n \x0b", "one", "one two", base[0], base[0], base[0] + " tail", base[1],
             base[1].replace(" ", "\n"), base[2].upper(), "x" * 5000, long, "日本語 テキスト 😀 " * 30,
             "mail me: a.b+c@mail.example.com, call +1 (555) 010-2345 or 10.20.30.40, card 4111 1111 1111 1111.",
             "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" 300.1.2.3 and 1.2.3.4.5.6.7.8.9",
             "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "mit license mit license MIT-License apache license", "a b c a b c a b c a b c", "from " * 300,
             "line one here\nline one here\n\nline one here\n \n", "you idiot, you worthless moron! " * 5,
             "\x1c odd \x85 white space　here ▁ under", base[3], base[4], base[5]]
    sources = ["b", "a", None, "c", "a", "", "é"]
    rows = [(i, t, "en" if i % 3 else None, sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((6, base[0], "en", "b", len(base[0])))          # a repeated id
    rows.append(rows[9])                                        # a repeated row
    rows.append((None, base[2], "en", None, len(base[2])))      # no id
    rows.append((None, None, None, None, None))
    return [(*r, "x", 1, "y", "z", None, "w", "v", "u", "t") for r in rows]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), DOC_SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def key(v):
    return tuple((x is not None, x) for x in v)
