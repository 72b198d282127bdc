"""Registered checks: each entry is a Spark callable over the given tables
plus, where one exists, DuckDB SQL computing the same result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profile
from ..session import table_path
from ..sources.scan import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, table_path(sf, name))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (both sides of a check use the same)."""
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- D1
register("d1_describe", _union([
    f"""SELECT '{c}' AS column_name, count({c})::BIGINT AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
       round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM lineitem"""
    for c in LI_NUM]))(
    lambda spark, sf: rounded(profile.describe(load(spark, sf, "lineitem"))))


from ..operators import clean as cleanops  # noqa: E402
from ..operators import features as featops  # noqa: E402
from ..operators import metrics as met  # noqa: E402
from ..operators import split as splitops  # noqa: E402
from ..operators import views  # noqa: E402
from ..operators.schema import align_columns, problem_type_table  # noqa: E402
from ..sources.scan import dataset_info, preview  # noqa: E402
from ..functions import scalar as fx  # noqa: E402
from ..functions.ranks import average_ranks  # noqa: E402

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def li(spark, sf):
    return load(spark, sf, "lineitem")


# ---------------------------------------------------------------- fixtures (FIXTURES.md)
def planted_nulls(spark, sf):
    d = li(spark, sf)
    return d.withColumn("l_tax", F.expr("nullif(l_tax, 0.0)")).withColumn(
        "l_returnflag", F.expr("nullif(l_returnflag, 'A')"))


PLANTED_NULLS_SQL = """SELECT * REPLACE (nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'A') AS l_returnflag)
FROM lineitem"""


def rule_scores(spark, sf):
    """planted_binary label with the rule prediction / score."""
    return li(spark, sf).select(
        *KEY, F.expr("cast(l_quantity > 25 as int)").alias("y"),
        F.expr("cast(l_discount > 0.05 as int)").alias("pred"),
        (F.col("l_discount") * 10).alias("score"),
        F.expr("least(l_discount * 10, 1.0)").alias("prob"))


RULE_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity > 25)::INT AS y,
 (l_discount > 0.05)::INT AS pred, l_discount * 10 AS score, least(l_discount * 10, 1.0) AS prob FROM lineitem"""


def multiclass(spark, sf):
    return li(spark, sf).select(
        *KEY, F.expr("cast(floor(l_quantity / 17) as int)").alias("label"),
        F.expr("cast(least(floor(l_extendedprice / 20000), 3) as int)").alias("prediction"))


MULTI_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, floor(l_quantity / 17)::INT AS label,
 least(floor(l_extendedprice / 20000), 3)::INT AS prediction FROM lineitem"""


# ---------------------------------------------------------------- A
register("a3_dataset_info", """SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_cols, 8::BIGINT AS n_numeric,
 3::BIGINT AS n_categorical, (count(*) * 11 - (count(l_orderkey) + count(l_partkey) + count(l_suppkey)
 + count(l_linenumber) + count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(l_tax)
 + count(l_returnflag) + count(l_linestatus) + count(l_shipdate)))::BIGINT AS missing_total FROM lineitem""")(
    lambda spark, sf: dataset_info(li(spark, sf)))

register("a4_preview", """SELECT * EXCLUDE (l_shipdate) FROM lineitem ORDER BY ALL LIMIT 10""")(
    lambda spark, sf: preview(li(spark, sf).drop("l_shipdate")))


# ---------------------------------------------------------------- B
register("b4_dedupe", """WITH d AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
SELECT count(*)::BIGINT AS n_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM d))::BIGINT AS n_after,
 (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)))::BIGINT AS n_dropped FROM d""")(
    lambda spark, sf: cleanops.duplicate_counts(li(spark, sf).unionByName(li(spark, sf).filter("l_linenumber = 1"))))

register("b4_drop_duplicates", f"""WITH d AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
SELECT DISTINCT {KEY_SQL}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM
 (SELECT DISTINCT * FROM d)""")(
    lambda spark, sf: cleanops.drop_duplicates(
        li(spark, sf).unionByName(li(spark, sf).filter("l_linenumber = 1"))).drop("l_shipdate").distinct())


@register("b5_impute_median", f"""WITH t AS ({PLANTED_NULLS_SQL}), m AS (SELECT quantile_cont(l_tax, 0.5) AS med FROM t)
SELECT {KEY_SQL}, round(coalesce(l_tax, med), 6) AS l_tax FROM t, m""")
def _b5(spark, sf):
    out, _, _, _ = cleanops.impute(planted_nulls(spark, sf).select(*KEY, "l_tax"))
    return rounded(out)


@register("b6_impute_mode", f"""WITH t AS ({PLANTED_NULLS_SQL}),
m AS (SELECT l_returnflag AS v FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT {KEY_SQL}, coalesce(l_returnflag, v) AS l_returnflag FROM t, m""")
def _b6(spark, sf):
    out, _, _, _ = cleanops.impute(planted_nulls(spark, sf).select(*KEY, "l_returnflag"))
    return out


@register("b7_impute_all_null", f"""SELECT {KEY_SQL}, NULL::DOUBLE AS x, 'Unknown' AS s FROM lineitem""")
def _b7(spark, sf):
    d = li(spark, sf).select(*KEY, F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("s"))
    out, _, _, _ = cleanops.impute(d)
    return out


@register("b8_label_encode", f"""SELECT {KEY_SQL},
 (dense_rank() OVER (ORDER BY l_returnflag) - 1)::BIGINT AS l_returnflag,
 (dense_rank() OVER (ORDER BY l_linestatus) - 1)::BIGINT AS l_linestatus FROM lineitem""")
def _b8(spark, sf):
    out, _ = cleanops.label_encode(li(spark, sf).select(*KEY, "l_returnflag", "l_linestatus"))
    return out.select(*KEY, F.col("l_returnflag").cast("bigint"), F.col("l_linestatus").cast("bigint"))


register("b8_label_codes", """SELECT 'l_returnflag' AS column_name, v AS value, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS code
 FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)
UNION ALL SELECT 'o_orderpriority', v, (row_number() OVER (ORDER BY v) - 1)::BIGINT
 FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)""")(
    lambda spark, sf: cleanops.label_codes(li(spark, sf), ["l_returnflag"]).withColumn("code", F.col("code").cast("bigint"))
    .unionByName(cleanops.label_codes(load(spark, sf, "orders"), ["o_orderpriority"])
                 .withColumn("code", F.col("code").cast("bigint"))))

CLEAN_FIX_SQL = f"""SELECT {KEY_SQL}, nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'A') AS l_returnflag,
 NULL::VARCHAR AS s FROM lineitem"""


@register("b9_clean_report", f"""WITH t AS ({CLEAN_FIX_SQL} UNION ALL SELECT * FROM ({CLEAN_FIX_SQL}) WHERE l_linenumber = 1),
d AS (SELECT DISTINCT * FROM t)
SELECT 'dedupe' AS step, NULL::VARCHAR AS column_name, 'drop_duplicates' AS action,
 ((SELECT count(*) FROM t) - (SELECT count(*) FROM d))::BIGINT AS n_affected, NULL::DOUBLE AS fill_number,
 NULL::VARCHAR AS fill_text
UNION ALL SELECT 'impute', 'l_tax', 'median', count(*) FILTER (WHERE l_tax IS NULL)::BIGINT,
 round(quantile_cont(l_tax, 0.5), 6), NULL FROM d
UNION ALL SELECT 'impute', 'l_returnflag', 'mode', count(*) FILTER (WHERE l_returnflag IS NULL)::BIGINT, NULL,
 (SELECT l_returnflag FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM d
UNION ALL SELECT 'impute', 's', 'unknown', count(*)::BIGINT, NULL, 'Unknown' FROM d""")
def _b9(spark, sf):
    d = li(spark, sf).select(*KEY, F.expr("nullif(l_tax, 0.0)").alias("l_tax"),
                              F.expr("nullif(l_returnflag, 'A')").alias("l_returnflag"),
                              F.lit(None).cast("string").alias("s"))
    d = d.unionByName(d.filter("l_linenumber = 1"))
    return rounded(cleanops.clean(d, encode=False).report)


register("b11_drop_null_rows", f"""SELECT {KEY_SQL}, round(l_tax, 6) AS l_tax, l_returnflag FROM ({PLANTED_NULLS_SQL})
 WHERE l_tax IS NOT NULL AND l_returnflag IS NOT NULL""")(
    lambda spark, sf: rounded(planted_nulls(spark, sf).select(*KEY, "l_tax", "l_returnflag")
                              .na.drop(subset=["l_tax", "l_returnflag"])))

register("b12_isin_top", f"""WITH top AS (SELECT CAST(l_partkey AS VARCHAR) AS v FROM lineitem GROUP BY 1
 ORDER BY count(*) DESC, 1 LIMIT 15)
SELECT {KEY_SQL} FROM lineitem WHERE CAST(l_partkey AS VARCHAR) IN (SELECT v FROM top)""")(
    lambda spark, sf: views.rows_in_top(li(spark, sf), "l_partkey", 15).select(*KEY))

register("b13_outlier_rows", f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
 quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT {KEY_SQL}, (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS is_outlier
 FROM lineitem, q""")(
    lambda spark, sf: views.outlier_rows(li(spark, sf), "l_extendedprice").select(*KEY, "is_outlier"))

register("b16_align_columns", f"""SELECT l_quantity, 0 AS missing_feature, l_orderkey FROM lineitem""")(
    lambda spark, sf: align_columns(li(spark, sf), ["l_quantity", "missing_feature", "l_orderkey"]))

register("c6_union_by_name", f"""SELECT {KEY_SQL}, round(l_tax, 6) AS l_tax FROM lineitem
UNION ALL SELECT {KEY_SQL}, NULL FROM lineitem WHERE l_linenumber = 1""")(
    lambda spark, sf: rounded(li(spark, sf).select(*KEY, "l_tax").unionByName(
        li(spark, sf).filter("l_linenumber = 1").select(*KEY), allowMissingColumns=True)))


# ---------------------------------------------------------------- D
register("d2_describe_categorical", """SELECT 'l_returnflag' AS column_name, count(l_returnflag)::BIGINT AS count,
 count(DISTINCT l_returnflag)::BIGINT AS unique,
 (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
 (SELECT count(*) FROM lineitem GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)::BIGINT AS freq
 FROM lineitem
UNION ALL SELECT 'l_linestatus', count(l_linestatus)::BIGINT, count(DISTINCT l_linestatus)::BIGINT,
 (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 (SELECT count(*) FROM lineitem GROUP BY l_linestatus ORDER BY count(*) DESC, l_linestatus LIMIT 1)::BIGINT
 FROM lineitem""")(
    lambda spark, sf: profile.describe_categorical(li(spark, sf), ["l_returnflag", "l_linestatus"]))

_DTYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
           "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
           "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
register("d3_column_profile", _union([
    (f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(DISTINCT {c})::BIGINT AS nunique,
 (count(*) - count({c}))::BIGINT AS missing, {'true' if c == 'l_extendedprice' else 'false'} AS is_target,
 round(round(min({c})::DOUBLE, 5), 6) AS min, round(round(max({c})::DOUBLE, 5), 6) AS max,
 round(round(avg({c}), 5), 6) AS mean, round(round(stddev_samp({c}), 5), 6) AS std,
 round(round(skewness({c}), 5), 6) AS skew FROM lineitem""" if t in ("bigint", "int", "double") else
     f"""SELECT '{c}', '{t}', count(DISTINCT {c})::BIGINT, (count(*) - count({c}))::BIGINT, false,
 NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM lineitem""")
    for c, t in _DTYPES.items()]))(
    lambda spark, sf: rounded(profile.column_profile(li(spark, sf), target="l_extendedprice")))

register("d3_top_values", """SELECT column_name, value, count::BIGINT AS count, rank::BIGINT AS rank FROM (
 SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS count,
  row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS rank FROM lineitem GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*),
  row_number() OVER (ORDER BY count(*) DESC, l_linestatus) FROM lineitem GROUP BY 2) WHERE rank <= 5""")(
    lambda spark, sf: profile.top_values(li(spark, sf), ["l_returnflag", "l_linestatus"], 5))


def _corr_sql(a, b, table="lineitem"):
    return (f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)")


register("d5_corr_snippet", _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(round({_corr_sql(a, b)}, 3), 6) + 0.0 AS corr FROM lineitem"
    for a in LI_NUM for b in LI_NUM]))(
    lambda spark, sf: rounded(profile.correlation_snippet(li(spark, sf))).withColumn("corr", F.col("corr") + 0.0))

register("d7_top_features", """SELECT rank::BIGINT AS rank, column_name, round(score, 6) AS score FROM (
 SELECT column_name, score, row_number() OVER (ORDER BY score DESC NULLS LAST, column_name) AS rank FROM (
 """ + _union([f"SELECT '{c}' AS column_name, abs({_corr_sql(c, 'l_extendedprice')}) AS score FROM lineitem"
               for c in LI_NUM if c != "l_extendedprice"]) + ")) WHERE rank <= 5")(
    lambda spark, sf: rounded(profile.top_features(li(spark, sf), "l_extendedprice", 5)))

register("d7_top_features_std", """SELECT rank::BIGINT AS rank, column_name, round(score, 6) AS score FROM (
 SELECT column_name, score, row_number() OVER (ORDER BY score DESC NULLS LAST, column_name) AS rank FROM (
 """ + _union([f"SELECT '{c}' AS column_name, stddev_samp({c}) AS score FROM lineitem" for c in LI_NUM])
    + ")) WHERE rank <= 5")(
    lambda spark, sf: rounded(profile.top_features(li(spark, sf), None, 5)))

register("d8_missing", "SELECT column_name, missing::BIGINT AS missing, round(round(missing * 100.0 / greatest(n, 1), 2), 6) AS pct FROM ("
         + _union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) AS n FROM ({PLANTED_NULLS_SQL})"
                   for c in _DTYPES]) + ")")(
    lambda spark, sf: rounded(profile.missing_values(planted_nulls(spark, sf))))

register("d9_corr_pearson", _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr_sql(a, b)}, 6) AS corr FROM lineitem"
    for a in LI_NUM for b in LI_NUM]))(
    lambda spark, sf: rounded(views.correlation(li(spark, sf), "pearson", LI_NUM)))

SP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_rank_cols = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in SP_COLS)
register("d9_corr_spearman", f"WITH r AS (SELECT {_rank_cols} FROM lineitem) " + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr_sql(a, b)}, 6) AS corr FROM r"
    for a in SP_COLS for b in SP_COLS]))(
    lambda spark, sf: rounded(views.correlation(li(spark, sf), "spearman", SP_COLS)))


def _hist_sql(col: str, source: str) -> str:
    return f"""WITH s AS (SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi,
 quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {source}),
w AS (SELECT *, (hi - lo) / (log2(n) + 1) AS sturges, 2 * (q3 - q1) * pow(n, -1.0 / 3) AS fd FROM s),
b AS (SELECT lo, hi, CASE WHEN hi = lo THEN 1 ELSE greatest(1, ceil((hi - lo) /
 CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END))::BIGINT END AS bins FROM w),
e AS (SELECT CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN hi = lo THEN hi + 0.5 ELSE hi END AS hi,
 bins FROM b),
g AS (SELECT range AS bin, lo + (hi - lo) * range / bins AS blo, lo + (hi - lo) * (range + 1) / bins AS bhi
 FROM e, range((SELECT bins FROM e))),
c AS (SELECT least(floor(({col} - lo) / (hi - lo) * bins)::BIGINT, bins - 1) AS bin, count(*) AS cnt
 FROM {source}, e WHERE {col} IS NOT NULL GROUP BY 1)
SELECT '{col}' AS column_name, g.bin::BIGINT AS bin, round(blo, 6) AS lo, round(bhi, 6) AS hi,
 coalesce(cnt, 0)::BIGINT AS count FROM g LEFT JOIN c ON g.bin = c.bin"""


register("d10_histogram", _hist_sql("l_extendedprice", "lineitem"))(
    lambda spark, sf: rounded(views.histogram(li(spark, sf), "l_extendedprice")))

register("d10_histogram_fixed_bins", """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
g AS (SELECT range AS bin, lo + (hi - lo) * range / 12 AS blo, lo + (hi - lo) * (range + 1) / 12 AS bhi FROM e, range(12)),
c AS (SELECT least(floor((l_quantity - lo) / (hi - lo) * 12)::BIGINT, 11) AS bin, count(*) AS cnt FROM lineitem, e GROUP BY 1)
SELECT 'l_quantity' AS column_name, g.bin::BIGINT AS bin, round(blo, 6) AS lo, round(bhi, 6) AS hi,
 coalesce(cnt, 0)::BIGINT AS count FROM g LEFT JOIN c ON g.bin = c.bin""")(
    lambda spark, sf: rounded(views.histogram(li(spark, sf), ["l_quantity"], bins=12)))


def _kde_sql(col, source, gridsize=200, cut=3.0, by=None):
    k = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH s AS (SELECT {k}count({col}) AS n, stddev_samp({col}) * pow(count({col}), -0.2) AS bw,
 min({col}) AS lo, max({col}) AS hi FROM {source} WHERE {col} IS NOT NULL {grp}),
g AS (SELECT {k}n, bw, lo - {cut} * bw AS g0, ((hi + {cut} * bw) - (lo - {cut} * bw)) / {gridsize - 1} AS step
 FROM s WHERE bw > 0),
v AS (SELECT {k}{col} AS x, count(*) AS w FROM {source} WHERE {col} IS NOT NULL GROUP BY {k}{col}),
p AS (SELECT {k}range AS i, n, bw, g0 + range * step AS gx FROM g, range({gridsize}))
SELECT {k}i::INT AS grid_index, round(gx, 6) AS x,
 round(sum(w * exp(-0.5 * ((gx - x) / bw) * ((gx - x) / bw))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM p JOIN v {on} GROUP BY {k}i, gx, n, bw"""


register("d11_kde", _kde_sql("l_quantity", "lineitem"))(
    lambda spark, sf: rounded(views.kde(li(spark, sf), "l_quantity")))

register("d13_violin_density", _kde_sql("l_quantity", "lineitem", 100, 2.0, "l_returnflag"))(
    lambda spark, sf: rounded(views.kde(li(spark, sf), "l_quantity", gridsize=100, cut=2.0, by="l_returnflag")))

BOX_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"]


def _box_sql(c, source="lineitem"):
    return f"""SELECT '{c}' AS column_name, NULL::VARCHAR AS "group", round(q1, 6) AS q1, round(med, 6) AS median,
 round(q3, 6) AS q3,
 round(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1))::DOUBLE, 6) AS whisker_lo,
 round(max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1))::DOUBLE, 6) AS whisker_hi,
 count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS n_fliers,
 count({c})::BIGINT AS n
 FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
 quantile_cont({c}, 0.75) AS q3 FROM {source}) GROUP BY q1, med, q3"""


register("d12_box", _union([_box_sql(c) for c in BOX_COLS]))(
    lambda spark, sf: rounded(views.box_stats(li(spark, sf), BOX_COLS)))

register("d13_violin_box", """WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1,
 quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS column_name, coalesce(l.l_returnflag, 'nan') AS "group", round(q1, 6) AS q1,
 round(med, 6) AS median, round(q3, 6) AS q3,
 round(min(l_quantity) FILTER (WHERE l_quantity >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
 round(max(l_quantity) FILTER (WHERE l_quantity <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
 count(*) FILTER (WHERE l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1))::BIGINT AS n_fliers,
 count(l_quantity)::BIGINT AS n
FROM lineitem l JOIN q USING (l_returnflag) GROUP BY l.l_returnflag, q1, med, q3""")(
    lambda spark, sf: rounded(views.box_stats(li(spark, sf), ["l_quantity"], by="l_returnflag")))

register("d14_group_bar", f"""SELECT l_returnflag AS "group", 'mean' AS estimator, round(avg(l_extendedprice), 6) AS value
 FROM ({PLANTED_NULLS_SQL}) GROUP BY 1""")(
    lambda spark, sf: rounded(views.group_bar(planted_nulls(spark, sf), "l_returnflag", "l_extendedprice")))

register("d14_group_bar_sum", """SELECT o_orderpriority AS "group", 'sum' AS estimator, round(sum(o_totalprice), 2) AS value
 FROM orders GROUP BY 1""")(
    lambda spark, sf: views.group_bar(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum")
    .withColumn("value", F.round("value", 2)))

register("d15_count_top", """SELECT value, count::BIGINT AS count, rank::BIGINT AS rank FROM (
 SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count,
 row_number() OVER (ORDER BY count(*) DESC, CAST(l_partkey AS VARCHAR)) AS rank FROM lineitem GROUP BY 1)
 WHERE rank <= 15""")(
    lambda spark, sf: views.count_top(li(spark, sf), "l_partkey", 15))

register("d17_line", """SELECT l_quantity, l_returnflag, round(avg(l_extendedprice), 6) AS mean,
 count(l_extendedprice)::BIGINT AS n, round(1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci
 FROM lineitem GROUP BY 1, 2""")(
    lambda spark, sf: rounded(views.line(li(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag")))

register("d19_pie", """SELECT value, count::BIGINT AS count, rank::BIGINT AS rank,
 round(count / sum(count) OVER (), 6) AS share FROM (
 SELECT o_orderpriority AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rank
 FROM orders GROUP BY 1) WHERE rank <= 8""")(
    lambda spark, sf: rounded(views.pie(load(spark, sf, "orders"), "o_orderpriority", 8)))

register("d20_crosstab", """SELECT l_returnflag AS row_value, l_linestatus AS col_value, count(*)::BIGINT AS count,
 round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS value FROM lineitem GROUP BY 1, 2""")(
    lambda spark, sf: rounded(views.crosstab(li(spark, sf), "l_returnflag", "l_linestatus", normalize=True)))

OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("d21_outliers", _union([f"""SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3,
 round(q1 - 1.5 * (q3 - q1), 6) AS lo, round(q3 + 1.5 * (q3 - q1), 6) AS hi,
 count(*) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))::BIGINT AS n_inliers,
 count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS n_outliers
 FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q3"""
                                 for c in OUT_COLS]))(
    lambda spark, sf: rounded(views.outlier_summary(li(spark, sf), OUT_COLS)))

register("d23_class_vs_feature", """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1,
 quantile_cont(c_acctbal, 0.5) AS med, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
SELECT 'c_acctbal' AS column_name, c.c_mktsegment AS "group", round(q1, 6) AS q1, round(med, 6) AS median,
 round(q3, 6) AS q3,
 round(min(c_acctbal) FILTER (WHERE c_acctbal >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
 round(max(c_acctbal) FILTER (WHERE c_acctbal <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
 count(*) FILTER (WHERE c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1))::BIGINT AS n_fliers,
 count(c_acctbal)::BIGINT AS n
FROM customer c JOIN q USING (c_mktsegment) GROUP BY c.c_mktsegment, q1, med, q3""")(
    lambda spark, sf: rounded(views.target_vs_feature(load(spark, sf, "customer"), "c_acctbal", "c_mktsegment")))

register("d24_class_balance", """SELECT c_mktsegment AS class, count(*)::BIGINT AS count,
 round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1""")(
    lambda spark, sf: rounded(views.class_balance(load(spark, sf, "customer"), "c_mktsegment")))

RESID_SQL = """(SELECT l_quantity AS x, l_extendedprice AS y,
 l_extendedprice - (regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity
 + regr_intercept(l_extendedprice, l_quantity) OVER ()) AS residual,
 regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity
 + regr_intercept(l_extendedprice, l_quantity) OVER () AS fitted FROM lineitem)"""

register("d25_residual_histogram", _hist_sql("residual", RESID_SQL))(
    lambda spark, sf: rounded(views.residual_histogram(li(spark, sf), "l_quantity", "l_extendedprice")))

register("d25_line_fit", """SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n
 FROM lineitem""")(
    lambda spark, sf: rounded(views.line_fit(li(spark, sf), "l_quantity", "l_extendedprice")))

register("d27_scale_location", f"""SELECT round(fitted, 4) AS fitted, round(sqrt(abs(residual)), 4) AS sqrt_abs_residual
 FROM {RESID_SQL}""")(
    lambda spark, sf: rounded(views.scale_location(li(spark, sf), "l_quantity", "l_extendedprice"), 4))

register("d28_feature_variance", _union([
    f"""SELECT '{c}' AS column_name, CASE WHEN var_pop({c}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS scaled_variance,
 round(var_pop({c}), 6) AS raw_variance FROM lineitem""" for c in LI_NUM if c != "l_extendedprice"]))(
    lambda spark, sf: rounded(views.feature_variance(li(spark, sf), "l_extendedprice")))


# ---------------------------------------------------------------- E
register("e1_average_rank", """SELECT l_quantity, round(rank() OVER (ORDER BY l_quantity) + (count(*) OVER
 (PARTITION BY l_quantity) - 1) / 2.0, 6) AS rank FROM lineitem GROUP BY l_quantity, l_orderkey, l_partkey,
 l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
 QUALIFY row_number() OVER (PARTITION BY l_quantity) = 1""")(
    lambda spark, sf: rounded(average_ranks(li(spark, sf), "l_quantity")))

register("e7_fold_sizes", f"""SELECT floor(('0x' || substr(md5(concat_ws('|', '43', {KEY_SQL})), 1, 8))::BIGINT
 / 4294967296.0 * 5)::INT AS fold, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")(
    lambda spark, sf: splitops.assign_folds(li(spark, sf), 5, 42, KEY, portable=True)
    .groupBy("fold").agg(F.count(F.lit(1)).alias("n")))

register("h7_split", f"""SELECT {KEY_SQL}, (('0x' || substr(md5(concat_ws('|', '42', {KEY_SQL})), 1, 8))::BIGINT
 / 4294967296.0 < 0.2) AS is_test FROM lineitem""")(
    lambda spark, sf: splitops.train_test_split(li(spark, sf).select(*KEY), 0.2, 42, KEY, portable=True))


# ---------------------------------------------------------------- F, G
register("f6_distinct_sorted", """SELECT DISTINCT c_mktsegment AS value FROM customer""")(
    lambda spark, sf: views.distinct_sorted(load(spark, sf, "customer"), "c_mktsegment"))

register("g_scalar_functions", f"""SELECT {KEY_SQL}, round(l_quantity * l_discount, 6) AS product,
 round(l_quantity * l_quantity, 6) AS square, round(sqrt(abs(l_extendedprice - 30000)), 6) AS sqrt_abs,
 round(least(greatest(l_discount * 12 - 0.1, 0), 1), 6) AS clip01,
 coalesce(nullif(l_returnflag, 'A'), 'nan') AS label_text,
 round(coalesce(nullif(l_tax, 0.0), -1.0), 6) AS filled,
 (l_linestatus = 'O')::INT AS one_vs_rest FROM lineitem""")(
    lambda spark, sf: rounded(li(spark, sf).select(
        *KEY, fx.product("l_quantity", "l_discount").alias("product"), fx.square("l_quantity").alias("square"),
        fx.sqrt_abs(F.col("l_extendedprice") - 30000).alias("sqrt_abs"),
        fx.clip01(F.col("l_discount") * 12 - 0.1).alias("clip01"),
        fx.as_label(F.expr("nullif(l_returnflag, 'A')")).alias("label_text"),
        fx.fill(F.expr("nullif(l_tax, 0.0)"), -1.0).alias("filled"),
        fx.binarise("l_linestatus", "O").alias("one_vs_rest"))))


# ---------------------------------------------------------------- H
register("h1_one_hot", """SELECT c_custkey,
 (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'FURNITURE')::INT AS c_mktsegment_FURNITURE,
 (c_mktsegment = 'HOUSEHOLD')::INT AS c_mktsegment_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::INT AS c_mktsegment_MACHINERY
 FROM customer""")(
    lambda spark, sf: featops.one_hot(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"))[0])

_H_NUM = [c for c in LI_NUM if c != "l_extendedprice"]
_H_RANK = ("WITH r AS (SELECT column_name, row_number() OVER (ORDER BY score DESC NULLS LAST) AS rk FROM ("
           + _union([f"SELECT '{c}' AS column_name, {i} AS pos, abs({_corr_sql(c, 'l_extendedprice')}) AS score "
                     f"FROM lineitem" for i, c in enumerate(_H_NUM)]) + ")), "
           "a AS (SELECT column_name FROM r WHERE rk = 1), b AS (SELECT column_name FROM r WHERE rk = 2)")


def _pick(alias):
    return "CASE " + " ".join(f"WHEN {alias}.column_name = '{c}' THEN {c}" for c in _H_NUM) + " END"


register("h2_interaction", _H_RANK + f""" SELECT {KEY_SQL}, a.column_name || '_x_' || b.column_name AS feature,
 round(({_pick('a')}) * ({_pick('b')}), 6) AS value FROM lineitem, a, b""")(
    lambda spark, sf: rounded(views.engineered_long(li(spark, sf).drop("l_returnflag", "l_linestatus", "l_shipdate"),
                                                    "l_extendedprice", KEY, "interaction")))

register("h3_square", _H_RANK + f""" SELECT {KEY_SQL}, a.column_name || '_squared' AS feature,
 round(({_pick('a')}) * ({_pick('a')}), 6) AS value FROM lineitem, a""")(
    lambda spark, sf: rounded(views.engineered_long(li(spark, sf).drop("l_returnflag", "l_linestatus", "l_shipdate"),
                                                    "l_extendedprice", KEY, "square")))

register("h6_problem_type", """SELECT 'l_extendedprice' AS target, CASE WHEN count(DISTINCT l_extendedprice) > 10
 THEN 'Regression' ELSE 'Classification' END AS problem_type FROM lineitem
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 10 THEN 'Regression'
 ELSE 'Classification' END FROM lineitem
UNION ALL SELECT 'l_returnflag', 'Classification'""")(
    lambda spark, sf: problem_type_table(li(spark, sf), "l_extendedprice").select(
        F.lit("l_extendedprice").alias("target"), "problem_type").unionByName(
        problem_type_table(li(spark, sf), "l_linenumber").select(F.lit("l_linenumber").alias("target"), "problem_type"))
    .unionByName(problem_type_table(li(spark, sf), "l_returnflag").select(
        F.lit("l_returnflag").alias("target"), "problem_type")))


# ---------------------------------------------------------------- K
register("k1_regression_metrics", """WITH t AS (SELECT 3 * l_quantity - 200 * l_discount + 5 AS y,
 3 * l_quantity + 4 AS p FROM lineitem)
SELECT round(avg((y - p) * (y - p)), 6) AS mse,
 round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
 round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(y - p), 6) AS residual_mean,
 round(stddev_pop(y - p), 6) AS residual_std FROM t""")(
    lambda spark, sf: rounded(met.regression_metrics(li(spark, sf).select(
        F.expr("3 * l_quantity - 200 * l_discount + 5").alias("label"),
        F.expr("3 * l_quantity + 4").alias("prediction")))))


def _weighted_sql(src):
    return f"""WITH t AS ({src}), cc AS (SELECT label, prediction, count(*) AS n FROM t GROUP BY 1, 2),
tr AS (SELECT label AS c, sum(n) AS support, sum(n) FILTER (WHERE label = prediction) AS tp FROM cc GROUP BY 1),
pr AS (SELECT prediction AS c, sum(n) AS predicted FROM cc GROUP BY 1),
per AS (SELECT support, coalesce(tp, 0) AS tp,
 CASE WHEN coalesce(predicted, 0) > 0 THEN coalesce(tp, 0) / predicted ELSE 0 END AS p,
 coalesce(tp, 0) / support AS r FROM tr LEFT JOIN pr USING (c))
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(support * p) / sum(support), 6) AS precision,
 round(sum(support * r) / sum(support), 6) AS recall,
 round(sum(support * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(support), 6) AS f1 FROM per"""


register("k2_weighted_metrics", _weighted_sql(MULTI_SQL))(
    lambda spark, sf: rounded(met.classification_metrics(multiclass(spark, sf))))

register("k2_binary_metrics", _weighted_sql(
    "SELECT y AS label, pred AS prediction FROM (" + RULE_SQL + ")"))(
    lambda spark, sf: rounded(met.classification_metrics(rule_scores(spark, sf), "y", "pred")))

register("k10_confusion", f"""WITH t AS ({MULTI_SQL}),
l AS (SELECT label AS v FROM t UNION SELECT prediction FROM t)
SELECT a.v AS label, b.v AS prediction, (SELECT count(*) FROM t WHERE t.label = a.v AND t.prediction = b.v)::BIGINT
 AS count FROM l a, l b""")(
    lambda spark, sf: met.confusion_matrix(multiclass(spark, sf)))

_CURVE = f"""WITH t AS ({RULE_SQL}), g AS (SELECT score, sum(y) AS tp, sum(1 - y) AS fp FROM t GROUP BY 1),
c AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp FROM g)"""

register("k11_roc_auc", _CURVE + """ SELECT round(sum(fp * (2 * (ctp - tp) + tp)) / (2.0 * sum(tp) * sum(fp)), 6)
 AS auc FROM c""")(
    lambda spark, sf: rounded(met.roc_auc(rule_scores(spark, sf))))

register("k11_roc_curve", _CURVE + """ SELECT 'Infinity'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT round(score, 6), round(cfp / (SELECT sum(fp) FROM g), 6), round(ctp / (SELECT sum(tp) FROM g), 6)
 FROM c""")(
    lambda spark, sf: rounded(met.roc_curve(rule_scores(spark, sf))))

register("k12_average_precision", _CURVE + """ SELECT round(sum(tp * ctp / (ctp + cfp)) / sum(tp), 6)
 AS average_precision FROM c""")(
    lambda spark, sf: rounded(met.average_precision(rule_scores(spark, sf))))

register("k12_pr_curve", _CURVE + """ SELECT round(score, 6) AS threshold, round(ctp / (ctp + cfp), 6) AS precision,
 round(ctp / (SELECT sum(tp) FROM g), 6) AS recall FROM c""")(
    lambda spark, sf: rounded(met.pr_curve(rule_scores(spark, sf))))

register("k13_calibration", f"""WITH t AS ({RULE_SQL}),
e AS (SELECT """ + ", ".join(f"quantile_cont(prob, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM t)
SELECT (""" + " + ".join(f"(prob > e{i})::INT" for i in range(1, 10)) + """) AS bin,
 round(avg(y), 6) AS prob_true, round(avg(prob), 6) AS prob_pred, count(*)::BIGINT AS n FROM t, e GROUP BY 1""")(
    lambda spark, sf: rounded(met.calibration(rule_scores(spark, sf), "y", "prob")))

MICRO_SRC = """SELECT floor(l_quantity / 17)::INT AS label, [l_discount * 10, l_tax * 10, l_quantity / 50] AS scores
 FROM lineitem"""
register("k14_micro_auc_ap", f"""WITH t AS ({MICRO_SRC}),
f AS (SELECT (label = k)::INT AS y, scores[k + 1] AS score FROM t, range(3) r(k)),
g AS (SELECT score, sum(y) AS tp, sum(1 - y) AS fp FROM f GROUP BY 1),
c AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp FROM g)
SELECT round(sum(fp * (2 * (ctp - tp) + tp)) / (2.0 * sum(tp) * sum(fp)), 6) AS auc,
 round(sum(tp * ctp / (ctp + cfp)) / sum(tp), 6) AS average_precision FROM c""")(
    lambda spark, sf: rounded(met.micro_auc_ap(li(spark, sf).select(
        F.expr("cast(floor(l_quantity / 17) as int)").alias("label"),
        F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50).alias("scores")),
        "label", "scores", [0, 1, 2])))

CL_SRC = "SELECT l_quantity, l_discount, floor(l_quantity / 17)::INT AS cluster FROM lineitem"


def clusters(spark, sf):
    return li(spark, sf).select("l_quantity", "l_discount",
                                F.expr("cast(floor(l_quantity / 17) as int)").alias("cluster"))


register("k5_calinski_harabasz", f"""WITH t AS ({CL_SRC}),
m AS (SELECT avg(l_quantity) AS gq, avg(l_discount) AS gd, count(*) AS n, count(DISTINCT cluster) AS k FROM t),
c AS (SELECT cluster, count(*) AS nc, avg(l_quantity) AS cq, avg(l_discount) AS cd FROM t GROUP BY 1),
b AS (SELECT sum(nc * ((cq - gq) * (cq - gq) + (cd - gd) * (cd - gd))) AS between FROM c, m),
w AS (SELECT sum((l_quantity - cq) * (l_quantity - cq) + (l_discount - cd) * (l_discount - cd)) AS within
 FROM t JOIN c USING (cluster))
SELECT round((between / (k - 1)) / (within / (n - k)), 2) AS calinski_harabasz FROM b, w, m""")(
    lambda spark, sf: rounded(met.calinski_harabasz(clusters(spark, sf), ["l_quantity", "l_discount"]), 2))

register("k6_davies_bouldin", f"""WITH t AS ({CL_SRC}),
c AS (SELECT cluster, avg(l_quantity) AS cq, avg(l_discount) AS cd FROM t GROUP BY 1),
s AS (SELECT cluster, avg(sqrt((l_quantity - cq) * (l_quantity - cq) + (l_discount - cd) * (l_discount - cd))) AS s
 FROM t JOIN c USING (cluster) GROUP BY 1),
cs AS (SELECT * FROM c JOIN s USING (cluster)),
r AS (SELECT a.cluster, max((a.s + b.s) / sqrt((a.cq - b.cq) * (a.cq - b.cq) + (a.cd - b.cd) * (a.cd - b.cd))) AS r
 FROM cs a JOIN cs b ON a.cluster <> b.cluster GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM r""")(
    lambda spark, sf: rounded(met.davies_bouldin(clusters(spark, sf), ["l_quantity", "l_discount"])))

register("k7_cluster_sizes", f"""SELECT cluster, count(*)::BIGINT AS size FROM ({CL_SRC}) GROUP BY 1""")(
    lambda spark, sf: met.cluster_sizes(clusters(spark, sf)))

register("k8_centroids", f"""SELECT cluster, 'l_quantity' AS feature, round(avg(l_quantity), 6) AS mean
 FROM ({CL_SRC}) GROUP BY 1
UNION ALL SELECT cluster, 'l_discount', round(avg(l_discount), 6) FROM ({CL_SRC}) GROUP BY 1""")(
    lambda spark, sf: rounded(met.centroids(clusters(spark, sf), ["l_quantity", "l_discount"])))

LB_SRC = """SELECT o_orderpriority AS model, avg(o_totalprice) / 100000 AS score,
 (dense_rank() OVER (ORDER BY o_orderpriority DESC))::BIGINT AS train_order FROM orders GROUP BY 1"""
register("f4_leaderboard", f"""WITH s AS ({LB_SRC})
SELECT model, round(score, 6) AS score, train_order,
 (row_number() OVER (ORDER BY score DESC NULLS LAST, train_order))::BIGINT AS position,
 round(score / greatest(max(score) OVER (), 1.0), 6) AS share_of_best,
 row_number() OVER (ORDER BY score DESC NULLS LAST, train_order) = 1 AS is_best FROM s""")(
    lambda spark, sf: rounded(met.leaderboard(
        load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
            (F.avg("o_totalprice") / 100000).alias("score")).withColumn(
            "train_order", F.dense_rank().over(__import__("pyspark.sql", fromlist=["Window"]).Window
                                               .orderBy(F.col("model").desc())).cast("bigint")))))


# ---------------------------------------------------------------- A1, A6, rows-only model and sample operators
from ..session import scratch_path  # noqa: E402
from ..sources.scan import read_csv  # noqa: E402


@register("a1_csv_scan", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber,
 round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount,
 round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus FROM lineitem""")
def _a1(spark, sf):
    path = scratch_path(spark, "lineitem_csv")
    li(spark, sf).drop("l_shipdate").write.option("header", True).csv(path)
    return rounded(read_csv(spark, path))


def _quality_table(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return load(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id").drop("doc_id")


@register("i_regression_leaderboard")
def _i_reg(spark, sf):
    from .analyze import analyze
    a = analyze(li(spark, sf), target="l_extendedprice",
                models=["linear_regression", "ridge", "lasso", "decision_tree"], n_iter=2, folds=2,
                run_views=False, post_training=False, refit=False)
    return a.leaderboard.select("model", "position", "is_best")


@register("i_classification_metrics")
def _i_cls(spark, sf):
    from .analyze import analyze
    a = analyze(_quality_table(spark, sf), target="quality",
                models=["logistic_regression", "naive_bayes", "decision_tree", "random_forest", "adaboost"], n_iter=1,
                run_views=False, refit=False, curve=False)
    return a.metrics


@register("j_clustering_metrics")
def _j(spark, sf):
    from .analyze import analyze
    emb = load(spark, sf, "embeddings")
    wide = emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    a = analyze(wide, target=None, run_views=False, models=["kmeans", "bisecting_kmeans"])
    return a.metrics


def _cluster_view(kind):
    def run(spark, sf):
        from . import cluster_views
        cust = load(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_custkey")
        return cluster_views.run(kind, cust, None, {}, {})
    return run


register("d29_pca_scatter")(_cluster_view("pca_scatter"))
register("d30_elbow")(_cluster_view("elbow_curve"))
register("d31_silhouette")(_cluster_view("silhouette_plot"))
register("d32_cluster_sizes")(_cluster_view("cluster_size_bar"))

register("d16_scatter")(lambda spark, sf: views.scatter(li(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag"))
register("d18_pairplot")(lambda spark, sf: views.pairplot(li(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"],
                                                          "l_returnflag"))
register("d26_qq")(lambda spark, sf: rounded(views.qq_points(li(spark, sf), "l_quantity", "l_extendedprice")))


@register("l1_score_batch")
def _l1(spark, sf):
    from .analyze import analyze, score
    cust = load(spark, sf, "customer")
    a = analyze(cust, target="c_mktsegment", models=["logistic_regression", "decision_tree"], n_iter=1,
                run_views=False, post_training=False)
    return score(a, cust.drop("c_mktsegment")).select("c_custkey", "predicted_value")


@register("l4_score_stream")
def _l4(spark, sf):
    from ..streaming.score_stream import read_stream, run_to_table, score_stream
    from .analyze import analyze
    cust = load(spark, sf, "customer")
    a = analyze(cust, target="c_mktsegment", models=["logistic_regression"], n_iter=1,
                run_views=False, post_training=False)
    src = table_path(sf, "customer")
    stream = read_stream(spark, sf, spark.read.parquet(src).schema, glob="customer.parquet").drop("c_mktsegment")
    out, ckpt = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    q = run_to_table(score_stream(a, stream).select("c_custkey", "predicted_value"), out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out)


@register("a6_model_roundtrip")
def _a6(spark, sf):
    from ..sources.sinks import load_model, save_model
    from .analyze import analyze
    cust = load(spark, sf, "customer")
    a = analyze(cust, target="c_acctbal", models=["linear_regression"], n_iter=1, run_views=False,
                post_training=False)
    path = scratch_path(spark, "feature_model")
    save_model(a.state["feature_model"], path)
    fm = load_model(path)
    from .analyze import apply_features
    x = apply_features(cust, a.state)
    from ..models.preprocess import with_bool_ints
    return fm.transform(with_bool_ints(x, a.state["features"])).select(
        "c_custkey", F.size(__import__("pyspark.ml.functions", fromlist=["vector_to_array"])
                            .vector_to_array("features")).alias("n_features"))


DG_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("d22_distribution_grid", _union([f"SELECT * FROM ({_hist_sql(c, 'lineitem')})" for c in DG_COLS]))(
    lambda spark, sf: rounded(views.histogram(li(spark, sf), DG_COLS)))

register("d22_histogram_density_grid", _union(
    [f"""SELECT column_name, 'histogram' AS kind, bin AS position, round((lo + hi) / 2, 3) + 0.0 AS x, count::DOUBLE AS value
 FROM ({_hist_sql(c, 'lineitem')})
 UNION ALL SELECT '{c}', 'density', grid_index::BIGINT, round(x, 3) + 0.0, density FROM ({_kde_sql(c, 'lineitem')})""" for c in DG_COLS]))(
    lambda spark, sf: rounded(views.distribution_grid(li(spark, sf), DG_COLS)).withColumn("x", F.round("x", 3) + 0.0))

register("d37_dataset_summary")(lambda spark, sf: profile.dataset_summary(li(spark, sf)))


def _vectors(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    d = li(spark, sf).select("l_quantity", "l_discount", "l_tax", "l_extendedprice",
                             F.xxhash64(*[F.col(c) for c in li(spark, sf).columns]).alias("__row"))
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(
        d).withColumn("label", F.col("l_extendedprice"))


@register("k16_learning_curve")
def _k16(spark, sf):
    from pyspark.ml.regression import LinearRegression
    from ..models.supervised import learning_curve
    return learning_curve(LinearRegression(), _vectors(spark, sf), "Regression", folds=3)


@register("k18_model_params")
def _k18(spark, sf):
    from ..models.supervised import params_table, train_supervised
    t = train_supervised(_vectors(spark, sf), "Regression", 0, 3, ["ridge", "decision_tree"], n_iter=2, folds=2)
    return params_table(spark, t)


# ---------------------------------------------------------------- B1, B15, L2, H4
from ..operators.schema import numeric_columns  # noqa: E402

register("b1_select_numeric", f"""SELECT {KEY_SQL}, round(l_quantity, 6) AS l_quantity,
 round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax
 FROM lineitem""")(
    lambda spark, sf: rounded(li(spark, sf).select(*numeric_columns(li(spark, sf)))))

NOISE_SRC = """SELECT CASE WHEN l_quantity > 45 THEN -1 ELSE floor(l_quantity / 17)::INT END AS cluster FROM lineitem"""
register("b15_noise_mask", f"""SELECT cluster, count(*)::BIGINT AS size FROM ({NOISE_SRC}) WHERE cluster <> -1
 GROUP BY 1""")(
    lambda spark, sf: met.cluster_sizes(li(spark, sf).select(
        F.expr("CASE WHEN l_quantity > 45 THEN -1 ELSE cast(floor(l_quantity / 17) as int) END").alias("cluster"))
        .filter(F.col("cluster") != -1)))


@register("l2_decode_labels", f"""SELECT {KEY_SQL}, l_returnflag AS decoded FROM lineitem""")
def _l2(spark, sf):
    d = li(spark, sf).select(*KEY, "l_returnflag")
    enc, codes = cleanops.label_encode(d, ["l_returnflag"])
    inv = codes.filter(F.col("column_name") == "l_returnflag").select(
        F.col("code").alias("l_returnflag"), F.col("value").alias("decoded"))
    return enc.join(F.broadcast(inv), "l_returnflag").select(*KEY, "decoded")  # code table: 3 rows


@register("h4_feature_report")
def _h4(spark, sf):
    res = featops.engineer(load(spark, sf, "customer").drop("c_name"), "c_acctbal")
    return featops.feature_report(spark, res)


from . import catalog_models  # noqa: E402,F401  (registers the model checks)
from . import catalog_planted  # noqa: E402,F401
