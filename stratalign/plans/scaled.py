"""Queries of the operators that hold at any size: selection, interval joins, stars, variants; each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalign.functions import text as X
from stratalign.operators import compare as CM
from stratalign.operators import intervals as IN
from stratalign.operators import quantiles as QU
from stratalign.operators import stars as ST
from stratalign.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


POINTS = (0.01, 0.25, 0.5, 0.75, 0.9, 0.999)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(f"quantile_cont(l_extendedprice, {p}) AS {QU.point_name(p)}" for p in POINTS) + " FROM lineitem GROUP BY ALL")
def price_quantiles(spark, d):
    """Quantiles of prices by flag and status: exact, linear, by selection."""
    return QU.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", POINTS, ["l_returnflag", "l_linestatus"])


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"quantile_cont(value, {p}) AS {QU.point_name(p)}" for p in POINTS) + " FROM events WHERE value IS NOT NULL GROUP BY ALL")
def event_value_quantiles(spark, d):
    return QU.exact_quantiles(table(spark, d, "events"), "value", POINTS, ["event_type"])


def part_intervals(spark: SparkSession, d: str) -> DataFrame:
    """An interval of days for every part, of a few days to several years; brands are the groups and part keys the order."""
    p = F.col("p_partkey")
    start = F.date_add(F.lit("1992-01-01").cast("date"), (p * 37 % 2400).cast("int"))
    length = F.when(p % 10 == 0, p % 1500).otherwise(p % 40).cast("int")
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), p.alias("part"), start.alias("start"), F.date_add(start, length).alias("end"))


PARTS_SQL = "iv AS (SELECT p_brand AS brand, p_partkey AS part, CAST(DATE '1992-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) AS DATE) AS s, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 1500 ELSE p_partkey % 40 END AS l FROM part)"


@query(f"""WITH {PARTS_SQL}, b AS (SELECT brand, part, s, CAST(s + CAST(l AS INTEGER) AS DATE) AS e FROM iv),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT d, brand, min(part) AS part FROM d JOIN b ON d > s AND d <= e GROUP BY ALL)
SELECT o_orderkey, brand, part FROM orders JOIN f ON CAST(o_orderdate AS DATE) = d""")
def interval_layers(spark, d):
    """Orders against a table of intervals, the first of each brand that holds the day."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return IN.first_match(o, "day", part_intervals(spark, d), "brand", ["part"]).select("o_orderkey", "brand", "part")


@query(f"""WITH {PARTS_SQL}, b AS (SELECT part, s, CAST(s + CAST(l AS INTEGER) AS DATE) AS e FROM iv), d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT part, CAST(sum(n) AS BIGINT) AS n_orders FROM d JOIN b ON d > s AND d <= e GROUP BY part""")
def interval_counts(spark, d):
    """Orders in each part's interval, by running totals along the days; matches are too many to be formed."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return IN.interval_totals(o, "day", part_intervals(spark, d)).groupBy("part").agg(F.sum("n").alias("n_orders"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || (o_orderkey % 5000) AS b FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 7 = o_orderkey % 7),
v AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), reach(x, y) AS (SELECT x, x FROM v UNION SELECT r.x, v.y FROM reach r JOIN v ON r.y = v.x)
SELECT x AS node, min(y) AS label FROM reach GROUP BY x""")
def star_labels(spark, d):
    """Components of customers and packets of orders, by star contraction."""
    o = table(spark, d, "orders").filter((F.col("o_orderkey") % 3 == 0) & (F.col("o_custkey") % 7 == F.col("o_orderkey") % 7))
    e = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("o_orderkey") % 5000).cast("string")).alias("b"))
    return ST.star_components(e).labels


@query("SELECT x, printf('%.12g', x) AS canon FROM (SELECT DISTINCT l_extendedprice * l_discount / 7e0 * 10e0 ** (l_linenumber * 3 - 12) AS x FROM lineitem)")
def canon_product(spark, d):
    """``%.12g`` of products of many magnitudes, for every line."""
    x = F.col("l_extendedprice") * F.col("l_discount") / F.lit(7.0) * F.pow(F.lit(10.0), (F.col("l_linenumber") * 3 - 12).cast("double"))
    return table(spark, d, "lineitem").select(x.alias("x")).distinct().select("x", X.canon_float(F.col("x")).alias("canon"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 79 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0)
SELECT o_orderkey, 'left_only' AS difference, NULL::VARCHAR AS "column", NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT -1 - o_orderkey, 'right_only', NULL, NULL, NULL FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT o_orderkey, 'null_right', 'o_orderpriority', o_orderpriority, NULL FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 79 = 0
UNION ALL SELECT o_orderkey, 'value', 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR) FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0""")
def table_differences(spark, d):
    """Orders against a copy with planted differences: rows and values gone, changed, and changed within the tolerance."""
    o, k = table(spark, d, "orders").drop("o_orderdate"), F.col("o_orderkey")
    copy = o.filter(k % 97 != 0).withColumns({"o_orderpriority": F.when(k % 79 != 0, F.col("o_orderpriority")), "o_custkey": F.when(k % 89 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_totalprice": F.when(k % 83 == 0, F.col("o_totalprice") + 1e-9).otherwise(F.col("o_totalprice"))})
    more = o.filter(k % 101 == 0).withColumn("o_orderkey", -1 - k)
    return CM.compare_tables(o, copy.unionByName(more), ["o_orderkey"], {"o_totalprice": 1e-6})


@query("""WITH RECURSIVE d AS (SELECT DISTINCT coalesce(lang, '?') AS lang, sha256(text) AS t, n_chars FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
e AS (SELECT lang, 'l' || t AS x, 'r' || n_chars AS y FROM d UNION ALL SELECT lang, 'r' || n_chars, 'l' || t FROM d),
reach(lang, x, y) AS (SELECT DISTINCT lang, x, x FROM e UNION SELECT r.lang, r.x, e.y FROM reach r JOIN e ON r.lang = e.lang AND r.y = e.x),
lab AS (SELECT lang, x, min(y) AS label FROM reach GROUP BY ALL), c AS (SELECT d.lang, label, min(t) AS component, count(DISTINCT t) AS n_left, count(DISTINCT n_chars) AS n_right, count(*) AS n_pairs FROM d JOIN lab ON lab.lang = d.lang AND lab.x = 'l' || t GROUP BY ALL)
SELECT lang, component, n_left, n_right, n_pairs, CASE WHEN n_left = 1 AND n_right = 1 THEN 'one_to_one' WHEN n_left = 1 THEN 'one_to_many' WHEN n_right = 1 THEN 'many_to_one' ELSE 'many_to_many' END AS kind FROM c""")
def one_to_one_texts(spark, d):
    """Texts and lengths of each language: which stand for each other one to one."""
    t = table(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.sha2("text", 256).alias("t"), "n_chars")
    return CM.one_to_one(t, ["lang"], "t", "n_chars")
