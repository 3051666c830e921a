"""Registered queries: one for each operator, with the SQL that states its result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .computed import ComputedFields
from .fluent import Query, rule
from .functions.buckets import parse_bucket
from .operators.snapshot import SnapshotComparison
from .plans.spec import Clause, JoinKind, Metric, OrderKey, Separator, Sort, WindowFunction
from .reports import chart, stats
from .sources.sinks import to_maps
from .sql.cursor import Cursor
from .sql.query import parse

C, S, W = Clause, Sort, WindowFunction
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return Query.of(table(spark, sf_dir, name))


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINE_SQL = ", ".join(LINE)


# -- filters -------------------------------------------------------------
@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf_dir):
    return _query(spark, sf_dir, "orders").where("o_orderstatus", C.EQUAL, "F").select("o_orderkey", "o_totalprice").rows()


@register("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY'")
def filter_ne(spark, sf_dir):
    """A flat NOT_EQUAL leaves nulls out."""
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Query.of(df).where("segment", C.NOT_EQUAL, "MACHINERY").select("c_custkey", "segment").rows()


@register("""SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer
WHERE (nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY' OR nullif(c_mktsegment, 'BUILDING') IS NULL) AND c_acctbal > 0""")
def filter_ne_grouped(spark, sf_dir):
    """Inside a group or an AND/OR tree NOT_EQUAL holds for nulls."""
    df = table(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return parse("select c_custkey, segment where segment != 'MACHINERY' and c_acctbal > 0").rows(df)


@register(f"SELECT {LINE_SQL}, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'")
def filter_range(spark, sf_dir):
    q = _query(spark, sf_dir, "lineitem").where("l_quantity", C.BIGGER_EQUAL, 10).where("l_quantity", C.SMALLER, 20)
    return q.where("l_shipdate", C.BIGGER_EQUAL, "1997-01-01 00:00:00").select(*LINE, "l_quantity").rows()


@register("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20")
def filter_not_smaller(spark, sf_dir):
    return _query(spark, sf_dir, "part").where("p_size", C.NOT_SMALLER, 10).where("p_size", C.NOT_BIGGER, "20").select("p_partkey", "p_size").rows()


@register("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ed w')")
def filter_contains(spark, sf_dir):
    return _query(spark, sf_dir, "part").where("p_name", C.CONTAINS, "ed w").select("p_partkey", "p_name").rows()


@register("SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, '.*[05]')")
def filter_matches(spark, sf_dir):
    return _query(spark, sf_dir, "customer").where("c_name", C.MATCHES, ".*[05]").select("c_custkey", "c_name").rows()


@register("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in_list(spark, sf_dir):
    return _query(spark, sf_dir, "nation").where("n_regionkey", C.IN, [1, "3", None]).select("n_nationkey", "n_name").rows()


@register("SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_size NOT IN (45, 50)")
def filter_collection_negated(spark, sf_dir):
    return _query(spark, sf_dir, "part").where("p_size", C.NOT_EQUAL, [45, 50]).where("p_size", C.BIGGER, [60, 40]).select("p_partkey", "p_size").rows()


@register("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '1-URGENT') IS NULL")
def filter_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return Query.of(df).where("p", C.EQUAL, None).select("o_orderkey").rows()


@register("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
def filter_flat_or(spark, sf_dir):
    q = _query(spark, sf_dir, "orders").where("o_orderstatus", C.EQUAL, "O").where("o_orderpriority", C.EQUAL, "1-URGENT", Separator.OR)
    return q.where("o_totalprice", C.BIGGER, 100000).select("o_orderkey").rows()


@register("""SELECT o_orderkey FROM orders WHERE ((o_orderstatus = 'F' AND o_totalprice > 50000) OR (o_orderstatus = 'O' AND o_totalprice < 20000))
AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')""")
def filter_allof_anyof(spark, sf_dir):
    q = _query(spark, sf_dir, "orders").all_of(rule("o_orderstatus", C.EQUAL, "F"), rule("o_totalprice", C.BIGGER, 50000))
    q = q.all_of(rule("o_orderstatus", C.EQUAL, "O"), rule("o_totalprice", C.SMALLER, 20000))
    return q.any_of(rule("o_orderpriority", C.EQUAL, "1-URGENT"), rule("o_orderpriority", C.EQUAL, "2-HIGH")).select("o_orderkey").rows()


@register(f"SELECT {LINE_SQL} FROM lineitem WHERE l_extendedprice * (1 - l_discount) >= 50000")
def filter_expr(spark, sf_dir):
    return parse(f"select {LINE_SQL} where l_extendedprice * (1 - l_discount) >= 50000").rows(table(spark, sf_dir, "lineitem"))


@register("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03'")
def filter_date_format(spark, sf_dir):
    return _query(spark, sf_dir, "orders").where("o_orderdate", C.EQUAL, "1996-03", date_format="yyyy-MM").select("o_orderkey").rows()


@register("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_totalprice > 1000")
def in_subquery(spark, sf_dir):
    text = "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) and o_totalprice > 1000"
    return parse(text).rows(table(spark, sf_dir, "orders"), {"customer": table(spark, sf_dir, "customer")})


@register("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderstatus = 'P'")
def in_subquery_or(spark, sf_dir):
    text = "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) or o_orderstatus = 'P'"
    return parse(text).rows(table(spark, sf_dir, "orders"), {"customer": table(spark, sf_dir, "customer")})


# -- projections ---------------------------------------------------------
@register("SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def project_alias(spark, sf_dir):
    return parse("select c_custkey as id, c_name as name, c_acctbal").rows(table(spark, sf_dir, "customer"))


@register(f"SELECT {LINE_SQL}, round(l_extendedprice * (1 - l_discount), 4) AS net, round_even(l_quantity / 4, 0) AS q4, floor(l_tax * 100) AS fl, ceil(l_tax * 33) AS ce, abs(l_discount - 0.05) AS ab FROM lineitem")
def project_computed(spark, sf_dir):
    text = f"select {LINE_SQL}, l_extendedprice * (1 - l_discount) as net, round(l_quantity / 4) as q4, floor(l_tax * 100) as fl, ceil(l_tax * 33) as ce, abs(l_discount - 0.05) as ab"
    return parse(text).rows(table(spark, sf_dir, "lineitem")).withColumn("net", F.round("net", 4))


@register("SELECT o_orderkey, CAST(floor(o_totalprice / 100 + 0.5) AS BIGINT) AS hundreds, o_totalprice / 1000 AS thousands, round(o_totalprice / 1000 * 2, 6) AS twice FROM orders WHERE o_totalprice / 1000 > 150")
def computed_registry(spark, sf_dir):
    fields = ComputedFields().add("twice", "thousands * 2").add("thousands", "o_totalprice / 1000").add("hundreds", "o_totalprice / 100", "long").add("lost", "no_such_field + 1")
    q = _query(spark, sf_dir, "orders").computed(fields).where("thousands", C.BIGGER, 150)
    return q.select("o_orderkey", "hundreds", "thousands", "twice").rows().withColumn("twice", F.round("twice", 6))


@register('SELECT c_custkey, c_nationkey AS "place.nation", n_name AS "place.name" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2')
def nested_path(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    place = F.struct(F.col("c_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    nested = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", place.alias("place"))
    return Query.of(nested).where("place.region", C.EQUAL, 2).select("c_custkey", "place.nation", "place.name").rows()


# -- distinct, order, paging ---------------------------------------------
@register("SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS n, sum(o_custkey) AS s FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000)")
def distinct_rows(spark, sf_dir):
    q = _query(spark, sf_dir, "orders").where("o_totalprice", C.BIGGER, 1000).distinct("o_custkey", "o_orderstatus")
    return q.rows().agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def distinct_last(spark, sf_dir):
    """Of every customer's orders, in key order, the values of the last."""
    df = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    return Query.of(df).distinct("o_custkey").select("o_custkey", "o_orderkey", "o_totalprice").rows()


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 25")
def order_topk(spark, sf_dir):
    return _query(spark, sf_dir, "orders").order("o_totalprice", "o_orderkey").limit(25).select("o_orderkey", "o_totalprice").rows(S.DESC)


@register("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 20 OFFSET 40")
def limit_offset(spark, sf_dir):
    return _query(spark, sf_dir, "customer").order("c_acctbal", "c_custkey").offset(40).limit(20).select("c_custkey", "c_acctbal").rows(S.ASC)


@register("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey > 7 OR (c_nationkey = 7 AND c_custkey > 50) ORDER BY c_nationkey, c_custkey LIMIT 30")
def keyset_after(spark, sf_dir):
    q = parse("select c_nationkey, c_custkey order by c_nationkey asc, c_custkey asc limit 30").keyset_after(Cursor.of(c_nationkey=7, c_custkey=50).token())
    return q.rows(table(spark, sf_dir, "customer"))


@register("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey < 7 OR (c_nationkey = 7 AND c_custkey < 50) ORDER BY c_nationkey, c_custkey LIMIT 30")
def keyset_before(spark, sf_dir):
    q = parse("select c_nationkey, c_custkey order by c_nationkey, c_custkey limit 30").keyset_before(Cursor.of(c_nationkey=7, c_custkey=50))
    return q.rows(table(spark, sf_dir, "customer"))


# -- aggregates ----------------------------------------------------------
@register("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'F'")
def agg_global(spark, sf_dir):
    q = _query(spark, sf_dir, "orders").where("o_orderstatus", C.EQUAL, "F").count("n").metric(Metric.SUM, "o_totalprice", "total").metric(Metric.AVG, "o_totalprice", "mean")
    q = q.metric(Metric.MIN, "o_totalprice", "low").metric(Metric.MAX, "o_totalprice", "high")
    return q.rows().withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


PRICING_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""


@register(PRICING_SQL)
def agg_multi_key(spark, sf_dir):
    q = _query(spark, sf_dir, "lineitem").where("l_shipdate", C.SMALLER_EQUAL, dt.datetime(1998, 9, 2)).group("l_returnflag").group("l_linestatus")
    q = q.metric(Metric.SUM, "l_quantity", "sum_qty").metric(Metric.SUM, "l_extendedprice", "sum_price").metric(Metric.AVG, "l_discount", "avg_disc").count("n")
    out = q.order("l_returnflag", "l_linestatus").rows(S.ASC)
    return out.withColumns({"sum_qty": F.round("sum_qty", 2), "sum_price": F.round("sum_price", 2), "avg_disc": F.round("avg_disc", 6)})


@register("SELECT o_orderpriority, count(*) AS n, sum(o_custkey) AS s FROM orders GROUP BY o_orderpriority")
def agg_group(spark, sf_dir):
    return parse("select o_orderpriority, count(*) as n, sum(o_custkey) as s group by o_orderpriority").rows(table(spark, sf_dir, "orders"))


@register("SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) GROUP BY o_orderstatus")
def agg_count_field(spark, sf_dir):
    """COUNT(field) counts null rows too."""
    df = table(spark, sf_dir, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return parse("select o_orderstatus, count(p) as n group by o_orderstatus").rows(df)


@register("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 OR o_custkey = 3")
def agg_having_alias(spark, sf_dir):
    return parse("select o_custkey, count(*) as n group by o_custkey having n > 12 or o_custkey = 3").rows(table(spark, sf_dir, "orders"))


@register("SELECT o_custkey FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 150000 AND sum(o_totalprice) / count(*) > 80000)")
def agg_having_hidden(spark, sf_dir):
    text = "select o_custkey, count(*) as n group by o_custkey having max(o_totalprice) > 150000 and sum(o_totalprice) / count(*) > 80000"
    return parse(text).rows(table(spark, sf_dir, "orders")).select("o_custkey")


@register("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY max(c_custkey) DESC LIMIT 10")
def agg_order_hidden(spark, sf_dir):
    return parse("select c_nationkey as nation, count(*) as n group by nation order by max(c_custkey) desc limit 10").rows(table(spark, sf_dir, "customer"))


@register("SELECT min(o_orderdate) AS o_orderdate, count(*) AS n FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')")
def agg_date_format_group(spark, sf_dir):
    """Grouped by the text of the month, showing the first date in date order."""
    df = table(spark, sf_dir, "orders").orderBy("o_orderdate")
    return Query.of(df).group("o_orderdate", "yyyy-MM").count("n").rows()


@register("""SELECT concat(o_orderstatus, ',', o_orderpriority, ',') AS group_key, count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_totalprice > 1000 GROUP BY 1""")
def grouped_rows(spark, sf_dir):
    q = _query(spark, sf_dir, "orders").where("o_totalprice", C.BIGGER, 1000).group("o_orderstatus").group("o_orderpriority")
    return q.grouped().groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


# -- buckets -------------------------------------------------------------
def _bucket(unit: str, label: str, zone: str = "UTC", week_start: str | None = None, column: str = "o_orderdate", name: str = "orders"):
    def run(spark, sf_dir):
        return _query(spark, sf_dir, name).time_bucket(column, parse_bucket(unit, zone, week_start), "period").count("n").rows()

    return run, f"SELECT {label} AS period, count(*) AS n FROM {name} GROUP BY 1"


_D = "CAST(o_orderdate AS DATE)"
_PIVOT = f"({_D} - CAST(dayofweek({_D}) AS INTEGER) + 3)"
for _name, (_run, _sql) in {
    "bucket_day": _bucket("day", "strftime(o_orderdate, '%Y-%m-%d')"),
    "bucket_week_iso": _bucket("week", "printf('%04d-W%02d', isoyear(o_orderdate), week(o_orderdate))"),
    "bucket_week_sunday": _bucket("week", f"printf('%04d-W%02d', year({_PIVOT}), CAST(floor((dayofyear({_PIVOT}) - 1) / 7) AS INTEGER) + 1)", week_start="sunday"),
    "bucket_month": _bucket("month", "strftime(ts, '%Y-%m')", column="ts", name="events"),
    "bucket_quarter": _bucket("quarter", "printf('%d-Q%d', year(o_orderdate), quarter(o_orderdate))"),
    "bucket_year": _bucket("year", "strftime(o_orderdate, '%Y')"),
    "bucket_zone": _bucket("day", "strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d')", "Asia/Kolkata", column="ts", name="events"),
}.items():
    _run.__name__ = _name
    register(_sql)(_run)


# -- joins ---------------------------------------------------------------
@register("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_inner(spark, sf_dir):
    q = _query(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")
    return q.where("c_acctbal", C.BIGGER, 5000).select("o_orderkey", "c_name").rows()


@register("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    rich = Query.of(table(spark, sf_dir, "orders")).where("o_totalprice", C.BIGGER, 150000).rows()
    return _query(spark, sf_dir, "customer").join(rich, "c_custkey", "o_custkey", JoinKind.LEFT).select("c_custkey", "o_orderkey").rows()


@register("SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, sf_dir):
    some = Query.of(table(spark, sf_dir, "supplier")).where("s_acctbal", C.BIGGER, 5000).rows()
    return Query.of(some).join(table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey", JoinKind.RIGHT).select("n_name", "s_suppkey").rows()


@register("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal < 100")
def join_chain(spark, sf_dir):
    text = "select r_name, n_name, c_custkey from region join nation on region.r_regionkey = nation.n_regionkey join customer on nation.n_nationkey = customer.c_nationkey where c_acctbal < 100"
    return parse(text).rows(table(spark, sf_dir, "region"), {n: table(spark, sf_dir, n) for n in ("nation", "customer")})


@register("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS child_n_nationkey, b.n_name AS child_n_name, b.n_regionkey AS child_n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def join_collision(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return Query.of(n).join(n, "n_nationkey", "n_nationkey").rows()


@register("SELECT c_custkey, round(c_acctbal + o_totalprice, 2) AS worth FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal + o_totalprice > 150000")
def join_computed(spark, sf_dir):
    q = _query(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    q = q.computed(ComputedFields().add("worth", "c_acctbal + o_totalprice")).where("worth", C.BIGGER, 150000)
    return q.select("c_custkey", "worth").rows().withColumn("worth", F.round("worth", 2))


# -- windows -------------------------------------------------------------
def _over(order: str, partition: str = "l_returnflag") -> str:
    return f"OVER (PARTITION BY {partition} ORDER BY {order})"


_LINE_KEYS = tuple(OrderKey(k) for k in LINE)


def _window(function: WindowFunction, orders, value=None):
    def run(spark, sf_dir):
        q = _query(spark, sf_dir, "lineitem").window(function, "w", value, ("l_suppkey",), orders).select(*LINE, "w")
        out = q.rows()
        return out.withColumn("w", F.round("w", 4)) if value and function is not W.COUNT else out

    return run


_RUN = f"OVER (PARTITION BY l_suppkey ORDER BY l_quantity, {LINE_SQL} ROWS UNBOUNDED PRECEDING)"
_QTY = (OrderKey("l_quantity"), *_LINE_KEYS)
for _name, _fn, _orders, _value, _sql in (
    ("win_row_number", W.ROW_NUMBER, (OrderKey("l_quantity", S.DESC), *_LINE_KEYS), None, f"CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, {LINE_SQL}) AS BIGINT)"),
    ("win_rank", W.RANK, ("l_quantity",), None, f"CAST(rank() {_over('l_quantity', 'l_suppkey')} AS BIGINT)"),
    ("win_dense_rank", W.DENSE_RANK, ("l_quantity",), None, f"CAST(dense_rank() {_over('l_quantity', 'l_suppkey')} AS BIGINT)"),
    ("win_running_count", W.COUNT, _QTY, None, f"count(*) {_RUN}"),
    ("win_running_sum", W.SUM, _QTY, "l_quantity", f"round(sum(l_quantity) {_RUN}, 4)"),
    ("win_running_avg", W.AVG, _QTY, "l_quantity", f"round(avg(l_quantity) {_RUN}, 4)"),
    ("win_running_min", W.MIN, _QTY, "l_extendedprice", f"round(min(l_extendedprice) {_RUN}, 4)"),
    ("win_running_max", W.MAX, _QTY, "l_extendedprice", f"round(max(l_extendedprice) {_RUN}, 4)"),
):
    _run = _window(_fn, _orders, _value)
    _run.__name__ = _name
    register(f"SELECT {LINE_SQL}, {_sql} AS w FROM lineitem")(_run)


@register("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn <= 2")
def qualify_topn(spark, sf_dir):
    text = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey asc) as rn where o_orderstatus = 'O' qualify rn <= 2"
    return parse(text).rows(table(spark, sf_dir, "orders"))


# -- presets and whole queries -------------------------------------------
@register("SELECT c_mktsegment, count(*) AS value FROM customer GROUP BY c_mktsegment ORDER BY value DESC, c_mktsegment DESC")
def stats_by(spark, sf_dir):
    return stats.by("c_mktsegment").rows(table(spark, sf_dir, "customer"))


@register("SELECT l_suppkey, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_quantity) DESC, l_suppkey DESC LIMIT 5")
def stats_topn(spark, sf_dir):
    return stats.top_n_by("l_suppkey", 5, Metric.SUM, "l_quantity").rows(table(spark, sf_dir, "lineitem")).withColumn("value", F.round("value", 2))


@register("SELECT round(avg(l_extendedprice), 4) AS value FROM lineitem")
def stats_summary(spark, sf_dir):
    return stats.summary(Metric.AVG, "l_extendedprice").rows(table(spark, sf_dir, "lineitem")).withColumn("value", F.round("value", 4))


@register("SELECT o_orderstatus, o_orderpriority, count(*) AS value FROM orders GROUP BY o_orderstatus, o_orderpriority")
def chart_breakdown_rows(spark, sf_dir):
    return chart.grouped_breakdown("o_orderpriority", "o_orderstatus", Metric.COUNT, None).rows(table(spark, sf_dir, "orders"))


@register("SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def chart_time_series_rows(spark, sf_dir):
    return chart.time_series_totals("o_orderdate", "month", Metric.SUM, "o_totalprice").rows(table(spark, sf_dir, "orders")).withColumn("value", F.round("value", 2))


@register("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY c_mktsegment")
def chart_category_rows(spark, sf_dir):
    return chart.category_totals("c_mktsegment", Metric.AVG, "c_acctbal").rows(table(spark, sf_dir, "customer")).withColumn("value", F.round("value", 4))


@register("""WITH a AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS key, CASE WHEN b.c_custkey IS NULL THEN 'ADDED' WHEN a.c_custkey IS NULL THEN 'REMOVED' WHEN a.c_acctbal <> b.c_acctbal THEN 'CHANGED' ELSE 'UNCHANGED' END AS change,
CASE WHEN a.c_acctbal <> b.c_acctbal THEN 1 ELSE 0 END AS changed_field_count, CASE WHEN a.c_acctbal <> b.c_acctbal THEN 'c_acctbal' ELSE '' END AS changed_field_summary
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def snapshot_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    now = c.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.expr("c_custkey % 5 = 0"), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    rows = SnapshotComparison(now, c.filter("c_custkey % 11 <> 0"), "c_custkey").rows()
    return rows.select("key", "change", "changed_field_count", "changed_field_summary")


@register("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND n_regionkey <> 0 GROUP BY n_name HAVING count(*) > 3 ORDER BY sum(o_totalprice) DESC LIMIT 10""")
def sql_full(spark, sf_dir):
    text = """select n_name, count(*) as orders, sum(o_totalprice) as total from orders
    join customer on orders.o_custkey = customer.c_custkey join nation on customer.c_nationkey = nation.n_nationkey
    where (o_orderstatus = :status or o_totalprice > :price) and n_regionkey != 0
    group by n_name having count(*) > 3 order by total desc limit :n"""
    q = parse(text).params(status="F", price=100000, n=10)
    out = q.rows(table(spark, sf_dir, "orders"), {n: table(spark, sf_dir, n) for n in ("customer", "nation")})
    return out.withColumn("total", F.round("total", 2))


# -- nulls, kinds and sinks ----------------------------------------------
_KEYS_SQL = "(SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c JOIN (SELECT n_name, nullif(n_nationkey, 3) AS nk FROM nation) n"


def _null_keys(spark, sf_dir, null_safe: bool):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    n = table(spark, sf_dir, "nation").select("n_name", F.nullif("n_nationkey", F.lit(3)).alias("nk"))
    return Query.of(c).join(n, "k", "nk", null_safe=null_safe).select("c_custkey", "n_name").rows()


@register(f"SELECT c_custkey, n_name FROM {_KEYS_SQL} ON k = nk")
def join_null_keys(spark, sf_dir):
    """Null keys join with nothing."""
    return _null_keys(spark, sf_dir, False)


@register(f"SELECT c_custkey, n_name FROM {_KEYS_SQL} ON k IS NOT DISTINCT FROM nk")
def join_null_safe(spark, sf_dir):
    """Null keys join with each other if asked to."""
    return _null_keys(spark, sf_dir, True)


@register("SELECT s_suppkey, n_name FROM supplier JOIN (SELECT n_name, CAST(n_nationkey AS VARCHAR) AS t FROM nation) n ON CAST(s_nationkey AS VARCHAR) = t")
def join_mixed_kinds(spark, sf_dir):
    """A number and a text join by their texts."""
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("t"))
    return _query(spark, sf_dir, "supplier").join(n, "s_nationkey", "t").select("s_suppkey", "n_name").rows()


@register("SELECT c_custkey, CAST(NULL AS BIGINT) AS o_orderkey FROM customer")
def join_empty_child(spark, sf_dir):
    none = table(spark, sf_dir, "orders").filter("false")
    return _query(spark, sf_dir, "customer").join(none, "c_custkey", "o_custkey", JoinKind.LEFT).select("c_custkey", "o_orderkey").rows()


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"))


_SIZES_SQL = "(SELECT p_partkey, nullif(p_size, 7) AS size FROM part)"


@register(f"SELECT p_partkey, size FROM {_SIZES_SQL} ORDER BY size ASC NULLS FIRST, p_partkey ASC LIMIT 60")
def order_nulls_lowest(spark, sf_dir):
    return Query.of(_sizes(spark, sf_dir)).order("size", "p_partkey").limit(60).rows(S.ASC)


@register(f"SELECT p_partkey, size FROM {_SIZES_SQL} ORDER BY size DESC NULLS LAST, p_partkey DESC LIMIT 60 OFFSET 20")
def order_nulls_last(spark, sf_dir):
    return Query.of(_sizes(spark, sf_dir)).order("size", "p_partkey").limit(60).offset(20).rows(S.DESC)


@register("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 5")
def order_default_direction(spark, sf_dir):
    return parse("select n_nationkey, n_name order by n_name limit 5").rows(table(spark, sf_dir, "nation"))


@register("SELECT * FROM nation WHERE n_regionkey = 1")
def select_star(spark, sf_dir):
    return parse("select * where n_regionkey = 1").rows(table(spark, sf_dir, "nation"))


def _sized(spark, sf_dir, function: WindowFunction, value: str | None):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.nullif("p_size", F.lit(7)).alias("size"))
    return Query.of(df).window(function, "w", value, ("p_brand",), (OrderKey("size"), OrderKey("p_partkey"))).select("p_partkey", "w").rows()


_NULL_ORDER = "OVER (PARTITION BY p_brand ORDER BY size ASC NULLS FIRST, p_partkey"


@register(f"SELECT p_partkey, CAST(row_number() {_NULL_ORDER}) AS BIGINT) AS w FROM (SELECT *, nullif(p_size, 7) AS size FROM part)")
def win_null_order(spark, sf_dir):
    return _sized(spark, sf_dir, W.ROW_NUMBER, None)


@register(f"SELECT p_partkey, CAST(sum(size) {_NULL_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS w FROM (SELECT *, nullif(p_size, 7) AS size FROM part)")
def win_running_sum_nulls(spark, sf_dir):
    """Null before the first value."""
    return _sized(spark, sf_dir, W.SUM, "size")


@register("""SELECT coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '') AS status, count(*) AS n FROM orders GROUP BY 1""")
def agg_compat_groups(spark, sf_dir):
    """Text keys, null like empty."""
    status = F.when(F.col("o_orderstatus") == "F", F.lit(None)).when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    q = Query.of(table(spark, sf_dir, "orders").withColumn("status", status)).group("status").count("n").compat()
    return q.rows().withColumn("status", F.coalesce("status", F.lit("")))


@register("""WITH a AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 11 <> 0)
SELECT count(a.c_custkey) AS current_rows, count(b.c_custkey) AS previous_rows, count(*) FILTER (b.c_custkey IS NULL) AS added, count(*) FILTER (a.c_custkey IS NULL) AS removed,
count(*) FILTER (c_acctbal <> v) AS changed, count(*) FILTER (c_acctbal = v) AS unchanged FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def snapshot_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    then = c.filter("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.expr("c_custkey % 5 = 0"), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    s = SnapshotComparison(c.filter("c_custkey % 7 <> 0"), then, "c_custkey").summary()
    names = ("current_rows", "previous_rows", "added", "removed", "changed", "unchanged")
    return spark.createDataFrame([tuple(getattr(s, n) for n in names)], ", ".join(f"{n} long" for n in names))


@register("SELECT c_mktsegment, count(*) AS value, (SELECT count(*) FROM customer) AS total FROM customer GROUP BY c_mktsegment")
def stats_table(spark, sf_dir):
    """Rows of a statistics table beside its totals."""
    made = stats.by("c_mktsegment").table(table(spark, sf_dir, "customer"))
    return made.rows.withColumn("total", F.lit(made.totals["value"]).cast("long"))


@register("SELECT o_orderpriority AS label, o_orderstatus AS series, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_orderpriority, o_orderstatus")
def chart_matrix(spark, sf_dir):
    """A chart of several series, as cells."""
    made = chart.grouped_breakdown("o_orderpriority", "o_orderstatus", Metric.COUNT, None).chart(table(spark, sf_dir, "orders"))
    cells = [(x, d.label, v) for d in made.datasets for x, v in zip(made.labels, d.values) if v is not None]
    return spark.createDataFrame(cells, "label string, series string, value double")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 40")
def lazy_sink(spark, sf_dir):
    rows = _query(spark, sf_dir, "customer").where("c_custkey", C.SMALLER_EQUAL, 40).select("c_custkey", "c_name").iterate()
    return spark.createDataFrame(list(rows), "c_custkey long, c_name string")


@register("SELECT n_regionkey || ',' AS group_key, count(*) AS n FROM nation GROUP BY n_regionkey")
def grouped_sink(spark, sf_dir):
    groups = _query(spark, sf_dir, "nation").group("n_regionkey").groups()
    return spark.createDataFrame([(k, len(v)) for k, v in groups.items()], "group_key string, n long")


@register("SELECT r_name, r_regionkey FROM region")
def maps_sink(spark, sf_dir):
    maps = to_maps(_query(spark, sf_dir, "region").select("r_name", "r_regionkey").rows())
    return spark.createDataFrame([(m["r_name"], m["r_regionkey"]) for m in maps], "r_name string, r_regionkey int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pricing summary: filter, two group keys, sums, mean, count, order."""
    return agg_multi_key(spark, sf_dir)
