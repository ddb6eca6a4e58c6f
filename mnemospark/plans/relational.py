"""General relational queries on the star schema: aggregation, windows, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators.joins import as_of
from mnemospark.sources.tables import table


def _money(c: str) -> F.Column:
    return F.round(F.sum(c), 2)


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), _money("l_extendedprice").alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n")
    )


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").where("o_orderdate < '1995-03-15'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").where("l_shipdate > '1995-03-15'")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    li = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def forecast_revenue(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate >= DATE'1994-01-01' AND l_shipdate < DATE'1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def customers_over(spark: SparkSession, d: str) -> DataFrame:
    """Three-way join with a condition on the group."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    j = table(spark, d, "customer").select("c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    g = j.groupBy("c_custkey", "c_name").agg(F.max("o_orderdate").alias("latest"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return g.where("latest >= DATE'1998-01-01'").select("c_custkey", "c_name", F.date_format("latest", "yyyy-MM-dd").alias("latest"), "quantity")


def orders_cube(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.cube("o_orderstatus", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


def orders_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    return o.rollup("year", "month").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.grouping_id().cast("int").alias("level"))


def parts_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


def long_measures(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return g.unpivot(["l_returnflag"], ["quantity", "price"], "measure", "value")


def both_years(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.where("year(o_orderdate) = 1996").select("o_custkey")
    b = o.where("year(o_orderdate) = 1997").select("o_custkey")
    return a.intersect(b)


def first_year_only(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("year(o_orderdate) = 1996").select("o_custkey").subtract(o.where("year(o_orderdate) = 1997").select("o_custkey"))


def either_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("year(o_orderdate) = 1996").select("o_custkey").union(o.where("year(o_orderdate) = 1997").select("o_custkey")).distinct()


def bag_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("year(o_orderdate) = 1996").select("o_custkey").exceptAll(o.where("year(o_orderdate) = 1997").select("o_custkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def customer_ranks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 0).alias("total")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "o_custkey")
    ties = Window.partitionBy("c_nationkey").orderBy(F.desc(F.floor(F.col("total") / 100000)))
    return t.select("o_custkey", "c_nationkey", F.row_number().over(by).alias("place"), F.rank().over(ties).alias("rank"), F.dense_rank().over(ties).alias("dense"), F.ntile(4).over(by).alias("quarter"), F.round(F.percent_rank().over(by), 6).alias("share"))


def running_sums(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(by.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("upto"), F.round(F.avg("o_totalprice").over(by.rowsBetween(-2, 0)), 4).alias("last_three"), F.first("o_orderkey").over(by).alias("first_order"))


def range_frame(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer within the thirty days up to each."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01"))
    o = table(spark, d, "orders").withColumn("day", day)
    by = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-30, 0)
    return o.select("o_orderkey", F.count(F.lit(1)).over(by).alias("n"), F.round(F.sum("o_totalprice").over(by), 2).alias("total"))


def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.expr("percentile(l_quantity, 0.5)"), 4).alias("median"), F.round(F.expr("percentile(l_quantity, 0.9)"), 4).alias("p90"))


def about_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about_parts"))


def full_outer(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("debtors"))
    return s.join(c, "k", "full")


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.lit(True))
    none = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.lit(False))
    return has.unionByName(none)


def late_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped more than sixty days after their order (a condition besides equality)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    j = o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.datediff("l_shipdate", "o_orderdate") > 60))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def event_types(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"), F.max(k).alias("most_k"))


def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def last_view_before_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    views = e.where("event_type = 'view'").groupBy("user_id", "us").agg(F.max("event_id").alias("view_id"))
    return as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), views, ["user_id"], "us", "view_id").select("event_id", "view_id")


QUERIES = {f.__name__: f for f in (
    pricing_summary, top_orders, revenue_by_nation, forecast_revenue, customers_over, orders_cube, orders_rollup, parts_grouping_sets, status_pivot, long_measures, both_years, first_year_only,
    either_year, bag_difference, customer_ranks, running_sums, range_frame, exact_quantiles, about_distinct, full_outer, semi_anti, late_lines, event_types, tumbling_events, last_view_before_purchase,
)}

_Y = "SELECT o_custkey FROM orders WHERE year(o_orderdate) = {}"
ORACLES = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""",
    "top_orders": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
        AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""",
    "forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "customers_over": """SELECT c_custkey, c_name, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY 1, 2 HAVING max(o_orderdate) >= DATE '1998-01-01'""",
    "orders_cube": "SELECT o_orderstatus, year, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderstatus, year)::INT AS level FROM (SELECT *, year(o_orderdate)::INT AS year FROM orders) GROUP BY CUBE (o_orderstatus, year)",
    "orders_rollup": "SELECT year, month, count(*) AS n, count(DISTINCT o_custkey) AS customers, grouping(year, month)::INT AS level FROM (SELECT *, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders) GROUP BY ROLLUP (year, month)",
    "parts_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "status_pivot": """SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
    "long_measures": """WITH g AS (SELECT l_returnflag, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1) SELECT l_returnflag, 'quantity' AS measure, q AS value FROM g UNION ALL SELECT l_returnflag, 'price', p FROM g""",
    "both_years": f"{_Y.format(1996)} INTERSECT {_Y.format(1997)}",
    "first_year_only": f"{_Y.format(1996)} EXCEPT {_Y.format(1997)}",
    "either_year": f"{_Y.format(1996)} UNION {_Y.format(1997)}",
    "bag_difference": f"SELECT o_custkey, count(*) AS n FROM ({_Y.format(1996)} EXCEPT ALL {_Y.format(1997)}) GROUP BY 1",
    "customer_ranks": """WITH t AS (SELECT o_custkey, c_nationkey, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT o_custkey, c_nationkey, row_number() OVER w AS place, rank() OVER v AS rank, dense_rank() OVER v AS dense, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS share FROM t
        WINDOW w AS (PARTITION BY c_nationkey ORDER BY total DESC, o_custkey), v AS (PARTITION BY c_nationkey ORDER BY floor(total / 100000) DESC)""",
    "running_sums": """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS upto, round(avg(o_totalprice) OVER (w ROWS 2 PRECEDING), 4) AS last_three, first(o_orderkey) OVER w AS first_order
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "range_frame": """SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS total FROM (SELECT *, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day FROM orders)
        WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)""",
    "exact_quantiles": "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) AS median, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem GROUP BY 1",
    "full_outer": """SELECT coalesce(s.k, c.k) AS k, suppliers, debtors FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS debtors FROM customer WHERE c_acctbal < 0 GROUP BY 1) c ON s.k = c.k""",
    "semi_anti": "SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS large, count(*) AS n FROM customer GROUP BY ALL",
    "late_lines": "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 60 GROUP BY 1",
    "event_types": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value, max((props->>'$.k')::INT) AS most_k FROM events GROUP BY 1",
    "tumbling_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "last_view_before_purchase": """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2), p AS (SELECT * FROM events WHERE event_type = 'purchase')
        SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
}
