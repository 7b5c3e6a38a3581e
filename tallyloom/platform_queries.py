"""Plain Spark over the star schema and the events: not reproduced operators, but what the tables are there for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .queries import query
from .streaming import events
from .views import table

MONEY = "decimal(18,2)"


@query("platform_revenue_by_nation", """SELECT n_name, sum((l_extendedprice::DECIMAL(18,2)) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(30,4)::DOUBLE AS revenue, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1994-01-01' and o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_custkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return rows.groupBy("n_name").agg(F.sum(value).cast("decimal(30,4)").cast("double").alias("revenue"), F.count(F.lit(1)).alias("items"))


@query("platform_price_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS quantity, count(*) AS items, grouping(l_returnflag, l_linestatus)::INTEGER AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("items"), F.grouping_id().cast("int").alias("level"))


@query("platform_running_orders", "SELECT o_orderkey, row_number() OVER w AS nth, sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("nth"), F.sum(F.col("o_totalprice").cast(MONEY)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"))


@query("platform_top_parts", "SELECT p_brand, l_partkey, quantity FROM (SELECT p_brand, l_partkey, quantity, row_number() OVER (PARTITION BY p_brand ORDER BY quantity DESC, l_partkey) AS n FROM (SELECT l_partkey, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1) q JOIN part ON l_partkey = p_partkey) WHERE n <= 3")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("quantity"))
    rows = per.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("quantity"), "l_partkey"))).where("n <= 3").select("p_brand", "l_partkey", "quantity")


@query("platform_idle_suppliers", "SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey").exceptAll(table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_suppkey").alias("s_suppkey")).distinct())


@query("platform_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return events.windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("platform_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
  SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    return events.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("started"), "n")
