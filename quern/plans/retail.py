"""A few plain aggregations over the retail tables; they also serve as a smoke test of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and sums by return flag and line status; one partial aggregation, then a shuffle of a few rows."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n_lines"),
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"),
        )
    )


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers of each nation. Orders are summed by customer before they are joined."""
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        customers.join(by_customer, customers.c_custkey == by_customer.o_custkey, "left")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "n_customers", "n_orders")
    )


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in each hour."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
        .agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))
    )


QUERIES = {"pricing_summary": pricing_summary, "orders_by_nation": orders_by_nation, "events_by_hour": events_by_hour}

ORACLE_SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty,
               round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "orders_by_nation": """
        SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY n_name""",
    "events_by_hour": """
        SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users
        FROM events GROUP BY 1, 2""",
}
