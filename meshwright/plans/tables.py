"""Graphs and features derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph

#: Suppliers follow customers in one id range.
SUPPLIERS = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight, pos): each event's user and the next one's, in time.

    The next event is found within the day; a day's last one takes the first of
    the next day that has any, from a table of one row a day.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.round(F.col("value") * 100).cast("long").alias("weight"), F.to_date("ts").alias("day"))
    inside = Window.partitionBy("day").orderBy("ts", "event_id")
    days = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
    following = days.select(F.col("day"), F.lead("first_user").over(Window.orderBy("day")).alias("__next_day"))
    steps = e.withColumn("__next", F.lead("user_id").over(inside)).join(following, "day")
    return steps.select(F.col("user_id").alias("src"), F.coalesce("__next", "__next_day").alias("dst"), "weight", F.struct("ts", "event_id").alias("pos")).where("dst is not null")


def transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between users of consecutive events, the least weight of each pair, in cents."""
    return event_steps(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def transition_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(transition(spark, sf_dir))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers to suppliers of their orders, the least quantity of each pair."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    met = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst")).agg(F.min("l_quantity").cast("long").alias("weight"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations of customers and suppliers, the money that went over, in cents."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    met = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy("src", "dst").agg(F.sum("cents").alias("weight"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, features, label) from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")
