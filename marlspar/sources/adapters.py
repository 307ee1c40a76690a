"""Interactions from the star-schema tables, in the canonical event columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import WEIGHTS


def weight_of(event_type: Column) -> Column:
    """The implicit-feedback weight; null for any other type."""
    out = F
    for name, weight in WEIGHTS.items():
        out = out.when(event_type == name, F.lit(weight))
    return out


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def click_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: views, clicks and purchases; other types stay, without weight, as rows of an invalid domain."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    name = F.when(kind == "click", "addtocart").when(kind == "purchase", "transaction").otherwise(kind)
    return events.select(
        _millis(F.col("ts")).alias("timestamp"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), name.alias("event_type"),
        weight_of(name).alias("event_weight"), F.when(kind == "purchase", F.col("event_id").cast("string")).alias("transaction_id"),
    )


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with orders: customers and parts, typed by the return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    flag = F.col("l_returnflag")
    name = F.when(flag == "N", "view").when(flag == "A", "addtocart").when(flag == "R", "transaction")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _millis(F.col("o_orderdate")).alias("timestamp"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        name.alias("event_type"), weight_of(name).alias("event_weight"), F.when(flag == "R", F.col("l_orderkey").cast("string")).alias("transaction_id"),
    )


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, category_id: the digits of a part's brand."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return parts.select(F.col("p_partkey").alias("item_id"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("category_id"))


def supplier_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a property history: which supplier shipped a part when."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_partkey", "l_suppkey")
    return lines.select(_millis(F.col("l_shipdate")).alias("timestamp"), F.col("l_partkey").alias("itemid"), F.lit("supplier").alias("property"), F.col("l_suppkey").cast("string").alias("value"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value as a latency in ms of a repetition (the user), with its time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.col("user_id").alias("repetition"), "event_type", _millis(F.col("ts")).alias("ms"), F.col("value").alias("latency_ms"))
