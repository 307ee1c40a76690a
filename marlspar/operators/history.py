"""Folded user histories, what users have seen, and popularity. Every table carries `g`, the graph it
belongs to, so that one plan serves a single window (g = 0) and all folds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import RELEVANT
from ..storage import stage


def with_graph(events: DataFrame, g: int = 0) -> DataFrame:
    return events.withColumn("g", F.lit(g))


def fold(events: DataFrame, who: str = "user_id") -> DataFrame:
    """(g, who, item_id): summed weight and last time. This is also what `who` has seen."""
    return events.groupBy("g", who, "item_id").agg(F.sum("event_weight").alias("weight"), F.max("timestamp").alias("timestamp"))


def capped(folded: DataFrame, most: int = 50, who: str = "user_id") -> DataFrame:
    """The latest items by (time descending, item): position from 0."""
    latest = Window.partitionBy("g", who).orderBy(F.desc("timestamp"), "item_id")
    return folded.withColumn("position", F.row_number().over(latest) - 1).filter(F.col("position") < most)


def popularity(events: DataFrame) -> DataFrame:
    """(g, item_id): summed weight."""
    return events.groupBy("g", "item_id").agg(F.sum("event_weight").alias("score"))


def top_items(popular: DataFrame, most: int) -> DataFrame:
    """(g, items): item ids by (score descending, item), `most` at most: one row a graph. The rank filter is
    pushed below the shuffle as a group limit, so tasks send their best rows only."""
    order = Window.partitionBy("g").orderBy(F.desc("score"), "item_id")
    ranked = popular.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "item_id", "score")))
    return ranked.groupBy("g").agg(F.transform(in_order, lambda x: x["item_id"]).alias("items"), F.transform(in_order, lambda x: x["score"]).alias("scores"))


def ranked(popular: DataFrame) -> DataFrame:
    """popular with rank (long) from 1 in each graph by (score descending, item), numbered part by part of a
    range partitioning, so that no task holds the whole catalogue."""
    order = F.desc("score"), F.col("item_id")
    parts = stage(popular.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "ranked")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = parts.groupBy("g", "part").agg(F.count("*").alias("n")).select("g", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    return parts.join(F.broadcast(bases), ["g", "part"]).withColumn("rank", F.col("base") + own).drop("part", "base")


def longest_seen(seen: DataFrame, who: str = "user_id") -> int:
    """The largest number of items that one `who` has seen."""
    return seen.groupBy("g", who).count().agg(F.max("count")).first()[0] or 0


def relevant_rows(target: DataFrame, seen: DataFrame) -> DataFrame:
    """Relevant events of a target window with flags: warm (the user has a history), repeated (the item was seen)."""
    own = target.filter(F.col("event_type").isin(*RELEVANT)).select("user_id", "item_id", "timestamp")
    users = seen.select("user_id").distinct().withColumn("warm", F.lit(True))
    pairs = seen.select("user_id", "item_id").withColumn("repeated", F.lit(True))
    out = own.join(users, "user_id", "left").join(pairs, ["user_id", "item_id"], "left")
    return out.select("user_id", "item_id", "timestamp", F.coalesce("warm", F.lit(False)).alias("warm"), F.coalesce("repeated", F.lit(False)).alias("repeated"))


def truth(rows: DataFrame, warm_only: bool) -> DataFrame:
    """(user_id, item_id) once each: relevant items not seen before, of warm users only or of all."""
    kept = rows.filter(~F.col("repeated"))
    return (kept.filter("warm") if warm_only else kept).select("user_id", "item_id").distinct()


def truth_statistics(rows: DataFrame) -> DataFrame:
    """One row for both kinds of backtest."""
    fresh = ~F.col("repeated")
    return rows.agg(
        F.count("*").alias("relevant_event_rows"), F.count_distinct("user_id").alias("users_with_relevant_events"),
        F.count_if(~F.col("warm")).alias("cold_user_event_rows_excluded"), F.count_if("repeated").alias("repeated_seen_event_rows_excluded"),
        F.count_distinct(F.when(fresh, F.col("user_id"))).alias("eligible_users"), F.count_distinct(F.when(fresh & F.col("warm"), F.col("user_id"))).alias("eligible_warm_users"),
    )
