"""User, item and interaction features as of an instant, and their compaction across deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import millis_date

RECENT = 50


def _type_counts() -> list[Column]:
    return [F.count_if(F.col("event_type") == t).alias(n) for t, n in (("view", "view_count"), ("addtocart", "cart_count"), ("transaction", "transaction_count"))]


def recency_days(as_of_ms: Column, last_ms: Column) -> Column:
    """Days between calendar dates in UTC."""
    return F.datediff(millis_date(as_of_ms), millis_date(last_ms))


def as_of(events: DataFrame) -> int | None:
    return events.agg(F.max("timestamp")).first()[0]


def recent_items(events: DataFrame, most: int = RECENT) -> DataFrame:
    """user_id, recent_items: the latest events by (time, item, weight) all descending, repeats kept.
    Rows are cut by rank before they are gathered, so no user's whole history becomes an array."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("item_id"), F.desc("event_weight"))
    own = events.select("user_id", "timestamp", "item_id", "event_weight").withColumn("nth", F.row_number().over(latest)).filter(F.col("nth") <= most)
    return own.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "item_id", "event_weight")), False).alias("recent_items"))


def user_features(events: DataFrame, as_of_ms: int, most: int = RECENT) -> DataFrame:
    totals = events.groupBy("user_id").agg(
        F.count("*").alias("event_count"), F.count_distinct("item_id").alias("unique_item_count"), *_type_counts(),
        F.sum("event_weight").alias("weighted_event_sum"), F.max("timestamp").alias("last_event_timestamp"),
    )
    return totals.join(recent_items(events, most), "user_id").withColumn("recency_days", recency_days(F.lit(as_of_ms), F.col("last_event_timestamp")))


def item_features(events: DataFrame, as_of_ms: int) -> DataFrame:
    totals = events.groupBy("item_id").agg(
        F.count("*").alias("event_count"), F.count_distinct("user_id").alias("unique_user_count"), *_type_counts(),
        F.sum("event_weight").alias("weighted_popularity"), F.max("timestamp").alias("last_event_timestamp"),
    )
    return totals.withColumn("recency_days", recency_days(F.lit(as_of_ms), F.col("last_event_timestamp")))


def interaction_features(events: DataFrame, as_of_ms: int) -> DataFrame:
    totals = events.groupBy("user_id", "item_id").agg(F.count("*").alias("interaction_count"), F.sum("event_weight").alias("affinity_score"), F.max("event_weight").alias("strongest_event_weight"), F.max("timestamp").alias("last_interaction_timestamp"))
    return totals.withColumn("recency_days", recency_days(F.lit(as_of_ms), F.col("last_interaction_timestamp")))


def compact_interactions(snapshots: list[DataFrame], as_of_ms: int) -> DataFrame:
    """Interaction features of the union of the snapshots' events: counts and sums add, maxima combine."""
    return _union(snapshots).groupBy("user_id", "item_id").agg(
        F.sum("interaction_count").alias("interaction_count"), F.sum("affinity_score").alias("affinity_score"), F.max("strongest_event_weight").alias("strongest_event_weight"), F.max("last_interaction_timestamp").alias("last_interaction_timestamp"),
    ).withColumn("recency_days", recency_days(F.lit(as_of_ms), F.col("last_interaction_timestamp")))


def compact_items(snapshots: list[DataFrame], interactions: DataFrame, as_of_ms: int) -> DataFrame:
    """Item features likewise; distinct users do not add up, so they are counted from compacted interactions."""
    sums = ["event_count", "view_count", "cart_count", "transaction_count", "weighted_popularity"]
    totals = _union(snapshots).groupBy("item_id").agg(*(F.sum(c).alias(c) for c in sums), F.max("last_event_timestamp").alias("last_event_timestamp"))
    users = interactions.groupBy("item_id").agg(F.count("*").alias("unique_user_count"))
    out = totals.join(users, "item_id").withColumn("recency_days", recency_days(F.lit(as_of_ms), F.col("last_event_timestamp")))
    return out.select("item_id", "event_count", "unique_user_count", "view_count", "cart_count", "transaction_count", "weighted_popularity", "last_event_timestamp", "recency_days")


def compact_users(snapshots: list[DataFrame], interactions: DataFrame, as_of_ms: int, most: int = RECENT) -> DataFrame:
    """User features likewise; the recent items are the latest of all snapshots' recent items."""
    sums = ["event_count", "view_count", "cart_count", "transaction_count", "weighted_event_sum"]
    union = _union(snapshots)
    recent = F.slice(F.sort_array(F.flatten(F.collect_list("recent_items")), False), 1, most).alias("recent_items")
    totals = union.groupBy("user_id").agg(*(F.sum(c).alias(c) for c in sums), F.max("last_event_timestamp").alias("last_event_timestamp"), recent)
    items = interactions.groupBy("user_id").agg(F.count("*").alias("unique_item_count"))
    out = totals.join(items, "user_id").withColumn("recency_days", recency_days(F.lit(as_of_ms), F.col("last_event_timestamp")))
    return out.select("user_id", "event_count", "unique_item_count", "view_count", "cart_count", "transaction_count", "weighted_event_sum", "last_event_timestamp", "recent_items", "recency_days")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out
