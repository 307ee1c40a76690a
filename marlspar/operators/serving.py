"""Batch serving from a feature snapshot: all users at once, as the online path would answer each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import RANK_CONSTANT
from ..functions.scoring import strength
from ..storage import stage

ITEM_EVENTS, SESSION_EVENTS, SOURCE_ITEMS = 50, 10, 100


def online_history(users: DataFrame) -> DataFrame:
    """(user_id, item_id, event_weight, position): recent items, first of each kept, positions from 0."""
    rows = users.select("user_id", F.posexplode("recent_items").alias("at", "e")).select("user_id", "at", "e.item_id", "e.event_weight")
    first = rows.groupBy("user_id", "item_id").agg(F.min(F.struct("at", "event_weight")).alias("m"))
    place = Window.partitionBy("user_id").orderBy("m.at")
    return first.select("user_id", "item_id", F.col("m.event_weight").alias("event_weight"), (F.row_number().over(place) - 1).alias("position"))


def popular_items(items: DataFrame, most: int = SOURCE_ITEMS) -> DataFrame:
    """(item_id, weighted_popularity, rank): the head of the popularity index; ties by item. Sorted by
    partial top lists, never as one whole."""
    top = items.select("item_id", "weighted_popularity").orderBy(F.desc("weighted_popularity"), "item_id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weighted_popularity"), "item_id")))


def _scored(history: DataFrame, edges: DataFrame, score: str, most: int) -> DataFrame:
    own = edges.select(F.col("item_id").alias("source"), F.col("other"), F.col(score).alias("similarity"))
    recent = history.filter(F.col("position") < most)
    found = recent.withColumnRenamed("item_id", "source").join(own, "source").withColumnRenamed("other", "item_id")
    unseen = found.join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    value = strength(F.coalesce("event_weight", F.lit(1.0))) / (F.col("position") + 1) * F.col("similarity")
    return unseen.groupBy("user_id", "item_id").agg(F.round(F.sum(value), 8).alias("score"), F.max("similarity").alias("similarity"))


def _ranked(scored: DataFrame, most: int = SOURCE_ITEMS) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def recommend(users: DataFrame, items: DataFrame, neighbors: DataFrame, transitions: DataFrame, requests: DataFrame | None = None, count: int = 10) -> DataFrame:
    """(user_id, item_id, rrf, rank, item_score, session_score, max_similarity, in_item, in_session, in_popular):
    the fused list of each requested user (all users by default; unknown ones get popularity alone).

    Seen items are removed after the cut to 100 fused ones, so they use up places, as online."""
    if not 1 <= count <= 100:
        raise ValueError("count lies between 1 and 100")
    known = online_history(users)
    asked = users.select("user_id") if requests is None else requests.select("user_id").distinct()
    history = stage(known.join(asked, "user_id", "left_semi"), "history")
    item, session = (stage(_scored(history, *x), "scores") for x in ((neighbors, "similarity", ITEM_EVENTS), (transitions, "transition_score", SESSION_EVENTS)))
    item_list, session_list = _ranked(item), _ranked(session)
    sizes = asked.join(history.groupBy("user_id").agg(F.count("*").alias("n_seen")), "user_id", "left").select("user_id", F.coalesce("n_seen", F.lit(0)).alias("n_seen"))
    head = popular_items(items, max(SOURCE_ITEMS, count + ITEM_EVENTS))  # a user has seen 50 items at most
    array = head.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("items"))
    each = sizes.join(F.broadcast(array)).select("user_id", F.posexplode(F.slice("items", F.lit(1), F.greatest(F.lit(SOURCE_ITEMS), F.col("n_seen") + count))).alias("at", "item_id"))
    popular = each.select("user_id", "item_id", (F.col("at") + 1).alias("rank"))
    cols = lambda df, name, w: df.select("user_id", "item_id", "rank", F.lit(name).alias("source"), F.lit(w).alias("weight"))
    ranked = cols(item_list, "item", 1.0).unionByName(cols(session_list, "session", 1.5)).unionByName(cols(popular, "popular", 0.25))
    flags = [F.max((F.col("source") == s).cast("int")).alias(f"in_{s}") for s in ("item", "session", "popular")]
    fused = ranked.groupBy("user_id", "item_id").agg(F.round(F.sum(F.col("weight") / (F.lit(RANK_CONSTANT) + F.col("rank"))), 8).alias("rrf"), *flags)
    order = Window.partitionBy("user_id").orderBy(F.desc("rrf"), "item_id")
    cut = fused.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= max(SOURCE_ITEMS, count))
    kept = cut.join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("fused_rank"))).drop("fused_rank")
    a = item.select("user_id", "item_id", F.col("score").alias("item_score"), F.col("similarity").alias("item_similarity"))
    b = session.select("user_id", "item_id", F.col("score").alias("session_score"), F.col("similarity").alias("session_similarity"))
    out = kept.join(a, ["user_id", "item_id"], "left").join(b, ["user_id", "item_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("user_id", "item_id", "rrf", "rank", zero("item_score").alias("item_score"), zero("session_score").alias("session_score"), F.greatest(zero("item_similarity"), zero("session_similarity")).alias("max_similarity"), "in_item", "in_session", "in_popular")


# The thirteen online features, in order.
ONLINE = ("score_share", "popularity_share", "reciprocal_rank", "source_share", "history_share", "session_share", "max_similarity", "category_share", "rrf_share", "from_item", "from_session", "from_category", "from_popular")


def online_features(fused: DataFrame, users: DataFrame, items: DataFrame, edges: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The online meaning of the thirteen features: shares of the largest over the user's list or scores."""
    history = online_history(users)
    tops = [_scored(history, e, s, n).groupBy("user_id").agg(F.max("score").alias(c)) for e, s, n, c in ((edges[0], "similarity", ITEM_EVENTS, "top_item"), (edges[1], "transition_score", SESSION_EVENTS, "top_session"))]
    sizes = history.groupBy("user_id").agg(F.count("*").alias("n_history"))
    own = Window.partitionBy("user_id")
    rows = fused.join(items.select("item_id", "weighted_popularity"), "item_id", "left").join(tops[0], "user_id", "left").join(tops[1], "user_id", "left").join(sizes, "user_id", "left")
    rows = rows.withColumn("popularity", F.coalesce("weighted_popularity", F.lit(0.0)))
    top = lambda c: F.coalesce(F.nullif(F.max(c).over(own), F.lit(0.0)), F.lit(1.0))
    flags = (F.col("in_item") + F.col("in_session") + F.col("in_popular")).cast("double")
    values: dict[str, Column] = {
        "score_share": F.col("item_score") / F.coalesce("top_item", F.lit(1.0)),
        "popularity_share": F.col("popularity") / top("popularity"),
        "reciprocal_rank": F.lit(1.0) / F.col("rank"),
        "source_share": flags / 4.0,
        "history_share": F.least(F.coalesce("n_history", F.lit(0)) / 50.0, F.lit(1.0)),
        "session_share": F.col("session_score") / F.coalesce("top_session", F.lit(1.0)),
        "max_similarity": F.col("max_similarity"),
        "category_share": F.lit(0.0),
        "rrf_share": F.col("rrf") / top("rrf"),
        "from_item": F.col("in_item").cast("double"), "from_session": F.col("in_session").cast("double"), "from_category": F.lit(0.0), "from_popular": F.col("in_popular").cast("double"),
    }
    return rows.select("user_id", "item_id", "rank", *(F.round(v, 8).alias(k) for k, v in values.items()))


def rerank(rows: DataFrame, score: Column, live: bool) -> DataFrame:
    """rows with challenger_score; live: its order replaces the fused one, else it only shadows."""
    scored = rows.withColumn("challenger_score", F.round(score, 8))
    order = [F.desc("challenger_score"), F.col("item_id")] if live else [F.col("rank")]
    return scored.withColumn("served_rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def key_values(table: DataFrame, version: str, entity: str, keys: list[str]) -> DataFrame:
    """(key, value): features:<version>:<entity>:<ids> and the row as JSON."""
    return table.select(F.concat_ws(":", F.lit("features"), F.lit(version), F.lit(entity), *(F.col(k).cast("string") for k in keys)).alias("key"), F.to_json(F.struct("*")).alias("value"))


def result_key(version: str, mode: str, model: str | None, user_id: int, count: int) -> str:
    """What a cached result is stored under: all that it depends on."""
    return f"{version}:{mode}:{model or 'none'}:{user_id}:{count}"


def _result_key(version: str, mode: str, model: str | None, count: int) -> Column:
    """result_key of every row."""
    return F.concat_ws(":", F.lit(version), F.lit(mode), F.lit(model or "none"), F.col("user_id").cast("string"), F.lit(str(count)))


def cached_results(lists: DataFrame, version: str, mode: str, model: str | None, count: int, at: int, ttl: int = 300_000) -> DataFrame:
    """(key, user_id, value, expires): each user's served list as JSON, in order, under what it depends on.
    lists: (user_id, item_id, rank); at and ttl in milliseconds."""
    rows = lists.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("list"))
    return rows.select(_result_key(version, mode, model, count).alias("key"), "user_id", F.to_json("list").alias("value"), F.lit(at + ttl).cast("long").alias("expires"))


def look_up(requests: DataFrame, cache: DataFrame, version: str, mode: str, model: str | None, count: int, at: int) -> DataFrame:
    """(user_id, value) of distinct requested users; value is null where nothing valid is kept: those are to be
    computed. Of several entries of one key the last to expire counts."""
    valid = cache.filter(F.col("expires") > at).groupBy("key").agg(F.max_by("value", "expires").alias("value"))
    return requests.select("user_id").distinct().withColumn("key", _result_key(version, mode, model, count)).join(valid, "key", "left").select("user_id", "value")
