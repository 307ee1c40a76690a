"""Candidate sources, fusion and features, for any set of contexts.

A context is whoever needs a list: a user in a backtest, an example in training. `history` has the rows
(g, ctx, item_id, weight, timestamp, position), `contexts` (g, ctx, at): one row a context with its prediction
time. `seen` has the rows (g, ctx, item_id), or is a Before, where contexts of one user would repeat them. Scores are rounded to 8 decimals before they rank, so that the order
of summation doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import FUSION, RANK_CONSTANT
from ..functions.scoring import recency, strength
from ..storage import stage

SOURCES = tuple(FUSION)
SESSION_ITEMS, CATEGORIES = 10, 5
#: Contexts that have seen more items than this find their popular items by ranks instead of arrays.
LISTED = 1000
#: Graphs of more edges than this aren't broadcast. History rows that a task follows through a graph.
EDGES, FOLLOWED = 1 << 20, 20_000
KEY = ["g", "ctx", "item_id"]


@dataclass(frozen=True)
class Graph:
    """What a window before the prediction knows."""

    neighbors: DataFrame
    transitions: DataFrame
    category_lists: DataFrame
    categories: DataFrame
    popularity: DataFrame
    top: DataFrame  # (g, items, scores), LISTED + the wanted number deep
    ranks: DataFrame | None = None  # (g, item_id, rank) of all popular items; None if no context has seen more than LISTED

    @property
    def items(self) -> DataFrame:
        return described(self.popularity, self.categories)


@dataclass(frozen=True)
class Before:
    """A context has seen what its user met first at a seq below `until`: a row a pair and a row a context
    instead of a row for each item of each context."""

    met: DataFrame  # (user_id, item_id, first_seq), a row a pair
    contexts: DataFrame  # (g, ctx, user_id, until, n_seen)
    listed: DataFrame | None = None  # (g, ctx, item_id) of the contexts that have seen LISTED items at most
    deep: bool = True  # whether any has seen more
    buckets: int = 0  # in so many lie contexts, listed and all other tables of these contexts by (g, ctx); 0: anywhere

    def others(self) -> Before:
        """Without the listed contexts."""
        return self if self.listed is None else Before(self.met, self.contexts.filter(F.col("n_seen") > LISTED), buckets=self.buckets)

    def rows(self, items: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
        """(g, ctx, item_id), of these items (g, item_id) or contexts (g, ctx) only."""
        met = self.met if items is None else self.met.join(items, "item_id")
        own = self.contexts if contexts is None else self.contexts.join(contexts, ["g", "ctx"], "left_semi")
        return own.join(met, ["user_id"] if items is None else ["g", "user_id"]).filter("first_seq < until").select("g", "ctx", "item_id")


def _buckets(seen: DataFrame | Before) -> int:
    return seen.buckets if isinstance(seen, Before) else 0


def _stage(rows: DataFrame, label: str, seen: DataFrame | Before) -> DataFrame:
    """Staged in the buckets that the contexts lie in."""
    return stage(rows, label, by=("g", "ctx"), buckets=_buckets(seen))


def small(table: DataFrame) -> DataFrame:
    """table, to be broadcast where it has EDGES rows at most."""
    return F.broadcast(table) if table.count() <= EDGES else table


def described(popularity: DataFrame, categories: DataFrame) -> DataFrame:
    """(g, item_id, popularity, category_id) of the items of a graph, of which all candidates are."""
    return popularity.select("g", "item_id", F.col("score").alias("popularity")).join(categories.select("item_id", "category_id"), "item_id", "left").select("g", "item_id", "popularity", "category_id")


def categorised(history: DataFrame, categories: DataFrame) -> DataFrame:
    """history with category_id, which it may have already; rows without one go."""
    own = history if "category_id" in history.columns else history.join(categories.select("item_id", "category_id"), "item_id")
    return own.filter("category_id IS NOT NULL")


def unseen(rows: DataFrame, seen: DataFrame | Before) -> DataFrame:
    """Rows (g, ctx, item_id, ...) whose item the context hasn't seen."""
    if isinstance(seen, DataFrame):
        return rows.join(seen.select(*KEY), KEY, "left_anti")
    if seen.listed is not None:
        if not seen.deep:
            return unseen(rows, seen.listed)
        many = seen.others()
        few, deep = (rows.join(many.contexts.select("g", "ctx"), ["g", "ctx"], how) for how in ("left_anti", "left_semi"))
        return unseen(few, seen.listed).unionByName(unseen(deep, many))
    who = F.col("user_id").alias("seen_by")  # rows may have a user_id
    own = rows.join(seen.contexts.select("g", "ctx", who, "until"), ["g", "ctx"]).join(seen.met.select(who, "item_id", "first_seq"), ["seen_by", "item_id"], "left")
    return own.filter("first_seq IS NULL OR first_seq >= until").select(*rows.columns)


def seen_rows(seen: DataFrame | Before, items: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """(g, ctx, item_id), of these items or contexts only."""
    if isinstance(seen, Before):
        if seen.listed is None:
            return seen.rows(items, contexts)
        few = seen_rows(seen.listed, items, contexts)
        return few.unionByName(seen.others().rows(items, contexts)) if seen.deep else few
    out = seen.select("g", "ctx", "item_id")
    out = out if items is None else out.join(items, ["g", "item_id"], "left_semi")
    return out if contexts is None else out.join(contexts, ["g", "ctx"], "left_semi")


def followed(history: DataFrame, edges: DataFrame, score: str, seen: DataFrame | Before, *sums: Column, contexts: DataFrame | None = None) -> DataFrame:
    """(g, ctx, item_id, sums) of the neighbours of history items that weren't seen. sums are over similarity,
    weight, timestamp, position and, with contexts, at. Histories are gathered by context first and graphs of
    EDGES edges at most broadcast, so that a neighbour is summed where it is found; what was seen goes after that."""
    own = edges.select("g", F.col("item_id").alias("source"), F.col("other"), F.col(score).alias("similarity"))
    own = small(own)
    parts = _buckets(seen) or max(history.sparkSession.sparkContext.defaultParallelism, history.count() // FOLLOWED)
    by = history.withColumnRenamed("item_id", "source").repartition(parts, "g", "ctx")
    by = by if contexts is None else by.join(contexts.select("g", "ctx", "at"), ["g", "ctx"])
    return unseen(by.join(own, ["g", "source"]).withColumnRenamed("other", "item_id").groupBy(*KEY).agg(*sums), seen)


def _total(value: Column) -> Column:
    return F.round(F.sum(value), 8)


def _ranked(scored: DataFrame, most: int, source: str) -> DataFrame:
    order = Window.partitionBy("g", "ctx").orderBy(F.desc("score"), "item_id")
    out = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return out.select("g", "ctx", "item_id", F.lit(source).alias("source"), "rank")


def decayed(value: str = "similarity") -> Column:
    return strength(F.col("weight")) / (F.col("position") + 1) * F.col(value)


def neighbor_source(history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int = 100, scored: DataFrame | None = None) -> DataFrame:
    """scored: plain_scores, if they are there."""
    if scored is None:
        return _ranked(followed(history, graph.neighbors, "similarity", seen, _total(decayed()).alias("score")), most, "item_cooccurrence")
    return _ranked(scored.select(*KEY, F.col("decayed_score").alias("score")), most, "item_cooccurrence")


def session_scores(history: DataFrame, seen: DataFrame | Before, graph: Graph) -> DataFrame:
    recent = history.filter(F.col("position") < SESSION_ITEMS)
    return followed(recent, graph.transitions, "transition_score", seen, _total(decayed()).alias("score"))


def session_source(history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int = 100) -> DataFrame:
    return _ranked(session_scores(history, seen, graph), most, "session_transition")


def category_source(history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int = 100) -> DataFrame:
    """Popular items of the five latest categories, newest category first."""
    first = categorised(history, graph.categories).groupBy("g", "ctx", "category_id").agg(F.min("position").alias("at"))
    newest = first.withColumn("nth", F.row_number().over(Window.partitionBy("g", "ctx").orderBy("at"))).filter(F.col("nth") <= CATEGORIES)
    items = unseen(newest.join(small(graph.category_lists), ["g", "category_id"]), seen)
    order = Window.partitionBy("g", "ctx").orderBy("nth", "category_rank")
    out = items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return out.select("g", "ctx", "item_id", F.lit("category_popularity").alias("source"), "rank")


def popular_source(contexts: DataFrame, seen: DataFrame | Before, graph: Graph, most: int = 100, listed: int = LISTED, also: DataFrame | None = None) -> DataFrame:
    """The first popular items that a context hasn't seen, nor has in `also` (g, ctx, item_id). Contexts that
    have seen `listed` items of the top list at most take the difference of two bounded arrays, the others go by
    ranks (popular_by_rank). Seen items off the list can't change the difference."""
    wanted, more = contexts.select("g", "ctx"), lambda rows: rows if also is None else (_stage(rows, "near", seen) if _buckets(seen) else rows).unionByName(also)
    top = F.broadcast(graph.top.select("g", F.explode("items").alias("item_id")))  # LISTED + the wanted number a graph
    near = more(seen_rows(seen, top))
    if graph.ranks is not None:
        near = stage(near, "near")
        many = stage(near.groupBy("g", "ctx").agg(F.count("*").alias("n_seen")).filter(F.col("n_seen") > listed).select("g", "ctx"), "many")
        all_seen = more(seen_rows(seen, contexts=many)).join(many, ["g", "ctx"], "left_semi")
        deep = popular_by_rank(wanted.join(many, ["g", "ctx"], "left_semi"), all_seen, graph.ranks, most)
        wanted, near = (x.join(many, ["g", "ctx"], "left_anti") for x in (wanted, near))
    own = wanted.join(near.groupBy("g", "ctx").agg(F.collect_list("item_id").alias("own")), ["g", "ctx"], "left")
    own = own.join(F.broadcast(graph.top.select("g", "items")), "g")  # a row a graph, of bounded length
    left = F.slice(F.array_except("items", F.coalesce("own", F.array().cast("array<bigint>"))), 1, most)
    out = own.select("g", "ctx", F.posexplode(left).alias("nth", "item_id")).withColumn("rank", F.col("nth") + 1)
    if graph.ranks is not None:
        out = out.select("g", "ctx", "item_id", "rank").unionByName(deep)
    return out.select("g", "ctx", "item_id", F.lit("global_popularity").alias("source"), "rank")


def popular_by_rank(contexts: DataFrame, seen: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """(g, ctx, item_id, rank): the first popular items unseen, whatever the length of the seen list. The ranks
    of seen items leave gaps; the gaps' first `most` ranks are looked up. A context is sorted, never gathered."""
    known = seen.select("g", "ctx", "item_id").distinct().join(ranks.select("g", "item_id", "rank"), ["g", "item_id"]).select("g", "ctx", "rank")
    marks = known.unionByName(contexts.select("g", "ctx", F.lit(0).cast(ranks.schema["rank"].dataType).alias("rank")))
    order = Window.partitionBy("g", "ctx").orderBy("mark")
    before = F.col("mark") - F.row_number().over(order) + 1  # unseen items above the mark
    gaps = marks.withColumnRenamed("rank", "mark").withColumns({"before": before, "next": F.lead("mark").over(order)}).filter(F.col("before") < most)
    start, end = F.col("mark") + 1, F.least(F.col("next") - 1, F.col("mark") + most - F.col("before"))  # least passes over nulls
    free = F.explode(F.when(start <= end, F.sequence(start, end, F.lit(1).cast("long"))))
    found = gaps.select("g", "ctx", "mark", "before", free.alias("place")).select("g", "ctx", "place", (F.col("before") + F.col("place") - F.col("mark")).cast("int").alias("nth"))
    return found.join(ranks.select("g", "item_id", F.col("rank").alias("place")), ["g", "place"]).select("g", "ctx", "item_id", F.col("nth").alias("rank"))


def sources(contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int = 100, scored: DataFrame | None = None) -> DataFrame:
    """(g, ctx, item_id, source, rank) of all four sources. scored: plain_scores, if they are there."""
    made = neighbor_source(history, seen, graph, most, scored), session_source(history, seen, graph, most), category_source(history, seen, graph, most), popular_source(contexts, seen, graph, most)
    # a union keeps buckets where its parts are read just as they were written
    return reduce(DataFrame.unionByName, (_stage(x, "source", seen) for x in made) if _buckets(seen) else made)


def fuse(ranked: DataFrame, most: int, weights: dict[str, float] = FUSION, constant: int = RANK_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion: (g, ctx, item_id, rrf, top_rrf, rank, from_<source>). top_rrf is the context's
    largest score over all fused items."""
    weight = F
    for name, value in weights.items():
        weight = weight.when(F.col("source") == name, F.lit(value))
    cut = ranked.filter(F.col("rank") <= most)
    flags = [F.max((F.col("source") == s).cast("int")).alias(f"from_{s}") for s in weights]
    scored = cut.groupBy("g", "ctx", "item_id").agg(_total(weight / (F.lit(constant) + F.col("rank"))).alias("rrf"), *flags)
    order = Window.partitionBy("g", "ctx").orderBy(F.desc("rrf"), "item_id")
    return scored.withColumns({"top_rrf": F.first("rrf").over(order), "rank": F.row_number().over(order)}).filter(F.col("rank") <= most)


def contribution(fused: DataFrame) -> DataFrame:
    """(source, fused_items, contexts): how many fused items each source holds too; an item counts for all of them."""
    names = [c for c in fused.columns if c.startswith("from_")]
    pairs = F.explode(F.array(*(F.struct(F.lit(c[5:]).alias("source"), F.col(c).alias("held")) for c in names)))
    each = fused.select("g", "ctx", pairs.alias("s")).select("g", "ctx", "s.source", "s.held")
    by_ctx = each.groupBy("source", "g", "ctx").agg(F.sum("held").alias("held"))
    return by_ctx.groupBy("source").agg(F.sum("held").alias("fused_items"), F.count_if(F.col("held") > 0).alias("contexts"))


def plain_scores(contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph) -> DataFrame:
    """(g, ctx, item_id): undecayed, recency-weighted and decayed scores, number of sources, largest similarity."""
    value = strength(F.col("weight")) * F.col("similarity")
    sums = [_total(value).alias("score"), _total(value * recency(F.col("at"), F.col("timestamp"))).alias("recent_score"), _total(decayed()).alias("decayed_score")]
    out = followed(history, graph.neighbors, "similarity", seen, *sums, F.count("*").alias("n_sources"), F.max("similarity").alias("max_similarity"), contexts=contexts)
    return _stage(out, "scores", seen)  # ranked, joined and reduced to its maxima by the callers


def backfilled(contexts: DataFrame, scored: DataFrame, seen: DataFrame | Before, graph: Graph, most: int) -> DataFrame:
    """(g, ctx, item_id, rank, tier): scored candidates first, then popular items, `most` in all."""
    order = Window.partitionBy("g", "ctx").orderBy(F.desc("score"), "item_id")
    first = scored.select("g", "ctx", "item_id", F.lit(0).alias("tier"), F.row_number().over(order).alias("nth")).filter(F.col("nth") <= most)
    first = _stage(first, "first", seen)
    popular = popular_source(contexts, seen, graph, most, also=first.select("g", "ctx", "item_id"))
    both = first.unionByName(popular.select("g", "ctx", "item_id", F.lit(1).alias("tier"), F.col("rank").alias("nth")))
    place = Window.partitionBy("g", "ctx").orderBy("tier", "nth")
    return _stage(both.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most).select("g", "ctx", "item_id", "rank", "tier"), "pool", seen)


def context_sizes(contexts: DataFrame, history: DataFrame, seen: DataFrame | Before) -> DataFrame:
    """(g, ctx, n_history, n_seen)."""
    h = history.groupBy("g", "ctx").agg(F.count("*").alias("n_history"))
    s = seen.contexts.select("g", "ctx", "n_seen") if isinstance(seen, Before) else seen.groupBy("g", "ctx").agg(F.count("*").alias("n_seen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return contexts.select("g", "ctx").join(h, ["g", "ctx"], "left").join(s, ["g", "ctx"], "left").select("g", "ctx", zero("n_history"), zero("n_seen"))


BASE = ("score_share", "log_popularity", "reciprocal_rank", "source_share", "history_size", "recency_share", "max_similarity", "category_share")
ENRICHED = (*BASE, "rrf_share", *(f"from_{s}" for s in SOURCES))


#: Features of an item that need no place in the base pool.
ANYWHERE = ("log_popularity", "history_size", "category_share")


def _with_popularity(rows: DataFrame, graph: Graph) -> DataFrame:
    """rows (with popularity) with log_popularity."""
    most = graph.top.select("g", F.element_at("scores", 1).alias("top_popularity"))  # a row a graph
    return rows.join(F.broadcast(most), "g").withColumn("log_popularity", F.log1p(F.coalesce("popularity", F.lit(0.0))) / F.log1p("top_popularity"))


def _with_category_share(rows: DataFrame, history: DataFrame, graph: Graph) -> DataFrame:
    """What part of a context's categorised history is of the category of the row (with category_id)."""
    known = categorised(history, graph.categories).groupBy("g", "ctx", "category_id").agg(F.count("*").alias("n_category"))
    total = F.sum("n_category").over(Window.partitionBy("g", "ctx"))
    share = known.withColumn("category_share", F.col("n_category") / total).select("g", "ctx", "category_id", "category_share")
    return rows.join(share, ["g", "ctx", "category_id"], "left").withColumn("category_share", F.coalesce("category_share", F.lit(0.0))).drop("category_id")


def _with_features(rows: DataFrame, contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph, scored: DataFrame) -> DataFrame:
    """Candidates (g, ctx, item_id, place, ...) with the eight features; place: the rank in the base pool. Outside it
    (null) they have those of ANYWHERE and zeros. Scores are shares of the largest over everything scored, not over the pool alone."""
    top = scored.groupBy("g", "ctx").agg(F.max("score").alias("top_score"), F.max("recent_score").alias("top_recent"))
    own = rows.join(scored, KEY, "left").join(top, ["g", "ctx"], "left").join(context_sizes(contexts, history, seen), ["g", "ctx"])
    own = _with_category_share(_with_popularity(own.join(small(graph.items), ["g", "item_id"], "left"), graph), history, graph)
    inside = lambda x: F.coalesce(F.when(F.col("place").isNotNull(), x), F.lit(0.0))
    values = {
        "score_share": inside(F.col("score") / F.col("top_score")), "log_popularity": F.col("log_popularity"), "reciprocal_rank": inside(F.lit(1.0) / F.col("place")),
        "source_share": inside(F.coalesce("n_sources", F.lit(0)) / F.greatest("n_history", F.lit(1))), "history_size": F.log1p("n_seen") / F.log1p(F.lit(50.0)),
        "recency_share": inside(F.col("recent_score") / F.col("top_recent")), "max_similarity": inside(F.col("max_similarity")), "category_share": F.col("category_share"),
    }
    return own.select(*rows.columns, *(values[x].alias(x) for x in BASE))


def base_features(contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int) -> DataFrame:
    """The backfilled pool with its eight features."""
    scored = plain_scores(contexts, history, seen, graph)
    pool = backfilled(contexts, scored, seen, graph, most).select(*KEY, "rank", F.col("rank").alias("place"))
    return _with_features(pool, contexts, history, seen, graph, scored).drop("place")


def first_features(contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int) -> DataFrame:
    """The first generation: five of the features."""
    return base_features(contexts, history, seen, graph, most).select("g", "ctx", "item_id", "rank", *BASE[:5])


def fallback_features(rows: DataFrame, contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph) -> DataFrame:
    """Rows (g, ctx, item_id, ...) with the eight features of an item outside the pool: popularity, history
    size and category only."""
    own = rows.join(context_sizes(contexts, history, seen), ["g", "ctx"]).join(graph.popularity.select("g", "item_id", F.col("score").alias("popularity")), ["g", "item_id"], "left")
    own = _with_category_share(_with_popularity(own.join(graph.categories.select("item_id", "category_id"), "item_id", "left"), graph), history, graph)
    values = {x: F.lit(0.0) for x in BASE} | {"log_popularity": F.col("log_popularity"), "history_size": F.log1p("n_seen") / F.log1p(F.lit(50.0)), "category_share": F.col("category_share")}
    return own.select(*rows.columns, *(v.alias(k) for k, v in values.items()))


def enriched_pool(contexts: DataFrame, history: DataFrame, seen: DataFrame | Before, graph: Graph, most: int = 100, fallback: str = "popularity", wanted: Callable[[DataFrame], DataFrame] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The fused pool with thirteen features; (g, ctx, item_id, rank, extra..., ENRICHED...). Items outside the base pool
    get fallback features ("popularity") or zeros ("zeros"). wanted: chooses the rows of the fused pool that get
    features, after all ranks, and may add the columns `extra`."""
    scored = plain_scores(contexts, history, seen, graph)
    ranked = sources(contexts, history, seen, graph, most, scored)
    fused = fuse(ranked if _buckets(seen) else stage(ranked, "sources"), most)
    fused = _stage(fused if wanted is None else wanted(fused), "fused", seen)
    place = backfilled(contexts, scored, seen, graph, most).select(*KEY, F.col("rank").alias("place"))
    rows = _with_features(fused.join(place, KEY, "left"), contexts, history, seen, graph, scored)
    outside = {x: F.when(F.col("place").isNotNull(), F.col(x)).otherwise(F.lit(0.0)) for x in ANYWHERE} if fallback == "zeros" else {}
    flags = [F.col(f"from_{s}").cast("double").alias(f"from_{s}") for s in SOURCES]
    return rows.select(*KEY, "rank", *extra, *(outside.get(x, F.col(x)).alias(x) for x in BASE), (F.col("rrf") / F.col("top_rrf")).alias("rrf_share"), *flags)
