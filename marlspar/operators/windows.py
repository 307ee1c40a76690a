"""Backtest and training windows over one event table: contexts, histories and graphs for candidates.py."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import FOLDS, RELEVANT
from ..storage import measured, stage
from . import candidates, graph, history, profile

MAX_HISTORY, NEIGHBORS, SESSION_GAP, SESSION_EVENTS = 50, 100, 30, 200
#: Events of a user that a point-in-time history reads one by one.
BLOCK = 64


class GraphOf:
    """All item graphs of events (with g), each made and staged when it is first read, as every source of
    candidates reads them again. most: the length of the lists; longest: how many items a context has seen at most."""

    def __init__(self, events: DataFrame, categories: DataFrame, most: int, longest: int, max_history: int = MAX_HISTORY):
        self.events, self.categories, self.most, self.longest, self.max_history = events, categories, most, longest, max_history

    @cached_property
    def popularity(self) -> DataFrame:
        return stage(history.popularity(self.events), "popularity", keep=True)

    @cached_property
    def neighbors(self) -> DataFrame:
        capped = history.capped(history.fold(self.events), self.max_history)
        return stage(graph.neighbors(capped, NEIGHBORS).select("g", "item_id", "other", "similarity", "rank"), "neighbors", keep=True)

    @cached_property
    def transitions(self) -> DataFrame:
        return stage(graph.transitions(self.events, SESSION_GAP, SESSION_EVENTS), "transitions", keep=True)

    @cached_property
    def category_lists(self) -> DataFrame:
        return stage(graph.category_lists(self.popularity, self.categories), "lists", keep=True)

    @cached_property
    def top(self) -> DataFrame:
        return stage(history.top_items(self.popularity, self.most + candidates.LISTED), "top", keep=True)

    @cached_property
    def items(self) -> DataFrame:
        return stage(candidates.described(self.popularity, self.categories), "items", keep=True)

    @cached_property
    def ranks(self) -> DataFrame | None:
        """None where no context can have seen more than LISTED items, a list of candidates included."""
        if self.longest + self.most <= candidates.LISTED:
            return None
        return stage(history.ranked(self.popularity).select("g", "item_id", "rank"), "ranks", keep=True)


@dataclass(frozen=True)
class Backtest:
    past: DataFrame
    target: DataFrame
    seen: DataFrame  # g, user_id, item_id, weight, timestamp
    relevant: DataFrame
    truth: DataFrame  # user_id, item_id
    graph: candidates.Graph | GraphOf
    contexts: DataFrame  # g, ctx (the user), at
    history: DataFrame
    context_seen: DataFrame


def backtest(events: DataFrame, categories: DataFrame, most: int = 100, warm_only: bool = True, max_history: int = MAX_HISTORY) -> Backtest:
    """History is train and validation, the target is test. Candidates are made for users of the truth only."""
    split = profile.assign_split(events)
    past = stage(history.with_graph(split.filter("split != 'test'")).drop("split"), "past")
    target = split.filter("split = 'test'").drop("split")
    seen = stage(history.fold(past), "seen")
    relevant = history.relevant_rows(target, seen)
    truth = stage(history.truth(relevant, warm_only), "truth")
    built = GraphOf(past, categories, most, history.longest_seen(seen), max_history)
    at = first_target_times(target, truth)
    contexts = stage(at, "contexts").select(F.lit(0).alias("g"), F.col("user_id").alias("ctx"), F.col("target_timestamp").alias("at"))
    own = seen.join(truth.select("user_id").distinct(), "user_id", "left_semi")
    context_seen = stage(own.select("g", F.col("user_id").alias("ctx"), "item_id"), "seen")
    capped = stage(history.capped(own, max_history).withColumnRenamed("user_id", "ctx"), "history")
    return Backtest(past, target, seen, relevant, truth, built, contexts, capped, context_seen)


def first_target_times(target: DataFrame, truth: DataFrame) -> DataFrame:
    """(user_id, target_timestamp): the first event, of any type, of a user with an item of their truth."""
    return target.join(truth, ["user_id", "item_id"]).groupBy("user_id").agg(F.min("timestamp").alias("target_timestamp"))


def sequenced(events: DataFrame) -> DataFrame:
    """events with seq: a user's order by (time, item, type); rows equal on all three are interchangeable."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("timestamp", "item_id", "event_type")))


def cutoff(minimum: int, maximum: int, ratio: float) -> int:
    """First instant of the later part; ratio 1 ends after the last event."""
    if not 0 < ratio <= 1:
        raise ValueError("a time ratio lies between 0 and 1")
    return maximum + 1 if ratio == 1 else minimum + int((maximum - minimum + 1) * ratio)


def time_range(events: DataFrame) -> tuple[int, int]:
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    if low is None:
        raise ValueError("no events")
    return low, high


def target_flags(seq: DataFrame) -> DataFrame:
    """Relevant events with flags: repeat (the user met the item before), no_history (it is their first event)."""
    first = F.min("seq").over(Window.partitionBy("user_id", "item_id"))
    flagged = seq.withColumn("first_seq", first).filter(F.col("event_type").isin(*RELEVANT))
    return flagged.select("user_id", "item_id", "timestamp", "event_type", "seq", (F.col("seq") != F.col("first_seq")).alias("repeat"), (F.col("seq") == 1).alias("no_history"))


def targets(seq: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of windows (g, start, end; a handful of rows) with the targets in them: (g, user_id, item_id,
    timestamp, seq), first meetings of users with a past."""
    usable = target_flags(seq).filter("NOT repeat AND NOT no_history")
    inside = (F.col("timestamp") >= F.col("start")) & (F.col("timestamp") < F.col("end"))
    return usable.join(F.broadcast(windows), inside).select("g", "user_id", "item_id", "timestamp", "seq")


def known(seq: DataFrame) -> DataFrame:
    """seq's rows with first_seq (the user's first meeting with the item), total (the pair's weight up to the
    row) and n_seen (how many items the user had met before it)."""
    pair, own = Window.partitionBy("user_id", "item_id").orderBy("seq"), Window.partitionBy("user_id").orderBy("seq")
    so_far, before = pair.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    met = seq.withColumns({"first_seq": F.first("seq").over(pair), "total": F.sum("event_weight").over(so_far)})
    return met.withColumn("n_seen", F.count_if(F.col("seq") == F.col("first_seq")).over(before))


def point_in_time(met: DataFrame, found: DataFrame, most: int = MAX_HISTORY, block: int = BLOCK) -> DataFrame:
    """(g, ctx, user_id, item_id, weight, timestamp): what each target's user had met before it, the latest
    `most` items by (time descending, item) at least. met has the columns of known().

    A user's events are cut into blocks, and every second run of 2^k whole blocks keeps its latest `most` items.
    The whole blocks before a target are one run for each bit of their number, so a target reads its own block
    and `most` rows a bit, not all that its user ever met. Each item's last row wins; rows carry running totals,
    so a row that a run leaves out takes no weight along."""
    rows = met.select("user_id", "item_id", F.expr(f"(seq - 1) div {block}").alias("whole"), F.struct("seq", "timestamp", F.col("total").alias("weight")).alias("last"))
    ends = F.floor(F.max("last.seq").over(Window.partitionBy("user_id")) / block).cast("long")
    bits = "sequence(0, length(bin({0})) - 1)"
    runs = F.expr(f"filter({bits.format('ends')}, k -> shiftright(whole, k) % 2 = 0 AND shiftleft(shiftright(whole, k) + 1, k) <= ends)")
    spread = rows.withColumn("ends", ends).filter("whole < ends").select("user_id", "item_id", "whole", "last", F.explode(runs).alias("level"))
    grouped = spread.groupBy("user_id", "level", F.expr("shiftright(whole, level)").alias("run"), "item_id").agg(F.max("last").alias("last"))
    order = Window.partitionBy("user_id", "level", "run").orderBy(F.desc("last.timestamp"), "item_id")
    kept = grouped.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")

    wanted = found.select("g", "ctx", "user_id", F.col("seq").alias("until"), F.expr(f"(seq - 1) div {block}").alias("whole"))
    near = wanted.join(rows, ["user_id", "whole"]).filter("last.seq < until")
    level = F.explode(F.expr(f"filter({bits.format('whole')}, k -> shiftright(whole, k) % 2 = 1)")).alias("level")
    far = wanted.select("g", "ctx", "user_id", "whole", level).withColumn("run", F.expr("shiftright(whole, level + 1) * 2")).join(kept, ["user_id", "level", "run"])
    names = ("g", "ctx", "user_id", "item_id")
    last = near.select(*names, "last").unionByName(far.select(*names, "last")).groupBy(*names).agg(F.max("last").alias("last"))
    return last.select(*names, "last.weight", "last.timestamp")


@dataclass(frozen=True)
class Rolling:
    """Examples: found (g, ctx, user_id, item_id, timestamp, seq) numbered in ctx, and what candidates.py needs."""

    found: DataFrame
    contexts: DataFrame
    history: DataFrame
    seen: candidates.Before
    graph: candidates.Graph | GraphOf


def rolling(events: DataFrame, categories: DataFrame, ratios: tuple[tuple[float, float], ...] = ((0.70, 1.0),), most: int = 100, max_history: int = MAX_HISTORY) -> Rolling:
    """Examples of each (graph ends, outcomes end) of ratios, against the graph of the events before it.
    All graphs are built in one plan: an event counts in every graph that ends after it."""
    spark = events.sparkSession
    low, high = time_range(events)
    windows = [(g, cutoff(low, high, a), cutoff(low, high, b)) for g, (a, b) in enumerate(ratios)]
    table = spark.createDataFrame(windows, "g int, start long, end long")
    with measured(spark):
        seq = stage(known(sequenced(events)), "sequence")
        early = stage(events.join(F.broadcast(table.select("g", "start")), F.col("timestamp") < F.col("start")).drop("start"), "early")
        numbered = stage(number(targets(seq, table)), "targets")
        own = history.capped(point_in_time(seq, numbered, max_history), max_history, "ctx")
        until = stage(numbered.join(seq.select("user_id", "seq", "n_seen"), ["user_id", "seq"]).select("g", "ctx", "user_id", F.col("seq").alias("until"), "n_seen"), "until")
        longest = until.agg(F.max("n_seen")).first()[0] or 0
        met = seq.filter("seq = first_seq").select("user_id", "item_id", "first_seq")
        few = until.filter(F.col("n_seen") <= candidates.LISTED)
        listed = stage(candidates.Before(met, few).rows(), "listed")
        seen = candidates.Before(met, until, listed, longest > candidates.LISTED)
        contexts = numbered.select("g", "ctx", F.col("timestamp").alias("at"))
        return Rolling(numbered, contexts, stage(own, "history"), seen, GraphOf(early, categories, most, longest, max_history))


def number(found: DataFrame) -> DataFrame:
    """found with ctx: a running number by (g, user, seq) from 1. Users are counted first, so that only one
    row a user passes the global order; each user's own rows are numbered in parallel."""
    per_user = found.groupBy("g", "user_id").agg(F.count("*").alias("n"))
    spread = per_user.repartitionByRange("g", "user_id").withColumn("part", F.spark_partition_id())
    spread = stage(spread, "users")
    parts = spread.groupBy("part").agg(F.sum("n").alias("n_part"))
    bases = parts.withColumn("base", F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inside = Window.partitionBy("part").orderBy("g", "user_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.join(bases, "part").withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select("g", "user_id", "first")
    own = Window.partitionBy("g", "user_id").orderBy("seq")
    return found.join(starts, ["g", "user_id"]).withColumn("ctx", F.col("first") + F.row_number().over(own)).drop("first")


def folds() -> tuple[tuple[float, float], ...]:
    return FOLDS
