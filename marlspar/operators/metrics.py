"""Ranking and candidate metrics, lifts, latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import discount, ideal_gain, relative_pct
from ..storage import stage


def hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """ranked (ctx, item_id, rank) cut to what is relevant; truth (ctx, item_id)."""
    return ranked.select("ctx", "item_id", "rank").join(truth.select("ctx", "item_id"), ["ctx", "item_id"], "left_semi")


def ranking_metrics(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, users, precision, recall, hit_rate, ndcg), means over all users of truth. Precision divides by k
    even for shorter lists; the ideal gain is of min(relevant, k) items."""
    relevant = truth.groupBy("ctx").agg(F.count("*").alias("relevant"))
    found = hits(ranked, truth)
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, discount(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}")]
    each = relevant.join(found.groupBy("ctx").agg(*sums), "ctx", "left")
    parts = []
    for k in ks:
        n, gain = F.coalesce(f"hits_{k}", F.lit(0)), F.coalesce(f"dcg_{k}", F.lit(0.0))
        parts.append(F.struct(F.lit(k).alias("k"), (n / k).alias("precision"), (n / F.col("relevant")).alias("recall"), (n > 0).cast("double").alias("hit_rate"), (gain / ideal_gain(F.col("relevant"), k)).alias("ndcg")))
    long = each.select("ctx", F.explode(F.array(*parts)).alias("m")).select("m.*")
    return long.groupBy("k").agg(F.count("*").alias("users"), *(F.round(F.avg(x), 8).alias(x) for x in ("precision", "recall", "hit_rate", "ndcg")))


def candidate_metrics(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, users, recall, coverage, hits): means over all users of truth."""
    relevant = truth.groupBy("ctx").agg(F.count("*").alias("relevant"))
    counts = hits(ranked, truth).groupBy("ctx").agg(*(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks))
    each = relevant.join(counts, "ctx", "left")
    parts = [F.struct(F.lit(k).alias("k"), F.coalesce(f"hits_{k}", F.lit(0)).alias("n"), F.col("relevant")) for k in ks]
    long = each.select(F.explode(F.array(*parts)).alias("m")).select("m.*")
    return long.groupBy("k").agg(F.count("*").alias("users"), F.round(F.avg(F.col("n") / F.col("relevant")), 8).alias("recall"), F.round(F.avg((F.col("n") > 0).cast("double")), 8).alias("coverage"), F.round(F.avg("n"), 8).alias("hits"))


def group_metrics(scored: DataFrame, order: list[Column], ks: list[int]) -> DataFrame:
    """(k, groups, precision, recall, hit_rate, ndcg) of groups (example_id, label) in an order of their own;
    what is relevant is what was retrieved, and groups without it don't count."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("example_id").orderBy(*order)))
    good = ranked.filter("label = 1").select(F.col("example_id").alias("ctx"), F.col("candidate_item_id").alias("item_id"), "rank")
    return ranking_metrics(good, good, ks).withColumnRenamed("users", "groups")


def lifts(new: DataFrame, old: DataFrame, names: list[str]) -> DataFrame:
    """(k, <name>_relative_pct): null where the old value is 0."""
    b = old.select("k", *(F.col(x).alias(f"old_{x}") for x in names))
    return new.join(b, "k").select("k", *(F.round(relative_pct(F.col(x), F.col(f"old_{x}")), 8).alias(f"{x}_relative_pct") for x in names))


def latency_summary(samples: DataFrame, wall_seconds: Column, value: str = "latency_ms") -> DataFrame:
    """One row: requests, mean, nearest-rank p50, p95, p99 (index (n - 1) * f, halves to even), requests a second.

    Values are counted by value and the counts cumulated part by part, so that no task orders all samples."""
    counts = samples.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("part", F.spark_partition_id())
    counts = stage(counts, "values")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n_part"))
    base = parts.select("part", F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    until = Window.partitionBy("part").orderBy("v")
    placed = counts.join(F.broadcast(base), "part").withColumn("until", F.col("base") + F.sum("n").over(until))
    total = samples.agg(F.count("*").alias("requests"), F.avg(value).alias("mean"))
    index = lambda f: F.bround((F.col("requests") - 1) * F.lit(f)).cast("long")
    at = [F.min(F.when(F.col("until") > index(f), F.col("v"))).alias(f"p{int(f * 100)}_ms") for f in (0.50, 0.95, 0.99)]
    out = placed.join(F.broadcast(total)).groupBy("requests", "mean").agg(*at)
    return out.select("requests", F.round("mean", 8).alias("mean_ms"), *(F.round(f"p{p}_ms", 8).alias(f"p{p}_ms") for p in (50, 95, 99)), F.round(F.col("requests") / wall_seconds, 8).alias("throughput"))


def confidence_interval(values: DataFrame, value: str) -> DataFrame:
    """One row: n, mean and the 95 % interval by Student's t for up to five values, else 1.96."""
    # Critical values for 2, 3, 4 and 5 values.
    critical = F.when(F.col("n") == 2, 12.706).when(F.col("n") == 3, 4.303).when(F.col("n") == 4, 3.182).when(F.col("n") == 5, 2.776).otherwise(1.96)
    base = values.agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.stddev_samp(value).alias("sd"))
    margin = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(critical * F.col("sd") / F.sqrt("n"))
    return base.select("n", F.round("mean", 8).alias("mean"), F.round(F.col("mean") - margin, 8).alias("low"), F.round(F.col("mean") + margin, 8).alias("high"))


# Upper bounds of the latency histogram, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def latency_histogram(samples: DataFrame, value: str = "latency_ms", by: str = "event_type") -> DataFrame:
    """(by, le, n): cumulative counts up to each bound, and all of them at infinity."""
    counts = samples.groupBy(by).agg(*(F.count_if(F.col(value) <= b * 1000).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.count("*").alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)]
    return counts.select(by, F.explode(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))).alias("x")).select(by, "x.le", "x.n")
