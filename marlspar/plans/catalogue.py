"""The named queries over the star-schema tables, each an operator applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FOLDS
from ..functions.scoring import knuth_bucket
from ..functions.vectors import absolute_difference, hadamard
from ..operators import candidates, examples, features, graph, history, ingest, metrics, profile, quality, rankers, serving, traffic, windows
from ..storage import stage
from ..sources.adapters import click_interactions, latencies, order_interactions, part_categories, supplier_log

KS = [5, 10, 20]


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.valid(click_interactions(spark, d))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return ingest.valid(order_interactions(spark, d))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Clicks in the raw log's columns."""
    return click_interactions(spark, d).select("timestamp", F.col("user_id").alias("visitorid"), F.col("event_type").alias("event"), F.col("item_id").alias("itemid"), F.col("transaction_id").alias("transactionid"))


def _shown_recent() -> F.Column:
    """Arrays as text: time:item:weight, latest first."""
    return F.array_join(F.transform("recent_items", lambda x: F.concat_ws(":", x["timestamp"], x["item_id"], x["event_weight"].cast("long"))), ",")


def _rounded(*names: str) -> list[F.Column]:
    return [F.round(x, 8).alias(x) for x in names]


# features


def scan_project(spark, d):
    return click_interactions(spark, d)


def _as_of(events: DataFrame) -> int:
    return features.as_of(events) or 0


def user_features(spark, d):
    events = _clicks(spark, d)
    return features.user_features(events, _as_of(events)).withColumn("recent_items", _shown_recent())


def user_recent_items(spark, d):
    return features.recent_items(_clicks(spark, d)).select("user_id", _shown_recent().alias("recent_items"))


def item_features(spark, d):
    events = _clicks(spark, d)
    return features.item_features(events, _as_of(events))


def interaction_features(spark, d):
    events = _clicks(spark, d)
    return features.interaction_features(events, _as_of(events))


def watermark(spark, d):
    return ingest.watermark(_clicks(spark, d))


# ingest


def ingest_bronze(spark, d):
    return ingest.bronze(_raw(spark, d)).withColumn("event_date", F.col("event_date").cast("string"))


def ingest_dedup(spark, d):
    events = _clicks(spark, d).select(*ingest.KEY)
    return events.unionByName(events).dropDuplicates(ingest.KEY)


def incremental_delta(spark, d):
    events = _clicks(spark, d)
    return ingest.after(events, profile.boundaries(events).first()["train_end"])


def _parts(spark, d):
    """A full snapshot of the older events and a delta of the newer."""
    events = _clicks(spark, d)
    cut = profile.boundaries(events).first()["train_end"]
    return events, events.filter(F.col("timestamp") <= cut), ingest.after(events, cut)


def delta_compaction(spark, d):
    events, full, delta = _parts(spark, d)
    last = _as_of(events)
    pairs = features.compact_interactions([features.interaction_features(x, last) for x in (full, delta)], last)
    return features.compact_users([features.user_features(x, last) for x in (full, delta)], pairs, last).withColumn("recent_items", _shown_recent())


def item_compaction(spark, d):
    events, full, delta = _parts(spark, d)
    last = _as_of(events)
    pairs = features.compact_interactions([features.interaction_features(x, last) for x in (full, delta)], last)
    return features.compact_items([features.item_features(x, last) for x in (full, delta)], pairs, last)


def validate_domain(spark, d):
    return ingest.domain_counts(click_interactions(spark, d))


def quality_report(spark, d):
    events = _clicks(spark, d)
    last = _as_of(events)
    tables = (("user", features.user_features(events, last), ["user_id"]), ("item", features.item_features(events, last), ["item_id"]), ("interaction", features.interaction_features(events, last), ["user_id", "item_id"]))
    rows = [quality.check_table(t, n, k) for n, t, k in tables]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# profile and split


def _raw_text(spark, d):
    raw = _raw(spark, d)
    return raw.select(*(F.col(c).cast("string").alias(c) for c in raw.columns))


def profile_events(spark, d):
    return profile.profile(_raw_text(spark, d))


def profile_events_sample(spark, d):
    first = spark.read.parquet(f"{d}/events.parquet").orderBy("event_id").limit(500)
    kind = F.col("event_type")
    name = F.when(kind == "click", "addtocart").when(kind == "purchase", "transaction").otherwise(kind)
    raw = first.select(F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("visitorid"), name.alias("event"), F.get_json_object("props", "$.k").alias("itemid"), F.when(kind == "purchase", F.col("event_id").cast("string")).alias("transactionid"))
    return profile.profile(raw)


def split_boundaries(spark, d):
    return profile.boundaries(_clicks(spark, d))


def split_assign(spark, d):
    return profile.assign_split(_clicks(spark, d))


def split_report(spark, d):
    return profile.split_report(profile.assign_split(_clicks(spark, d)))


# backtests


def _backtest(spark, d, warm_only=True, most=100):
    return windows.backtest(_clicks(spark, d), part_categories(spark, d), most, warm_only)


def _past(spark, d):
    return history.with_graph(profile.assign_split(_clicks(spark, d)).filter("split != 'test'").drop("split"))


def popularity(spark, d):
    return history.ranked(history.popularity(_past(spark, d))).select("item_id", "score", "rank")


def _popular_lists(spark, d, most=20, warm_only=False):
    b = _backtest(spark, d, warm_only, most)
    contexts = b.truth.select(F.lit(0).alias("g"), F.col("user_id").alias("ctx")).distinct()
    return b, candidates.popular_source(contexts, b.context_seen, b.graph, most)


def popularity_topk(spark, d):
    return _popular_lists(spark, d)[1].select(F.col("ctx").alias("user_id"), "item_id", "rank")


def ground_truth_stats(spark, d):
    return history.truth_statistics(_backtest(spark, d).relevant)


def ground_truth_warm(spark, d):
    return _backtest(spark, d).truth


def _truth(b):
    return b.truth.withColumnRenamed("user_id", "ctx")


def metrics_popularity(spark, d):
    b, lists = _popular_lists(spark, d)
    return metrics.ranking_metrics(lists, _truth(b), KS)


# graphs


def user_history(spark, d):
    folded = history.fold(history.with_graph(_orders(spark, d)))
    return history.capped(folded).drop("g")


def _order_history(spark, d):
    return history.capped(history.fold(history.with_graph(_orders(spark, d))))


def cooccurrence_pairs(spark, d):
    return graph.pairs(_order_history(spark, d)).drop("g")


def cooccurrence_neighbors(spark, d):
    return graph.neighbors(_order_history(spark, d)).select("item_id", "other", F.round("similarity", 8).alias("similarity"), "rank")


def session_transitions(spark, d):
    return graph.transitions(history.with_graph(_clicks(spark, d))).select("item_id", "other", F.round("transition_score", 8).alias("transition_score"), "rank")


def item_categories(spark, d):
    log = supplier_log(spark, d)
    last = log.agg(F.max("timestamp")).first()[0]
    return graph.item_categories(log, last - 86_400_000 * 365, "supplier")


def category_popularity(spark, d):
    return graph.category_lists(history.popularity(history.with_graph(_clicks(spark, d))), part_categories(spark, d)).drop("g")


# candidates


def _user(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.col("ctx").alias("user_id"), "item_id", *columns)


def cooccurrence_scores(spark, d):
    b = _backtest(spark, d)
    return _user(candidates.plain_scores(b.contexts, b.history, b.context_seen, b.graph), "score", "recent_score", "n_sources", F.round("max_similarity", 8).alias("max_similarity"))


def _backfilled(b, most=100):
    scored = candidates.plain_scores(b.contexts, b.history, b.context_seen, b.graph)
    return candidates.backfilled(b.contexts, scored, b.context_seen, b.graph, most)


def cooccurrence_backfill(spark, d):
    return _user(_backfilled(_backtest(spark, d)), "rank", "tier")


def session_source(spark, d):
    b = _backtest(spark, d)
    return _user(candidates.session_source(b.history, b.context_seen, b.graph), "rank")


def category_source(spark, d):
    b = _backtest(spark, d)
    return _user(candidates.category_source(b.history, b.context_seen, b.graph), "rank")


def _fused(b):
    return candidates.fuse(candidates.sources(b.contexts, b.history, b.context_seen, b.graph), 100)


def rrf_fusion(spark, d):
    return _user(_fused(_backtest(spark, d)), "rrf", "rank")


def source_contribution(spark, d):
    return candidates.contribution(_fused(_backtest(spark, d)))


def source_flags(spark, d):
    return _user(_fused(_backtest(spark, d)), *(f"from_{s}" for s in candidates.SOURCES))


def metrics_cooccurrence(spark, d):
    b = _backtest(spark, d)
    return metrics.ranking_metrics(_backfilled(b), _truth(b), KS)


def metrics_hybrid(spark, d):
    b = _backtest(spark, d)
    return metrics.candidate_metrics(_fused(b), _truth(b), [50, 100])


def relative_lift(spark, d):
    b = _backtest(spark, d)
    new = metrics.ranking_metrics(_backfilled(b), _truth(b), KS)
    old = metrics.ranking_metrics(candidates.popular_source(b.contexts, b.context_seen, b.graph, 100), _truth(b), KS)
    return metrics.lifts(new, old, ["precision", "recall", "hit_rate", "ndcg"])


# examples


def _rolling(spark, d, ratios=((0.70, 1.0),)):
    return windows.rolling(_clicks(spark, d), part_categories(spark, d), ratios)


def rolling_targets(spark, d):
    return _rolling(spark, d).found.select(F.col("ctx").alias("example_id"), "user_id", "item_id", "timestamp", "seq")


def rolling_skips(spark, d):
    events = _clicks(spark, d)
    low, high = windows.time_range(events)
    flags = windows.target_flags(windows.sequenced(events)).filter(F.col("timestamp") >= windows.cutoff(low, high, 0.70))
    return flags.agg(F.count("*").alias("relevant_rows"), F.count_if("repeat").alias("skipped_repeat_target"), F.count_if(F.col("no_history") & ~F.col("repeat")).alias("skipped_no_history"))


def point_in_time_history(spark, d):
    return _rolling(spark, d).history.select(F.col("ctx").alias("example_id"), "item_id", "weight", "timestamp", "position")


def candidate_features_v1(spark, d):
    b = _backtest(spark, d)
    return _user(candidates.first_features(b.contexts, b.history, b.context_seen, b.graph, 100), "rank", *_rounded(*candidates.BASE[:5]))


def _base(b):
    return candidates.base_features(b.contexts, b.history, b.context_seen, b.graph, 100)


def candidate_features(spark, d):
    return _user(_base(_backtest(spark, d)), "rank", *_rounded(*candidates.BASE))


def enriched_pool(spark, d):
    b = _backtest(spark, d)
    return _user(candidates.enriched_pool(b.contexts, b.history, b.context_seen, b.graph), "rank", *_rounded(*candidates.ENRICHED))


def enriched_test_groups(spark, d):
    b = _backtest(spark, d)
    rows = candidates.enriched_pool(b.contexts, b.history, b.context_seen, b.graph, fallback="zeros")
    labelled = rows.join(_truth(b).withColumn("hit", F.lit(1)), ["ctx", "item_id"], "left")
    return _user(labelled, "rank", F.coalesce("hit", F.lit(0)).alias("label"), *_rounded(*candidates.ENRICHED))


def target_timestamp(spark, d):
    b = _backtest(spark, d)
    return windows.first_target_times(b.target, b.truth)


def rolling_examples(spark, d):
    low, high = windows.time_range(_clicks(spark, d))
    return examples.rolling_examples(_rolling(spark, d), examples.validation_start(low, high))


def temporal_folds(spark, d):
    return examples.fold_examples(_rolling(spark, d, FOLDS))


def hash_sample(spark, d):
    return _clicks(spark, d).filter(knuth_bucket(F.col("user_id")) < 2500).select("timestamp", "user_id", "item_id")


#: What losses, pairs and orders of the prior read of an example.
_PRIOR = ("example_id", "candidate_item_id", "label", "retrieved_positive", "rrf_share", "reciprocal_rank")


def _training(spark, d):
    return stage(rolling_examples(spark, d).filter("split = 'train'").select(*_PRIOR), "examples")


def bpr_pairs(spark, d):
    pairs = examples.pair_rows(_training(spark, d))
    return pairs.select("example_id", "positive", "negative", "weight", F.round(rankers.retrieval_prior("p_"), 8).alias("p_prior"), F.round(rankers.retrieval_prior("n_"), 8).alias("n_prior"))


def listwise_groups(spark, d):
    return examples.complete_lists(rolling_examples(spark, d), 21)


def item_index(spark, d):
    return examples.item_index(_clicks(spark, d))


# rankers


def prior_score_bce(spark, d):
    return _user(_base(_backtest(spark, d)), F.round(rankers.bounded_prior(), 6).alias("prior"))


def bpr_loss(spark, d):
    pairs = examples.pair_rows(_training(spark, d))
    return rankers.pair_loss(pairs, rankers.retrieval_prior("p_"), rankers.retrieval_prior("n_")).withColumn("loss", F.round("loss", 6))


def listwise_loss(spark, d):
    return rankers.list_loss(_training(spark, d), rankers.retrieval_prior()).withColumn("loss", F.round("loss", 6))


def positive_weight(spark, d):
    return rankers.positive_weight(rolling_examples(spark, d))


def _judged(rows: DataFrame) -> DataFrame:
    """Groups whose target was retrieved, of validation rows."""
    found = rows.filter("retrieved_positive = 1").select("example_id")
    return rows.join(found.hint("merge"), "example_id", "left_semi")


def metrics_prior_ranker(spark, d):
    rows = stage(rolling_examples(spark, d).filter("split = 'validation'").select(*_PRIOR), "examples")
    return metrics.group_metrics(stage(_judged(rows), "judged"), rankers.prior_order(), KS)


def promotion_gate(spark, d):
    """A linear pairwise ranker against the prior on validation groups, and whether it would be served."""
    rows = stage(rolling_examples(spark, d).drop("history"), "examples")
    judged = stage(_judged(rows.filter("split = 'validation'")), "judged")
    made = rankers.train(examples.pair_rows(rows.filter("split = 'train'")), judged)
    old, new = made.values[0], made.values[made.best_epoch]
    return spark.createDataFrame([(old, new, made.best_epoch, rankers.promote(old, new, made.best_epoch))], "prior_ndcg double, ranker_ndcg double, best_epoch int, promoted boolean")


# serving


def _snapshot(spark, d):
    events = _clicks(spark, d)
    last = _as_of(events)
    g = history.with_graph(events)
    edges = stage(graph.neighbors(history.capped(history.fold(g))), "neighbors"), stage(graph.transitions(g), "transitions")
    return stage(features.user_features(events, last), "users"), stage(features.item_features(events, last), "items"), edges


def serve_history(spark, d):
    return serving.online_history(features.recent_items(_clicks(spark, d)))


def _served(spark, d, requests=None):
    users, items, edges = _snapshot(spark, d)
    return serving.recommend(users, items, *edges, requests=requests), users, items, edges


def serve_recommend(spark, d):
    return _served(spark, d)[0].filter("rank <= 10").select("user_id", "item_id", "rrf", "rank")


def serve_features(spark, d):
    return serving.online_features(*_served(spark, d))


def serve_cold_start(spark, d):
    strangers = spark.createDataFrame([(1_000_000_001,), (1_000_000_002,)], "user_id long")
    return _served(spark, d, strangers)[0].filter("rank <= 10").select("user_id", "item_id", "rrf", "rank")


def serve_challenger(spark, d):
    rows = serving.online_features(*_served(spark, d))
    scored = serving.rerank(rows, F.round(rankers.retrieval_prior() + F.col("popularity_share") * 0.5, 6), live=True)  # ranked by what is shown
    return scored.filter("served_rank <= 10").select("user_id", "item_id", "rank", "challenger_score", "served_rank")


def popular_items(spark, d):
    return serving.popular_items(item_features(spark, d))


def publish_kv(spark, d):
    """The rows that would be sent, with some fields read back from their JSON."""
    rows = serving.key_values(item_features(spark, d), "v1", "item", ["item_id"])
    back = F.from_json("value", "item_id long, event_count long, weighted_popularity double")
    return rows.select("key", back.alias("v")).select("key", "v.*")


# evidence and traffic


def latency_summary(spark, d):
    return metrics.latency_summary(latencies(spark, d), F.lit(60.0))


def confidence_interval(spark, d):
    return metrics.confidence_interval(latencies(spark, d).groupBy("event_type").agg(F.max("latency_ms").alias("v")), "v")


def latency_histogram(spark, d):
    return metrics.latency_histogram(latencies(spark, d))


def request_counts(spark, d):
    rows = latencies(spark, d).select("event_id", F.col("repetition").alias("user_id"), "ms")
    return traffic.request_counts(rows, "user_id", "ms", 3_600_000)


def rate_limit(spark, d):
    rows = latencies(spark, d).select("event_id", F.col("repetition").alias("user_id"), "ms")
    return traffic.admit(rows, "user_id", "ms", "event_id", 1, 3_600_000)


def metric_flatten(spark, d):
    rows = latencies(spark, d).agg(F.count("*").alias("n"), F.count_distinct("repetition").alias("u"), F.round(F.avg("latency_ms"), 8).alias("m"))
    report = F.struct(F.struct(F.col("n").alias("rows"), F.col("u").alias("users")).alias("events"), F.struct(F.struct(F.col("m").alias("mean")).alias("@10")).alias("metrics"), F.lit(True).alias("is_sample"), F.lit("x").alias("note"))
    return traffic.flatten_metrics(rows.select(report.alias("report")), "report")


def embedding_interaction(spark, d):
    """Each vector against the mean of its label: sums of the product and of the absolute difference."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    each = vectors.select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return vectors.join(means, "label").select("vec_id", total(hadamard("embedding", "mean")).alias("product_sum"), total(absolute_difference("embedding", "mean")).alias("difference_sum"))


_NAMES = """scan_project user_features user_recent_items item_features interaction_features watermark ingest_bronze ingest_dedup incremental_delta delta_compaction item_compaction
validate_domain quality_report profile_events profile_events_sample split_boundaries split_assign split_report popularity popularity_topk ground_truth_stats ground_truth_warm metrics_popularity
user_history cooccurrence_pairs cooccurrence_neighbors session_transitions item_categories category_popularity cooccurrence_scores cooccurrence_backfill session_source category_source rrf_fusion
source_contribution source_flags metrics_cooccurrence metrics_hybrid relative_lift rolling_targets rolling_skips point_in_time_history candidate_features_v1 candidate_features enriched_pool
enriched_test_groups target_timestamp rolling_examples temporal_folds hash_sample bpr_pairs listwise_groups item_index prior_score_bce bpr_loss listwise_loss positive_weight metrics_prior_ranker
promotion_gate serve_history serve_recommend serve_features serve_cold_start serve_challenger popular_items publish_kv latency_summary confidence_interval latency_histogram request_counts
rate_limit metric_flatten embedding_interaction""".split()


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Ranks as BIGINT, as SQL's row_number gives them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = query(spark, d)
        ranks = {c: F.col(c).cast("long") for c in ("rank", "position", "seq", "category_rank", "served_rank", "idx") if c in out.columns}
        return out.withColumns(ranks) if ranks else out

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _wide(globals()[name]) for name in _NAMES}
