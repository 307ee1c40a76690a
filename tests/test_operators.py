"""Operators on small tables with known answers."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlspar.functions import vectors
from marlspar.operators import candidates, examples, features, graph, history, ingest, metrics, profile, quality, rankers, serving, traffic, windows
from marlspar.storage import stage

EVENTS = "timestamp long, user_id long, item_id long, event_type string, event_weight double, transaction_id string"
HISTORY = "g int, ctx long, item_id long, weight double, timestamp long, position int"


def events(spark, rows):
    weight = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
    return spark.createDataFrame([(t, u, i, e, weight.get(e), None) for t, u, i, e in rows], EVENTS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bronze_drops_late_unknown_and_repeated(spark):
    raw = spark.createDataFrame([(5, 1, "view", 10, None), (5, 1, "view", 10, None), (4, 1, "view", 10, None), (9, 1, "error", 10, None), (86_400_000, 1, "transaction", 11, "7")], "timestamp long, visitorid long, event string, itemid long, transactionid string")
    out = ingest.bronze(raw, 4)
    assert [(r.timestamp, r.event_weight, str(r.event_date)) for r in out.orderBy("timestamp").collect()] == [(5, 1.0, "1970-01-01"), (86_400_000, 5.0, "1970-01-02")]


def test_domain_counts_nulls_as_broken(spark):
    bad = spark.createDataFrame([(1, None, 2, "view", 1.0, None), (1, 1, 2, None, 1.0, None), (1, 1, 2, "view", None, None), (1, 1, 2, "view", 1.0, None)], EVENTS)
    assert ingest.domain_counts(bad).first().asDict() == {"rows": 4, "null_ids": 1, "unknown_types": 1, "bad_weights": 1, "invalid_rows": 3}
    with pytest.raises(ValueError):
        ingest.require_domain(bad)
    ingest.require_domain(ingest.valid(bad))


def test_profile(spark):
    raw = spark.createDataFrame([("1433221332117", "1", "view", "10", ""), ("1433224214164", "1", "addtocart", "10", ""), ("1433225214164", "2", "transaction", "11", "99"), ("x", "2", "view", "11", ""), ("1433225214165", "2", "swipe", "11", "3")], "timestamp string, visitorid string, event string, itemid string, transactionid string")
    r = profile.profile(raw).first()
    assert (r.rows_read, r.view_count, r.addtocart_count, r.transaction_count, r.unique_visitors, r.unique_items) == (5, 1, 1, 1, 2, 2)
    assert (r.invalid_numeric_field, r.invalid_event, r.transaction_missing_id, r.non_transaction_has_id, r.transactions_with_id) == (1, 1, 0, 1, 2)


def test_split_boundary_belongs_to_the_later_part(spark):
    e = events(spark, [(t, 1, 1, "view") for t in (0, 69, 70, 84, 85, 99)])
    assert rows(profile.assign_split(e), "timestamp", "split") == [(0, "train"), (69, "train"), (70, "validation"), (84, "validation"), (85, "test"), (99, "test")]
    report = {r.split: (r.rows, r.fraction) for r in profile.split_report(profile.assign_split(e)).collect()}
    assert report["train"] == (2, 0.33333333)
    with pytest.raises(ValueError):
        profile.check_ratios(0.9, 0.2)


def test_user_features_and_recent_order(spark):
    e = events(spark, [(0, 1, 5, "view"), (86_400_000, 1, 6, "transaction"), (86_400_000, 1, 7, "view"), (1, 2, 5, "addtocart")])
    r = {x.user_id: x for x in features.user_features(e, 86_400_000, 2).collect()}
    assert (r[1].event_count, r[1].unique_item_count, r[1].weighted_event_sum, r[1].recency_days) == (3, 3, 7.0, 0)
    assert [x.item_id for x in r[1].recent_items] == [7, 6] and r[2].recency_days == 1


def test_compaction_equals_full(spark):
    e = events(spark, [(t, t % 3, t % 5, ("view", "addtocart", "transaction")[t % 3]) for t in range(60)])
    old, new = e.filter("timestamp < 33"), e.filter("timestamp >= 33")
    pairs = features.compact_interactions([features.interaction_features(x, 59) for x in (old, new)], 59)
    assert rows(pairs, "*") == rows(features.interaction_features(e, 59), "*")
    compact, full = features.compact_users([features.user_features(x, 59) for x in (old, new)], pairs, 59), features.user_features(e, 59)
    for key in ("event_count", "unique_item_count", "weighted_event_sum", "recent_items"):
        assert rows(compact, "user_id", key) == rows(full, "user_id", key)
    assert rows(features.compact_items([features.item_features(x, 59) for x in (old, new)], pairs, 59), "item_id", "unique_user_count", "event_count") == rows(features.item_features(e, 59), "item_id", "unique_user_count", "event_count")


def test_quality(spark):
    t = spark.createDataFrame([(1, 0), (1, 0), (None, -1)], "user_id long, recency_days int")
    assert quality.check_table(t, "user", ["user_id"], 3).first().asDict() == {"entity": "user", "rows": 3, "null_key_rows": 1, "repeated_keys": 1, "negative_recency_rows": 1, "passed": False}


def test_cosine_neighbours(spark):
    e = history.with_graph(events(spark, [(1, 1, 10, "view"), (2, 1, 20, "view"), (1, 2, 10, "view"), (2, 2, 20, "view"), (1, 3, 10, "view"), (2, 3, 30, "view")]))
    h = history.capped(history.fold(e))
    assert graph.pairs(h).agg(F.sum("n")).first()[0] == 3
    best = graph.neighbors(h).filter("item_id = 10 AND rank = 1").first()
    assert best.other == 20 and best.similarity == pytest.approx(2 / math.sqrt(3 * 2))


def test_history_cap_and_order(spark):
    e = history.with_graph(events(spark, [(5, 1, 3, "view"), (5, 1, 2, "view"), (1, 1, 9, "view"), (7, 1, 9, "view")]))
    assert rows(history.capped(history.fold(e), 2), "position", "item_id", "weight") == [(0, 9, 2.0), (1, 2, 1.0)]


def test_transitions_keep_a_gap_of_exactly_thirty_minutes(spark):
    m = 60_000
    e = history.with_graph(events(spark, [(0, 1, 1, "view"), (30 * m, 1, 2, "view"), (60 * m + 1, 1, 3, "view"), (60 * m + 2, 1, 3, "view")]))
    assert rows(graph.transitions(e), "item_id", "other", "transition_score") == [(1, 2, 1.0)]


def test_item_categories_take_the_smallest_of_one_instant(spark):
    log = spark.createDataFrame([(1, 7, "c", "9"), (2, 7, "c", "5"), (2, 7, "c", "4"), (2, 7, "c", "x"), (9, 7, "c", "1"), (2, 7, "d", "1")], "timestamp long, itemid long, property string, value string")
    assert rows(graph.item_categories(log, 5, "c"), "*") == [(7, 4, 2)]


def small_graph(spark):
    return candidates.Graph(
        neighbors=spark.createDataFrame([(0, 10, 20, 0.8, 1), (0, 10, 30, 0.4, 2)], "g int, item_id long, other long, similarity double, rank int"),
        transitions=spark.createDataFrame([], "g int, item_id long, other long, transition_score double, rank int"),
        category_lists=spark.createDataFrame([(0, 1, 20, 1), (0, 2, 30, 1)], "g int, category_id long, item_id long, category_rank int"),
        categories=spark.createDataFrame([(20, 1), (30, 2), (40, 1)], "item_id long, category_id long"),
        popularity=spark.createDataFrame([(0, 10, 100.0), (0, 40, 50.0), (0, 20, 2.0), (0, 30, 1.0)], "g int, item_id long, score double"),
        top=spark.createDataFrame([(0, [10, 40, 20, 30], [100.0, 50.0, 2.0, 1.0])], "g int, items array<long>, scores array<double>"),
    )


def small_context(spark):
    h = spark.createDataFrame([(0, 1, 10, 1.0, 1, 0)], HISTORY)
    return spark.createDataFrame([(0, 1, 1000)], "g int, ctx long, at long"), h, h.select("g", "ctx", "item_id")


def test_backfill_and_features(spark):
    c, h, seen = small_context(spark)
    g = small_graph(spark)
    scored = candidates.plain_scores(c, h, seen, g)
    assert rows(candidates.backfilled(c, scored, seen, g, 3), "rank", "item_id", "tier") == [(1, 20, 0), (2, 30, 0), (3, 40, 1)]
    base = {r.item_id: r for r in candidates.base_features(c, h, seen, g, 3).collect()}
    assert base[20].score_share == 1 and base[30].score_share == pytest.approx(0.5) and base[40].reciprocal_rank == pytest.approx(1 / 3)
    assert base[40].log_popularity == pytest.approx(math.log1p(50) / math.log1p(100)) and base[20].source_share == 1 and 10 not in base
    pool = {r.item_id: r for r in candidates.enriched_pool(c, h, seen, g, 3).collect()}
    assert set(pool) == {20, 30, 40} and pool[20].from_item_cooccurrence == 1.0 and max(r.rrf_share for r in pool.values()) == 1.0


def test_fusion(spark):
    ranked = spark.createDataFrame([(0, 1, i, s, r) for s, items in (("item", [1, 2, 3]), ("session", [2, 4, 1])) for r, i in enumerate(items, 1)], "g int, ctx long, item_id long, source string, rank int")
    fused = candidates.fuse(ranked, 3, {"item": 1.0, "session": 2.0}, 1)
    assert rows(fused, "rank", "item_id")[0] == (1, 2)
    assert dict(rows(candidates.contribution(fused), "source", "fused_items"))["session"] == 3


def test_popular_source_skips_seen(spark):
    c, _, seen = small_context(spark)
    assert rows(candidates.popular_source(c, seen, small_graph(spark), 2), "rank", "item_id") == [(1, 40), (2, 20)]


def test_popular_source_by_ranks(spark):
    """Arrays and ranks give the same lists, for contexts that have seen anything from nothing to everything."""
    chance = random.Random(3)
    popular = spark.createDataFrame([(g, i, float(chance.randrange(5))) for g in (0, 1) for i in range(60)], "g int, item_id long, score double")
    some = {(g, c): chance.sample(range(70), 5 * c if c < 12 else 70) for g in (0, 1) for c in range(13)}
    some[0, 13] = list(range(30))
    contexts = spark.createDataFrame([(*k, 9) for k in some], "g int, ctx long, at long")
    seen = spark.createDataFrame([(*k, i) for k, items in some.items() for i in items + items[:2]], "g int, ctx long, item_id long")
    top, ranks = history.top_items(popular, 100), history.ranked(popular)
    assert ranks.filter("g = 1").agg({"rank": "max"}).first()[0] == 60
    parts = {k: None for k in ("neighbors", "transitions", "category_lists", "categories", "popularity")}
    names = ("g", "ctx", "rank", "item_id")
    lists = rows(candidates.popular_source(contexts, seen, candidates.Graph(**parts, top=top), 7), *names)
    assert lists and len({x[:2] for x in lists}) < len(some)
    for listed in (0, 20, 1000):
        assert rows(candidates.popular_source(contexts, seen, candidates.Graph(**parts, top=top, ranks=ranks), 7, listed), *names) == lists


def test_result_cache(spark):
    lists = spark.createDataFrame([(1, 20, 2), (1, 10, 1), (2, 30, 1)], "user_id long, item_id long, rank int")
    kept = serving.cached_results(lists, "v1", "hybrid", None, 10, 1_000)
    assert {r.key for r in kept.collect()} == {serving.result_key("v1", "hybrid", None, u, 10) for u in (1, 2)}
    asked = spark.createDataFrame([(1,), (1,), (3,)], "user_id long")
    look = lambda *x: dict(rows(serving.look_up(asked, kept, *x), "user_id", "value"))
    assert look("v1", "hybrid", None, 10, 2_000) == {1: '[{"rank":1,"item_id":10},{"rank":2,"item_id":20}]', 3: None}
    assert look("v1", "hybrid", None, 10, 301_000) == look("v2", "hybrid", None, 10, 2_000) == look("v1", "hybrid", None, 5, 2_000) == {1: None, 3: None}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "ctx long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 20), (1, 30)], "ctx long, item_id long")
    m = metrics.ranking_metrics(ranked, truth, [3]).first()
    assert (m.precision, m.recall, m.hit_rate) == (0.66666667, 1.0, 1.0)
    assert m.ndcg == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)), abs=1e-7)
    c = metrics.candidate_metrics(ranked, spark.createDataFrame([(1, 20), (1, 99)], "ctx long, item_id long"), [3]).first()
    assert (c.recall, c.coverage, c.hits) == (0.5, 1.0, 1.0)


def test_group_metrics_and_losses(spark):
    e = spark.createDataFrame([(1, 5, 1, 0.9, 1.0), (1, 6, 0, 0.1, 0.5)], "example_id long, candidate_item_id long, label int, rrf_share double, reciprocal_rank double").withColumn("retrieved_positive", F.col("label"))
    assert metrics.group_metrics(e, [F.desc("rrf_share")], [3]).first().ndcg == 1.0
    assert metrics.group_metrics(e, [F.asc("rrf_share")], [3]).first().ndcg < 1.0
    pairs = examples.pair_rows(e)
    good = rankers.pair_loss(pairs, rankers.retrieval_prior("p_"), rankers.retrieval_prior("n_")).first().loss
    bad = rankers.pair_loss(pairs, rankers.retrieval_prior("n_"), rankers.retrieval_prior("p_")).first().loss
    assert good < bad and rankers.list_loss(e, rankers.retrieval_prior()).first().loss < math.log(2)


def test_rolling_history_is_strictly_earlier(spark):
    e = events(spark, [(0, 1, 1, "view"), (10, 1, 2, "view"), (80, 1, 3, "addtocart"), (90, 1, 3, "transaction"), (95, 2, 9, "transaction"), (99, 1, 1, "transaction")])
    seq = windows.known(windows.sequenced(e))
    found = windows.number(windows.targets(seq, spark.createDataFrame([(0, 70, 100)], "g int, start long, end long")))
    assert rows(found, "ctx", "user_id", "item_id") == [(1, 1, 3)]
    assert rows(windows.point_in_time(seq, found), "item_id", "weight") == [(1, 1.0), (2, 1.0)]


def test_point_in_time_equals_all_pairs(spark):
    """Blocks and runs against every earlier event, on long and short users, with ties of time and repeats."""
    draw = random.Random(7)
    made = [(draw.randrange(n // 2 + 1), user, draw.randrange(kinds), draw.choice(["view", "addtocart", "transaction"])) for user, n, kinds in ((1, 150, 40), (2, 90, 4), (3, 3, 5), (4, 1, 1)) for _ in range(n)]
    met = stage(windows.known(windows.sequenced(events(spark, made))), "met")
    found = met.select(F.lit(0).alias("g"), (F.col("user_id") * 1000 + F.col("seq")).alias("ctx"), "user_id", "seq")
    pairs = found.withColumnRenamed("seq", "until").join(met, "user_id").filter("seq < until")
    folded = pairs.groupBy("g", "ctx", "user_id", "item_id").agg(F.sum("event_weight").alias("weight"), F.max("timestamp").alias("timestamp"))
    names = "ctx", "position", "item_id", "weight", "timestamp"
    for most, block in ((3, 4), (5, 1), (50, 64)):
        out = history.capped(windows.point_in_time(met, found, most, block), most, "ctx")
        assert rows(out, *names) == rows(history.capped(folded, most, "ctx"), *names)
    until = found.withColumnRenamed("seq", "until").join(met.select("user_id", F.col("seq").alias("until"), "n_seen"), ["user_id", "until"])
    seen = candidates.Before(met.filter("seq = first_seq").select("user_id", "item_id", "first_seq"), until)
    assert rows(seen.rows(), "ctx", "item_id") == rows(folded, "ctx", "item_id")
    some = spark.createDataFrame([(0, x) for x in (0, 2, 3)], "g int, item_id long")
    every = found.select("g", "ctx", "user_id").crossJoin(some.select("item_id"))
    listed = folded.select("g", "ctx", "item_id")
    assert rows(seen.rows(some), "ctx", "item_id") == rows(folded.filter("item_id IN (0, 2, 3)"), "ctx", "item_id")
    assert rows(candidates.unseen(every, seen), "ctx", "item_id") == rows(candidates.unseen(every, listed), "ctx", "item_id")
    zero = lambda sizes: rows(sizes, "ctx", "n_seen")
    assert zero(candidates.context_sizes(found, listed, seen)) == zero(candidates.context_sizes(found, listed, listed))


def test_item_index_is_dense(spark):
    items = spark.createDataFrame([(x,) for x in (30, 10, 20, 10, None)], "item_id long")
    assert rows(examples.item_index(items), "*") == [(10, 1), (20, 2), (30, 3)]


def test_serving(spark):
    recent = "user_id long, recent_items array<struct<timestamp: long, item_id: long, event_weight: double>>"
    users = spark.createDataFrame([(7, [(3, 1, 1.0), (2, 2, 1.0), (1, 1, 5.0)])], recent)
    items = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, 8.0), (4, 7.0)], "item_id long, weighted_popularity double")
    none = spark.createDataFrame([], "g int, item_id long, other long, similarity double, rank int")
    steps = none.withColumnRenamed("similarity", "transition_score")
    assert rows(serving.online_history(users), "position", "item_id", "event_weight") == [(0, 1, 1.0), (1, 2, 1.0)]
    out = serving.recommend(users, items, none, steps, count=2)
    assert rows(out.filter("rank <= 2"), "rank", "item_id") == [(1, 3), (2, 4)]
    strangers = spark.createDataFrame([(99,)], "user_id long")
    assert rows(serving.recommend(users, items, none, steps, strangers), "rank", "item_id") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    scored = serving.rerank(out, F.col("item_id").cast("double"), live=True)
    assert rows(scored, "served_rank", "item_id") == [(1, 4), (2, 3)]


def test_latency_and_interval(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "latency_ms double")
    s = metrics.latency_summary(v, F.lit(0.5)).first()
    assert (s.requests, s.p50_ms, s.throughput) == (5, 3.0, 10.0)
    ci = metrics.confidence_interval(spark.createDataFrame([(x,) for x in (10.0, 11.0, 9.0, 10.5, 9.5)], "v double"), "v").first()
    assert ci.low < 10 < ci.high


def test_rate_limit_ignores_refused(spark):
    r = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 60_000, 4), ("a", 60_001, 5)], "k string, ms long, n int")
    assert rows(traffic.admit(r, "k", "ms", "n", 2), "n", "admitted") == [(1, True), (2, True), (3, False), (4, True), (5, True)]


def test_rate_limit_knows_null_as_a_key(spark):
    r = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (7, 1, 3), (None, 60_000, 4)], "k long, ms long, n int")
    assert rows(traffic.admit(r, "k", "ms", "n", 1), "n", "admitted") == [(1, True), (2, False), (3, True), (4, True)]


def test_training_by_epochs_ablation_and_saved_rankers(spark, tmp_path):
    made = []
    for e in range(40):  # the prior ranks the positive second; one feature tells it apart
        for i, (label, rrf, flag) in enumerate([(0, 1.0, 0.0), (1, 0.9, 1.0), (0, 0.1, float(e % 2))]):
            f = dict.fromkeys(candidates.ENRICHED, 0.0) | {"rrf_share": rrf, "reciprocal_rank": 1 / (i + 1), "max_similarity": flag}
            made.append((e, i, label, label, *f.values()))
    table = spark.createDataFrame(made, "example_id long, candidate_item_id long, label int, retrieved_positive int, " + ", ".join(f"{x} double" for x in candidates.ENRICHED))
    pairs = examples.pair_rows(table)
    name, all_of = rankers.ablate(pairs, table, {"blind": ("log_popularity", "category_share"), "seeing": ("max_similarity",)}, epochs=3)
    best = all_of["seeing"]
    assert name == "seeing" and best.best_epoch >= 1 and best.values[best.best_epoch] == 1.0 > best.values[0] and best.weights["max_similarity"] > 0
    assert all_of["blind"].best_epoch == 0 and all_of["blind"].weights == {}
    path = f"file://{tmp_path}/rankers/best.json"
    rankers.save(spark, path, best)
    assert rankers.load(spark, path) == best
    with pytest.raises(LookupError):
        rankers.load(spark, f"file://{tmp_path}/none.json")
    assert rankers.ABLATIONS["without_source_flags"] == candidates.ENRICHED[:9] and len(rankers.ABLATIONS["without_category"]) == 12


def test_vectors_and_types_and_keys(spark):
    one = spark.range(1)
    vector = lambda *x: F.array(*map(F.lit, x))
    r = one.select(vectors.pad(vector(5, 6, 7), 2).alias("cut"), vectors.pad(vector(5), 3).alias("padded"), vectors.mean_pool(F.array(vector(1.0, 2.0), vector(3.0, 6.0)), 2).alias("mean"),
                   vectors.mean_pool(F.array().cast("array<array<double>>"), 2).alias("none"), vectors.interaction_input(vector(1.0, 2.0), vector(3.0, 1.0), vector(9.0)).alias("all")).first()
    assert (r["cut"], r.padded, r["mean"], r.none, r["all"]) == ([5, 6], [5, 0, 0], [2.0, 4.0], [0.0, 0.0], [1.0, 2.0, 3.0, 1.0, 3.0, 2.0, 2.0, 1.0, 9.0])
    assert profile.require_known_types(events(spark, [(1, 1, 1, "view")])).count() == 1
    for bad in ("swipe", None):
        with pytest.raises(Exception, match="unknown event type"):
            profile.require_known_types(events(spark, [(1, 1, 1, bad)])).collect()
    assert serving.result_key("v", "hybrid", None, 7, 10) == "v:hybrid:none:7:10"


def test_gate_and_stop():
    assert rankers.promote(0.2, 0.22, 1) and not rankers.promote(0.2, 0.2004, 1) and not rankers.promote(0.2, 0.3, 0)
    assert rankers.early_stop([0.1, 0.2, 0.2, 0.2, 0.2, 0.9]) == 1
    assert rankers.choose({"a": 1.0, "b": 1.0}) == "a"


def test_challenger_ranks_by_the_score_it_shows(spark, monkeypatch):
    from marlspar.plans import catalogue

    near = spark.createDataFrame([(1, 7, 1, 0.5, 0.0, 0.0), (1, 3, 2, 0.5, 0.0, 0.0000004), (1, 2, 3, 0.5, 0.0, 0.0)], "user_id long, item_id long, rank int, rrf_share double, reciprocal_rank double, popularity_share double")
    monkeypatch.setattr(catalogue, "_served", lambda *a: ())
    monkeypatch.setattr(catalogue.serving, "online_features", lambda *a: near)
    out = catalogue.serve_challenger(spark, "")
    assert [(r.item_id, r.challenger_score) for r in out.orderBy("served_rank").collect()] == [(2, 1.0), (3, 1.0), (7, 1.0)]


def test_what_is_staged_on_the_way_is_removed(spark):
    from marlspar.storage import passing, shared_dir, stage

    with passing(spark):
        first = stage(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "on_the_way")
        last = stage(first.filter("k > 0"), "wanted", keep=True)
    assert last.count() == 2
    found = [p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()]
    assert any(n.startswith("marlspar-wanted-") for n in found) and not any(n.startswith("marlspar-on_the_way-") for n in found)


def test_neighbours_are_summed_where_they_are_found(spark):
    h = spark.createDataFrame([(0, 1, 10, 1.0, 5, 0), (0, 1, 11, 1.0, 4, 1)], "g int, ctx long, item_id long, weight double, timestamp long, position int")
    edges = spark.createDataFrame([(0, 10, 20, 0.5), (0, 11, 20, 0.25), (0, 10, 11, 1.0)], "g int, item_id long, other long, similarity double")
    out = candidates.followed(h, edges, "similarity", h.select("g", "ctx", "item_id"), F.sum("similarity").alias("score"), F.count("*").alias("n"))
    assert [tuple(r) for r in out.collect()] == [(0, 1, 20, 0.75, 2)]
    plan = candidates.followed(h, edges, "similarity", spark.createDataFrame([], "g int, ctx long, item_id long"), F.sum("similarity").alias("score"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" in plan and "source" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_neighbours_in_turns(spark):
    rng = random.Random(5)
    held = {(u, rng.randrange(30)) for u in range(40) for _ in range(8)}
    h = spark.createDataFrame([(0, u, i) for u, i in held], "g int, user_id long, item_id long")
    users = {i: {u for u, x in held if x == i} for _, i in held}
    expected = []
    for i in users:
        scored = sorted((-len(users[i] & users[o]) / math.sqrt(len(users[i]) * len(users[o])), o) for o in users if o != i and users[i] & users[o])
        expected += [(i, o, round(-s, 8), r) for r, (s, o) in enumerate(scored[:5], 1)]
    for entries in (1 << 27, 500):
        out = graph.neighbors(h, 5, entries=entries).withColumn("similarity", F.round("similarity", 8))
        assert rows(out, "item_id", "other", "similarity", "rank") == sorted(expected)


def test_training_stages_what_the_losses_read(spark, monkeypatch):
    from marlspar.plans import catalogue

    made = spark.createDataFrame([(1, "train", 1, "9 8", 1, 0.5, 1.0, 0.1), (2, "validation", 1, "9", 1, 0.5, 1.0, 0.1)], "example_id long, split string, label int, history string, retrieved_positive int, rrf_share double, reciprocal_rank double, max_similarity double")
    monkeypatch.setattr(catalogue, "rolling_examples", lambda *a: made.withColumn("candidate_item_id", F.lit(7)))
    out = catalogue._training(spark, "")
    assert tuple(out.columns) == catalogue._PRIOR and [r.example_id for r in out.collect()] == [1]


def test_folds_in_turns_shuffle_no_pool(spark):
    from marlspar.contracts import FOLDS
    from marlspar.storage import shared_dir

    rng = random.Random(11)
    e = events(spark, [(t, rng.randrange(40), rng.randrange(15), rng.choice(("view", "addtocart", "transaction"))) for t in range(1000)])
    categories = spark.createDataFrame([(i, i % 4) for i in range(12)], "item_id long, category_id long")
    window = windows.rolling(e, categories, FOLDS, 10)
    staged = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}
    one, before = examples.fold_examples(window, 10), staged()
    many = examples.fold_examples(window, 10, at_once=50)
    assert rows(many, *sorted(many.columns)) == rows(one, *sorted(one.columns)) and {r.fold for r in one.collect()} == {0, 1, 2, 3}
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
    left = {name.split("-")[1] for name in staged() - before}
    assert "pool" in left and not left & {"scores", "fused", "source", "first", "near", "contexts", "found"}


def plans_of(monkeypatch, *modules):
    """The plans of what modules stage from now on, by label, as they are planned there."""
    made = {}

    def staging(df, label, *a, **b):
        made.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label, *a, **b)

    for m in modules:
        monkeypatch.setattr(m, "stage", staging)
    return made


def test_small_files_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from marlspar.storage import measured

    ids = stage(spark.range(1000), "ids")
    joined = lambda right: ids.join(right, "id").withColumn("x", F.col("id"))._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with measured(spark), measured(spark):
        assert "Broadcast" not in joined(ids) and "Broadcast" in joined(F.broadcast(ids))
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == before  # what rows take is still used
    assert "Broadcast" in joined(ids) and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None


def rolling_window(spark, ratios=((0.7, 1.0),)):
    rng = random.Random(12)
    e = events(spark, [(t, rng.randrange(40), rng.randrange(15), rng.choice(("view", "addtocart", "transaction"))) for t in range(1000)])
    categories = stage(spark.createDataFrame([(i, i % 4) for i in range(3, 40)], "item_id long, category_id long"), "categories")
    return windows.rolling(e, categories, ratios, 10)


def broadcast_against(made):
    """Lines of joins that drop rows by a broadcast table: such tables hold a row a context, or more."""
    lines = [(label, x.strip()) for label, plans in made.items() for p in plans for x in p.splitlines() if "LeftAnti" in x]
    assert {"scores", "source"} <= {label for label, _ in lines}
    return [x for x in lines if "Broadcast" in x[1]]


def test_examples_broadcast_no_contexts(spark, monkeypatch):
    made = plans_of(monkeypatch, windows, candidates, examples)
    window = rolling_window(spark)
    out = examples.rolling_examples(window, 850, 10)
    assert broadcast_against(made) == []
    assert "Broadcast" not in made["until"][0] and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.select("example_id").distinct().count() == window.found.count() == out.filter("label = 1").count()


def test_folds_broadcast_no_contexts(spark, monkeypatch):
    from marlspar.contracts import FOLDS

    made = plans_of(monkeypatch, windows, candidates, examples)
    examples.fold_examples(rolling_window(spark, FOLDS), 10)
    assert broadcast_against(made) == []


def test_pairs_and_judged_groups_broadcast_no_examples(spark):
    from marlspar.plans import catalogue

    made = spark.createDataFrame([(1, 5, 1, 1, 0.5), (1, 6, 0, 0, 0.4), (1, 7, 0, 0, 0.3), (2, 5, 1, 0, 0.1), (2, 6, 0, 0, 0.2)], "example_id long, candidate_item_id long, label int, retrieved_positive int, rrf_share double")
    made = stage(made, "examples")
    pairs, judged = examples.pair_rows(made), catalogue._judged(made)
    assert rows(pairs, "example_id", "positive", "negative", "weight") == [(1, 5, 6, 1.0), (1, 5, 7, 1.0), (2, 5, 6, 0.25)] and {r.example_id for r in judged.collect()} == {1}
    for x in (pairs, judged):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
