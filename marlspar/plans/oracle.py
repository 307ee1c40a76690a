"""Each catalogue query in DuckDB's SQL, written from the semantics and not from the Spark plans."""

from __future__ import annotations

import re

_M1 = """m1 AS (
  SELECT epoch_us(ts) // 1000 AS timestamp, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event_type,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 END AS DOUBLE) AS event_weight,
         CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS transaction_id
  FROM events
), ev AS (SELECT * FROM m1 WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND event_weight > 0)"""
_M2 = """ev AS (
  SELECT epoch_us(o_orderdate) // 1000 AS timestamp, o_custkey AS user_id, l_partkey AS item_id,
         CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'addtocart' WHEN 'R' THEN 'transaction' END AS event_type,
         CAST(CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 3 WHEN 'R' THEN 5 END AS DOUBLE) AS event_weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
_CATEGORIES = "categories AS (SELECT p_partkey AS item_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS category_id FROM part)"
_DAY = "CAST(epoch_ms({}) AS DATE)"


def _days(a: str, b: str) -> str:
    return f"CAST({_DAY.format(a)} - {_DAY.format(b)} AS INTEGER)"


def _counts(prefix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (event_type = '{t}') AS {n}" for t, n in (("view", "view_count"), ("addtocart", "cart_count"), ("transaction", "transaction_count")))


_ASOF = "(SELECT max(timestamp) FROM ev)"
_SPLIT = """bounds AS (
  SELECT lo AS minimum, hi AS maximum, lo + CAST(floor((hi - lo + 1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS train_end,
         lo + CAST(floor((hi - lo + 1) * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT) AS validation_end
  FROM (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM ev)
), split AS (
  SELECT ev.*, CASE WHEN timestamp < train_end THEN 'train' WHEN timestamp < validation_end THEN 'validation' ELSE 'test' END AS split FROM ev, bounds
), past AS (SELECT 0 AS g, timestamp, user_id, item_id, event_type, event_weight FROM split WHERE split <> 'test'),
target AS (SELECT timestamp, user_id, item_id, event_type FROM split WHERE split = 'test'),
useen AS (SELECT user_id, item_id, sum(event_weight) AS weight, max(timestamp) AS timestamp FROM past GROUP BY ALL),
relevant AS (
  SELECT t.*, EXISTS (SELECT 1 FROM useen s WHERE s.user_id = t.user_id) AS warm, EXISTS (SELECT 1 FROM useen s WHERE s.user_id = t.user_id AND s.item_id = t.item_id) AS repeated
  FROM target t WHERE event_type IN ('addtocart', 'transaction')
), truth_all AS (SELECT DISTINCT user_id AS ctx, item_id FROM relevant WHERE NOT repeated),
truth AS (SELECT DISTINCT user_id AS ctx, item_id FROM relevant WHERE NOT repeated AND warm),
first_target AS (SELECT t.user_id, min(t.timestamp) AS target_timestamp FROM target t JOIN truth ON t.user_id = ctx AND t.item_id = truth.item_id GROUP BY t.user_id),
early AS (SELECT * FROM past)"""
_BACKTEST = """ctx AS (SELECT 0 AS g, user_id AS ctx, target_timestamp AS at_ms FROM first_target),
cfold AS (SELECT 0 AS g, user_id AS ctx, item_id, weight, timestamp FROM useen WHERE user_id IN (SELECT ctx FROM truth))"""


def _rolling(ratios) -> str:
    windows = " UNION ALL ".join(
        f"SELECT {g} AS g, lo + CAST(floor((hi - lo + 1) * CAST({a} AS DOUBLE)) AS BIGINT) AS g_start, " + ("hi + 1" if b == 1 else f"lo + CAST(floor((hi - lo + 1) * CAST({b} AS DOUBLE)) AS BIGINT)") + " AS g_end FROM span"
        for g, (a, b) in enumerate(ratios)
    )
    return f"""span AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM ev),
windows AS ({windows}),
early AS (SELECT g, timestamp, user_id, item_id, event_type, event_weight FROM ev JOIN windows ON timestamp < g_start),
seqd AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id, event_type) AS seq FROM ev),
flagged AS (SELECT *, min(seq) OVER (PARTITION BY user_id, item_id) AS first_seq FROM seqd),
usable AS (SELECT * FROM flagged WHERE event_type IN ('addtocart', 'transaction') AND seq = first_seq AND seq > 1),
found AS (
  SELECT g, user_id, item_id, timestamp, seq, row_number() OVER (ORDER BY g, user_id, seq) AS ctx
  FROM usable JOIN windows ON timestamp >= g_start AND timestamp < g_end
), ctx AS (SELECT g, ctx, timestamp AS at_ms FROM found),
cfold AS (SELECT f.g, f.ctx, s.item_id, sum(s.event_weight) AS weight, max(s.timestamp) AS timestamp FROM found f JOIN seqd s ON s.user_id = f.user_id AND s.seq < f.seq GROUP BY ALL)"""


_GRAPH = """hist AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, ctx ORDER BY timestamp DESC, item_id) - 1 AS position FROM cfold) WHERE position < 50
), gfold AS (SELECT g, user_id, item_id, sum(event_weight) AS weight, max(timestamp) AS timestamp FROM early GROUP BY ALL),
ghist AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, user_id ORDER BY timestamp DESC, item_id) - 1 AS position FROM gfold) WHERE position < 50
), degree AS (SELECT g, item_id, count(*) AS users FROM ghist GROUP BY ALL),
both_ways AS (SELECT a.g, a.item_id, b.item_id AS other, count(*) AS n FROM ghist a JOIN ghist b ON a.g = b.g AND a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL),
neighbors AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY g, item_id ORDER BY similarity DESC, other) AS rank
    FROM (SELECT p.g, p.item_id, p.other, p.n / sqrt(CAST(a.users * b.users AS DOUBLE)) AS similarity FROM both_ways p JOIN degree a ON a.g = p.g AND a.item_id = p.item_id JOIN degree b ON b.g = p.g AND b.item_id = p.other)
  ) WHERE rank <= 100
), recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, user_id ORDER BY timestamp DESC, item_id DESC) AS back FROM early) WHERE back <= 200),
led AS (SELECT g, item_id, timestamp, lead(item_id) OVER w AS other, lead(timestamp) OVER w AS next_time FROM recent WINDOW w AS (PARTITION BY g, user_id ORDER BY back DESC)),
step_counts AS (SELECT g, item_id, other, count(*) AS n FROM led WHERE next_time - timestamp <= 1800000 AND item_id <> other GROUP BY ALL),
transitions AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY g, item_id ORDER BY transition_score DESC, other) AS rank
    FROM (SELECT g, item_id, other, n / sqrt(CAST(sum(n) OVER (PARTITION BY g, item_id) AS DOUBLE) * CAST(sum(n) OVER (PARTITION BY g, other) AS DOUBLE)) AS transition_score FROM step_counts)
  ) WHERE rank <= 100
), popularity AS (SELECT g, item_id, sum(event_weight) AS score FROM early GROUP BY ALL),
popular_order AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, item_id) AS place FROM popularity),
top_popular AS (SELECT g, max(score) AS top_popularity FROM popularity GROUP BY g),
category_lists AS (
  SELECT * FROM (SELECT g, category_id, item_id, row_number() OVER (PARTITION BY g, category_id ORDER BY score DESC, item_id) AS category_rank FROM popularity JOIN categories USING (item_id)) WHERE category_rank <= 100
)"""
_SOURCES = """expanded AS (
  SELECT h.g, h.ctx, n.other AS item_id, n.similarity, h.weight, h.timestamp, h.position FROM hist h JOIN neighbors n ON n.g = h.g AND n.item_id = h.item_id
  WHERE NOT EXISTS (SELECT 1 FROM cfold s WHERE s.g = h.g AND s.ctx = h.ctx AND s.item_id = n.other)
), walked AS (
  SELECT h.g, h.ctx, n.other AS item_id, n.transition_score AS similarity, h.weight, h.position FROM hist h JOIN transitions n ON n.g = h.g AND n.item_id = h.item_id
  WHERE h.position < 10 AND NOT EXISTS (SELECT 1 FROM cfold s WHERE s.g = h.g AND s.ctx = h.ctx AND s.item_id = n.other)
), item_scores AS (SELECT g, ctx, item_id, round(sum((1 + ln(1 + weight)) / (position + 1) * similarity), 8) AS score FROM expanded GROUP BY ALL),
session_scores AS (SELECT g, ctx, item_id, round(sum((1 + ln(1 + weight)) / (position + 1) * similarity), 8) AS score FROM walked GROUP BY ALL),
latest_categories AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, ctx ORDER BY first_at) AS nth FROM (SELECT g, ctx, category_id, min(position) AS first_at FROM hist JOIN categories USING (item_id) GROUP BY ALL)) WHERE nth <= 5
), ranked AS (
  SELECT g, ctx, item_id, 'item_cooccurrence' AS source, row_number() OVER (PARTITION BY g, ctx ORDER BY score DESC, item_id) AS rank FROM item_scores
  UNION ALL SELECT g, ctx, item_id, 'session_transition', row_number() OVER (PARTITION BY g, ctx ORDER BY score DESC, item_id) FROM session_scores
  UNION ALL SELECT l.g, l.ctx, c.item_id, 'category_popularity', row_number() OVER (PARTITION BY l.g, l.ctx ORDER BY nth, category_rank)
    FROM latest_categories l JOIN category_lists c ON c.g = l.g AND c.category_id = l.category_id
    WHERE NOT EXISTS (SELECT 1 FROM cfold s WHERE s.g = l.g AND s.ctx = l.ctx AND s.item_id = c.item_id)
  UNION ALL SELECT c.g, c.ctx, p.item_id, 'global_popularity', row_number() OVER (PARTITION BY c.g, c.ctx ORDER BY place)
    FROM ctx c JOIN popular_order p ON p.g = c.g WHERE NOT EXISTS (SELECT 1 FROM cfold s WHERE s.g = c.g AND s.ctx = c.ctx AND s.item_id = p.item_id)
), sources AS (SELECT * FROM ranked WHERE rank <= 100),
fused AS (
  SELECT *, max(rrf) OVER (PARTITION BY g, ctx) AS top_rrf, row_number() OVER (PARTITION BY g, ctx ORDER BY rrf DESC, item_id) AS rank
  FROM (
    SELECT g, ctx, item_id, round(sum(CASE source WHEN 'item_cooccurrence' THEN 1.0::DOUBLE WHEN 'session_transition' THEN 1.5 WHEN 'category_popularity' THEN 0.75 ELSE 0.25 END / (60 + rank)), 8) AS rrf,
           max(CAST(source = 'item_cooccurrence' AS INTEGER)) AS from_item_cooccurrence, max(CAST(source = 'session_transition' AS INTEGER)) AS from_session_transition,
           max(CAST(source = 'category_popularity' AS INTEGER)) AS from_category_popularity, max(CAST(source = 'global_popularity' AS INTEGER)) AS from_global_popularity
    FROM sources GROUP BY ALL
  )
), hybrid AS (SELECT * FROM fused WHERE rank <= 100)"""
_POOL = """plain AS (
  SELECT e.g, e.ctx, e.item_id, round(sum((1 + ln(1 + weight)) * similarity), 8) AS score,
         round(sum((1 + ln(1 + weight)) * similarity * exp(-(greatest(at_ms - timestamp, 0) / 86400000.0::DOUBLE) / 30.0::DOUBLE)), 8) AS recent_score, count(*) AS n_sources, max(similarity) AS max_similarity
  FROM expanded e JOIN ctx c ON c.g = e.g AND c.ctx = e.ctx GROUP BY ALL
), pool AS (
  SELECT * FROM (
    SELECT g, ctx, item_id, tier, row_number() OVER (PARTITION BY g, ctx ORDER BY tier, nth) AS rank FROM (
      SELECT g, ctx, item_id, 0 AS tier, row_number() OVER (PARTITION BY g, ctx ORDER BY score DESC, item_id) AS nth FROM plain
      UNION ALL SELECT c.g, c.ctx, p.item_id, 1, place FROM ctx c JOIN popular_order p ON p.g = c.g
        WHERE NOT EXISTS (SELECT 1 FROM cfold s WHERE s.g = c.g AND s.ctx = c.ctx AND s.item_id = p.item_id) AND NOT EXISTS (SELECT 1 FROM plain s WHERE s.g = c.g AND s.ctx = c.ctx AND s.item_id = p.item_id)
    )
  ) WHERE rank <= 100
), sizes AS (SELECT c.g, c.ctx, (SELECT count(*) FROM hist h WHERE h.g = c.g AND h.ctx = c.ctx) AS n_history, (SELECT count(*) FROM cfold s WHERE s.g = c.g AND s.ctx = c.ctx) AS n_seen FROM ctx c),
category_shares AS (SELECT g, ctx, category_id, count(*) / sum(count(*)) OVER (PARTITION BY g, ctx) AS share FROM hist JOIN categories USING (item_id) GROUP BY g, ctx, category_id),
tops AS (SELECT g, ctx, max(score) AS top_score, max(recent_score) AS top_recent FROM plain GROUP BY ALL),
wanted AS (SELECT g, ctx, item_id FROM pool UNION SELECT g, ctx, item_id FROM hybrid {more}),
spare AS (
  SELECT w.g, w.ctx, w.item_id, ln(1 + coalesce(p.score, 0)) / ln(1 + t.top_popularity) AS log_popularity, ln(1 + CAST(s.n_seen AS DOUBLE)) / ln(51.0::DOUBLE) AS history_size, coalesce(cs.share, 0) AS category_share, s.n_history
  FROM wanted w JOIN sizes s ON s.g = w.g AND s.ctx = w.ctx JOIN top_popular t ON t.g = w.g LEFT JOIN popularity p ON p.g = w.g AND p.item_id = w.item_id
  LEFT JOIN categories c ON c.item_id = w.item_id LEFT JOIN category_shares cs ON cs.g = w.g AND cs.ctx = w.ctx AND cs.category_id = c.category_id
), base AS (
  SELECT p.g, p.ctx, p.item_id, p.rank, coalesce(f.score / t.top_score, 0) AS score_share, s.log_popularity, CAST(1 AS DOUBLE) / p.rank AS reciprocal_rank,
         coalesce(f.n_sources, 0) / CAST(greatest(s.n_history, 1) AS DOUBLE) AS source_share, s.history_size, coalesce(f.recent_score / t.top_recent, 0) AS recency_share, coalesce(f.max_similarity, 0) AS max_similarity, s.category_share
  FROM pool p JOIN spare s ON s.g = p.g AND s.ctx = p.ctx AND s.item_id = p.item_id LEFT JOIN plain f ON f.g = p.g AND f.ctx = p.ctx AND f.item_id = p.item_id LEFT JOIN tops t ON t.g = p.g AND t.ctx = p.ctx
)"""
BASE = ("score_share", "log_popularity", "reciprocal_rank", "source_share", "history_size", "recency_share", "max_similarity", "category_share")
FLAGS = ("from_item_cooccurrence", "from_session_transition", "from_category_popularity", "from_global_popularity")
ENRICHED = (*BASE, "rrf_share", *FLAGS)


def _enriched(zeros: bool = False) -> str:
    value = lambda x: f"CASE WHEN b.item_id IS NOT NULL THEN b.{x} ELSE " + (f"s.{x}" if x in ("log_popularity", "history_size", "category_share") and not zeros else "0") + f" END AS {x}"
    return f"""enriched AS (
  SELECT h.g, h.ctx, h.item_id, h.rank, {", ".join(map(value, BASE))}, h.rrf / h.top_rrf AS rrf_share, {", ".join(f"CAST(h.{x} AS DOUBLE) AS {x}" for x in FLAGS)}
  FROM hybrid h JOIN spare s ON s.g = h.g AND s.ctx = h.ctx AND s.item_id = h.item_id LEFT JOIN base b ON b.g = h.g AND b.ctx = h.ctx AND b.item_id = h.item_id
)"""


def _examples() -> str:
    rounded = ", ".join(f"round({x}, 8) AS {x}" for x in ENRICHED)
    zeros = ", ".join(f"s.{x}" if x in ("log_popularity", "history_size", "category_share") else f"0 AS {x}" for x in ENRICHED)
    return f"""marked AS (
  SELECT e.*, f.user_id, f.timestamp, f.item_id AS target, CAST(e.item_id = f.item_id AS INTEGER) AS label, max(CAST(e.item_id = f.item_id AS INTEGER)) OVER (PARTITION BY e.g, e.ctx) AS retrieved,
         CASE WHEN f.timestamp < (SELECT v FROM validation_start) THEN 'train' ELSE 'validation' END AS split
  FROM enriched e JOIN found f ON f.g = e.g AND f.ctx = e.ctx
), negatives AS (SELECT *, row_number() OVER (PARTITION BY g, ctx ORDER BY rank) AS nth FROM marked WHERE label = 0),
texts AS (SELECT g, ctx, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY position) AS history FROM hist GROUP BY ALL),
example_rows AS (
  SELECT g, ctx, split, timestamp, user_id, item_id, label, retrieved, {", ".join(ENRICHED)} FROM marked WHERE label = 1
  UNION ALL SELECT g, ctx, split, timestamp, user_id, item_id, label, retrieved, {", ".join(ENRICHED)} FROM negatives WHERE split = 'validation' OR nth <= 20
  UNION ALL SELECT f.g, f.ctx, CASE WHEN f.timestamp < (SELECT v FROM validation_start) THEN 'train' ELSE 'validation' END, f.timestamp, f.user_id, f.item_id, 1, 0, {zeros}
    FROM found f JOIN spare s ON s.g = f.g AND s.ctx = f.ctx AND s.item_id = f.item_id WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.g = f.g AND m.ctx = f.ctx AND m.retrieved = 1)
), examples AS (
  SELECT ctx AS example_id, split, timestamp, user_id, item_id AS candidate_item_id, label, CASE WHEN label = 1 THEN retrieved ELSE 0 END AS retrieved_positive, history, {rounded}
  FROM example_rows JOIN texts USING (g, ctx)
)"""


_ROLL = _rolling(((0.70, 1),))
_VALID = """validation_start AS (SELECT g_start + CAST(floor((hi - g_start + 1) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS v FROM windows, span)"""
_FEATURES = f"""uf AS (
  SELECT user_id, count(*) AS event_count, count(DISTINCT item_id) AS unique_item_count, {_counts()}, sum(event_weight) AS weighted_event_sum, max(timestamp) AS last_event_timestamp,
         {_days(_ASOF, "max(timestamp)")} AS recency_days
  FROM ev GROUP BY user_id
), itf AS (
  SELECT item_id, count(*) AS event_count, count(DISTINCT user_id) AS unique_user_count, {_counts()}, sum(event_weight) AS weighted_popularity, max(timestamp) AS last_event_timestamp,
         {_days(_ASOF, "max(timestamp)")} AS recency_days
  FROM ev GROUP BY item_id
), inf AS (
  SELECT user_id, item_id, count(*) AS interaction_count, sum(event_weight) AS affinity_score, max(event_weight) AS strongest_event_weight, max(timestamp) AS last_interaction_timestamp,
         {_days(_ASOF, "max(timestamp)")} AS recency_days
  FROM ev GROUP BY ALL
), recents AS (
  SELECT * FROM (SELECT user_id, timestamp, item_id, event_weight, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC, event_weight DESC) AS nth FROM ev) WHERE nth <= 50
)"""
_RECENT = "SELECT user_id, string_agg(timestamp || ':' || item_id || ':' || CAST(event_weight AS BIGINT), ',' ORDER BY nth) AS recent_items FROM recents GROUP BY user_id"
_SERVE = """ohist AS (
  SELECT user_id, item_id, event_weight, row_number() OVER (PARTITION BY user_id ORDER BY nth) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY nth) AS again FROM recents) WHERE again = 1
), scored AS (
  SELECT 'item' AS source, h.user_id, n.other AS item_id, round(sum((1 + ln(1 + event_weight)) / (position + 1) * similarity), 8) AS score, max(similarity) AS similarity
  FROM ohist h JOIN neighbors n ON n.item_id = h.item_id WHERE position < 50 AND NOT EXISTS (SELECT 1 FROM ohist s WHERE s.user_id = h.user_id AND s.item_id = n.other) GROUP BY ALL
  UNION ALL
  SELECT 'session', h.user_id, n.other, round(sum((1 + ln(1 + event_weight)) / (position + 1) * transition_score), 8), max(transition_score)
  FROM ohist h JOIN transitions n ON n.item_id = h.item_id WHERE position < 10 AND NOT EXISTS (SELECT 1 FROM ohist s WHERE s.user_id = h.user_id AND s.item_id = n.other) GROUP BY ALL
), popular AS (SELECT item_id, weighted_popularity, row_number() OVER (ORDER BY weighted_popularity DESC, item_id) AS rank FROM itf),
asked AS ({asked}),
lists AS (
  SELECT * FROM (SELECT source, user_id, item_id, row_number() OVER (PARTITION BY source, user_id ORDER BY score DESC, item_id) AS rank FROM scored WHERE user_id IN (SELECT user_id FROM asked)) WHERE rank <= 100
  UNION ALL SELECT 'popular', user_id, item_id, rank FROM asked a, popular WHERE rank <= greatest(100, 10 + (SELECT count(*) FROM ohist h WHERE h.user_id = a.user_id))
), rrf AS (
  SELECT user_id, item_id, round(sum(CASE source WHEN 'item' THEN 1.0::DOUBLE WHEN 'session' THEN 1.5 ELSE 0.25 END / (60 + rank)), 8) AS rrf,
         max(CAST(source = 'item' AS INTEGER)) AS in_item, max(CAST(source = 'session' AS INTEGER)) AS in_session, max(CAST(source = 'popular' AS INTEGER)) AS in_popular
  FROM lists GROUP BY ALL
), served AS (
  SELECT r.user_id, r.item_id, r.rrf, row_number() OVER (PARTITION BY r.user_id ORDER BY fused_rank) AS rank, coalesce(a.score, 0) AS item_score, coalesce(b.score, 0) AS session_score,
         greatest(coalesce(a.similarity, 0), coalesce(b.similarity, 0)) AS max_similarity, in_item, in_session, in_popular
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rrf DESC, item_id) AS fused_rank FROM rrf) r
  LEFT JOIN scored a ON a.source = 'item' AND a.user_id = r.user_id AND a.item_id = r.item_id LEFT JOIN scored b ON b.source = 'session' AND b.user_id = r.user_id AND b.item_id = r.item_id
  WHERE fused_rank <= 100 AND NOT EXISTS (SELECT 1 FROM ohist s WHERE s.user_id = r.user_id AND s.item_id = r.item_id)
), online AS (
  SELECT s.user_id, s.item_id, s.rank, round(item_score / coalesce((SELECT max(score) FROM scored x WHERE x.source = 'item' AND x.user_id = s.user_id), 1), 8) AS score_share,
         round(coalesce(weighted_popularity, 0) / coalesce(nullif(max(coalesce(weighted_popularity, 0)) OVER (PARTITION BY s.user_id), 0), 1), 8) AS popularity_share, round(CAST(1 AS DOUBLE) / s.rank, 8) AS reciprocal_rank,
         (in_item + in_session + in_popular) / 4.0::DOUBLE AS source_share, round(least((SELECT count(*) FROM ohist h WHERE h.user_id = s.user_id) / 50.0::DOUBLE, 1), 8) AS history_share,
         round(session_score / coalesce((SELECT max(score) FROM scored x WHERE x.source = 'session' AND x.user_id = s.user_id), 1), 8) AS session_share, round(max_similarity, 8) AS max_similarity, CAST(0 AS DOUBLE) AS category_share,
         round(rrf / coalesce(nullif(max(rrf) OVER (PARTITION BY s.user_id), 0), 1), 8) AS rrf_share, CAST(in_item AS DOUBLE) AS from_item, CAST(in_session AS DOUBLE) AS from_session, CAST(0 AS DOUBLE) AS from_category, CAST(in_popular AS DOUBLE) AS from_popular
  FROM served s LEFT JOIN itf USING (item_id)
)"""
_NO_CTX = "ctx AS (SELECT 0 AS g, user_id AS ctx, max(timestamp) AS at_ms FROM ev GROUP BY user_id), cfold AS (SELECT 0 AS g, user_id AS ctx, item_id, sum(event_weight) AS weight, max(timestamp) AS timestamp FROM ev GROUP BY ALL)"
_ALL = "early AS (SELECT 0 AS g, timestamp, user_id, item_id, event_type, event_weight FROM ev)"


def _metrics(ks, ranked: str, truth: str, name: str = "metrics") -> str:
    """precision, recall, hit rate and NDCG at each k."""
    return f"""{name}_k AS (SELECT unnest([{", ".join(map(str, ks))}]) AS k),
{name}_each AS (
  SELECT k, t.ctx, t.relevant, coalesce(h.hits, 0) AS hits, coalesce(h.dcg, 0) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(t.relevant, k) AS BIGINT) + 1) r(i)) AS ideal
  FROM {name}_k JOIN (SELECT ctx, count(*) AS relevant FROM {truth} GROUP BY ctx) t ON true
  LEFT JOIN (SELECT k, r.ctx, count(*) AS hits, sum(1 / log2(r.rank + 1)) AS dcg FROM {name}_k JOIN {ranked} r ON r.rank <= k JOIN {truth} t ON t.ctx = r.ctx AND t.item_id = r.item_id GROUP BY ALL) h USING (k, ctx)
), {name} AS (
  SELECT k, count(*) AS users, round(avg(hits / CAST(k AS DOUBLE)), 8) AS precision, round(avg(hits / CAST(relevant AS DOUBLE)), 8) AS recall, round(avg(CAST(hits > 0 AS DOUBLE)), 8) AS hit_rate, round(avg(dcg / ideal), 8) AS ndcg FROM {name}_each GROUP BY k
)"""


def _candidate_metrics(ks, ranked: str) -> str:
    return f"""SELECT k, count(*) AS users, round(avg(hits / CAST(relevant AS DOUBLE)), 8) AS recall, round(avg(CAST(hits > 0 AS DOUBLE)), 8) AS coverage, round(avg(hits), 8) AS hits
FROM (
  SELECT k, t.ctx, t.relevant, (SELECT count(*) FROM {ranked} r JOIN truth x ON x.ctx = r.ctx AND x.item_id = r.item_id WHERE r.ctx = t.ctx AND r.rank <= k) AS hits
  FROM (SELECT unnest([{", ".join(map(str, ks))}]) AS k) q, (SELECT ctx, count(*) AS relevant FROM truth GROUP BY ctx) t
) GROUP BY k"""


def _with(*parts: str, select: str) -> str:
    """Each part is computed once, however many others read it."""
    named = re.sub(r"\b(\w+) AS \((\s*SELECT)", r"\1 AS MATERIALIZED (\2", ",\n".join(parts))
    return "WITH " + named + "\n" + select


_BACK = (_M1, _CATEGORIES, _SPLIT, _BACKTEST, _GRAPH, _SOURCES)
_POOLED = (*_BACK, _POOL.replace("{more}", ""))
_ROLLED = (_M1, _CATEGORIES, _ROLL, _GRAPH, _SOURCES, _POOL.replace("{more}", "UNION SELECT g, ctx, item_id FROM found"), _enriched(), _VALID, _examples())
_POPULAR_RANK = "popular_ranked AS (SELECT c.ctx, p.item_id, row_number() OVER (PARTITION BY c.ctx ORDER BY place) AS rank FROM (SELECT DISTINCT ctx FROM truth_all) c JOIN popular_order p ON NOT EXISTS (SELECT 1 FROM useen s WHERE s.user_id = c.ctx AND s.item_id = p.item_id))"
_F = ", ".join(f"round({x}, 8) AS {x}"for x in BASE)
_E = ", ".join(f"round({x}, 8) AS {x}" for x in ENRICHED)
_PRIOR = "2 * {p}rrf_share + CAST(0.02 AS DOUBLE) * {p}reciprocal_rank"
_PAIRS = """pairs AS (
  SELECT p.example_id, p.candidate_item_id AS positive, n.candidate_item_id AS negative, CASE WHEN p.retrieved_positive = 1 THEN 1.0::DOUBLE ELSE 0.25 END AS weight,
         2 * p.rrf_share + CAST(0.02 AS DOUBLE) * p.reciprocal_rank AS p_prior, 2 * n.rrf_share + CAST(0.02 AS DOUBLE) * n.reciprocal_rank AS n_prior
  FROM examples p JOIN examples n ON n.example_id = p.example_id AND n.label = 0 WHERE p.label = 1 AND p.split = 'train'
)"""
_BACKFILL_RANKED = "backfill AS (SELECT ctx, item_id, rank, tier FROM pool)"
_SERVED = (_M1, _NO_CTX, _ALL, _FEATURES, "categories AS (SELECT 0 AS item_id, 0 AS category_id)", _GRAPH)
_RAW = """raw AS (SELECT CAST(epoch_us(ts) // 1000 AS VARCHAR) AS timestamp, CAST(user_id AS VARCHAR) AS visitorid,
  CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event, json_extract_string(props, '$.k') AS itemid,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS transactionid, event_id FROM events)"""
_PROFILE = """SELECT count(*) AS rows_read, count(*) FILTER (fine AND event = 'view') AS view_count, count(*) FILTER (fine AND event = 'addtocart') AS addtocart_count, count(*) FILTER (fine AND event = 'transaction') AS transaction_count,
  count(DISTINCT CASE WHEN fine THEN v END) AS unique_visitors, count(DISTINCT CASE WHEN fine THEN i END) AS unique_items, count(*) FILTER (fine AND has_id) AS transactions_with_id,
  min(CASE WHEN fine THEN t END) AS timestamp_min, max(CASE WHEN fine THEN t END) AS timestamp_max, count(*) FILTER (NOT fine) AS invalid_numeric_field,
  count(*) FILTER (fine AND event NOT IN ('view', 'addtocart', 'transaction')) AS invalid_event, count(*) FILTER (fine AND event = 'transaction' AND NOT has_id) AS transaction_missing_id,
  count(*) FILTER (fine AND event <> 'transaction' AND has_id) AS non_transaction_has_id
FROM (SELECT *, t IS NOT NULL AND v IS NOT NULL AND i IS NOT NULL AS fine, coalesce(transactionid <> '', false) AS has_id FROM (SELECT *, try_cast(timestamp AS BIGINT) AS t, try_cast(visitorid AS BIGINT) AS v, try_cast(itemid AS BIGINT) AS i FROM {}))"""
_QUALITY = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, count(*) AS rows, count(*) FILTER ({' OR '.join(k + ' IS NULL' for k in keys)}) AS null_key_rows, count(*) - count(DISTINCT ({', '.join(keys)})) AS repeated_keys, count(*) FILTER (recency_days < 0) AS negative_recency_rows, true AS passed FROM {t}"
    for n, t, keys in (("user", "uf", ["user_id"]), ("item", "itf", ["item_id"]), ("interaction", "inf", ["user_id", "item_id"]))
)

SQL: dict[str, str] = {
    "scan_project": _with(_M1, select="SELECT * FROM m1"),
    "user_features": _with(_M1, _FEATURES, select=f"SELECT uf.*, r.recent_items FROM uf JOIN ({_RECENT}) r USING (user_id)"),
    "user_recent_items": _with(_M1, _FEATURES, select=_RECENT),
    "item_features": _with(_M1, _FEATURES, select="SELECT * FROM itf"),
    "interaction_features": _with(_M1, _FEATURES, select="SELECT * FROM inf"),
    "watermark": _with(_M1, select="SELECT max(timestamp) AS watermark_ms, count(*) AS rows, strftime(epoch_ms(max(timestamp)), '%Y%m%dT%H%M%SZ') AS version FROM ev"),
    "ingest_bronze": _with(_M1, select=f"SELECT DISTINCT timestamp, user_id, item_id, event_type, event_weight, transaction_id, CAST({_DAY.format('timestamp')} AS VARCHAR) AS event_date FROM m1 WHERE event_weight IS NOT NULL"),
    "ingest_dedup": _with(_M1, select="SELECT DISTINCT timestamp, user_id, item_id, event_type, transaction_id FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev)"),
    "incremental_delta": _with(_M1, _SPLIT, select="SELECT timestamp, user_id, item_id, event_type, event_weight, transaction_id FROM ev WHERE timestamp > (SELECT train_end FROM bounds)"),
    "delta_compaction": _with(_M1, _FEATURES, select=f"SELECT uf.*, r.recent_items FROM uf JOIN ({_RECENT}) r USING (user_id)"),
    "item_compaction": _with(_M1, _FEATURES, select="SELECT * FROM itf"),
    "validate_domain": _with(_M1, select="""SELECT count(*) AS rows, count(*) FILTER (user_id IS NULL OR item_id IS NULL) AS null_ids, count(*) FILTER (event_type IS NULL OR event_type NOT IN ('view', 'addtocart', 'transaction')) AS unknown_types,
  count(*) FILTER (event_weight IS NULL OR event_weight <= 0) AS bad_weights, count(*) FILTER (user_id IS NULL OR item_id IS NULL OR event_weight IS NULL) AS invalid_rows FROM m1"""),
    "quality_report": _with(_M1, _FEATURES, select=_QUALITY),
    "profile_events": _with(_RAW, select=_PROFILE.format("raw")),
    "profile_events_sample": _with(_RAW, select=_PROFILE.format("(SELECT * FROM raw ORDER BY event_id LIMIT 500)")),
    "split_boundaries": _with(_M1, _SPLIT, select="SELECT * FROM bounds"),
    "split_assign": _with(_M1, _SPLIT, select="SELECT timestamp, user_id, item_id, event_type, event_weight, transaction_id, split FROM split"),
    "split_report": _with(_M1, _SPLIT, select="""SELECT split, count(*) AS rows, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'addtocart') AS addtocart_count, count(*) FILTER (event_type = 'transaction') AS transaction_count,
  round(count(*) / CAST((SELECT count(*) FROM split) AS DOUBLE), 8) AS fraction, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM split GROUP BY split"""),
    "popularity": _with(_M1, _SPLIT, select="SELECT item_id, sum(event_weight) AS score, row_number() OVER (ORDER BY sum(event_weight) DESC, item_id) AS rank FROM past GROUP BY item_id"),
    "popularity_topk": _with(*_BACK, _POPULAR_RANK, select="SELECT ctx AS user_id, item_id, rank FROM popular_ranked WHERE rank <= 20"),
    "ground_truth_stats": _with(_M1, _SPLIT, select="""SELECT count(*) AS relevant_event_rows, count(DISTINCT user_id) AS users_with_relevant_events, count(*) FILTER (NOT warm) AS cold_user_event_rows_excluded, count(*) FILTER (repeated) AS repeated_seen_event_rows_excluded,
  count(DISTINCT user_id) FILTER (NOT repeated) AS eligible_users, count(DISTINCT user_id) FILTER (NOT repeated AND warm) AS eligible_warm_users FROM relevant"""),
    "ground_truth_warm": _with(_M1, _SPLIT, select="SELECT ctx AS user_id, item_id FROM truth"),
    "metrics_popularity": _with(*_BACK, _POPULAR_RANK, _metrics((5, 10, 20), "popular_ranked", "truth_all"), select="SELECT * FROM metrics"),
    "user_history": _with(_M2, select="""SELECT user_id, item_id, weight, timestamp, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id) - 1 AS position
  FROM (SELECT user_id, item_id, sum(event_weight) AS weight, max(timestamp) AS timestamp FROM ev GROUP BY ALL)) WHERE position < 50"""),
    "cooccurrence_pairs": _with(_M2, _NO_CTX, _ALL, "categories AS (SELECT 0 AS item_id, 0 AS category_id)", _GRAPH, select='SELECT item_id AS "left", other AS "right", n FROM both_ways WHERE item_id < other'),
    "cooccurrence_neighbors": _with(_M2, _NO_CTX, _ALL, "categories AS (SELECT 0 AS item_id, 0 AS category_id)", _GRAPH, select="SELECT item_id, other, round(similarity, 8) AS similarity, rank FROM neighbors"),
    "session_transitions": _with(_M1, _NO_CTX, _ALL, _CATEGORIES, _GRAPH, select="SELECT item_id, other, round(transition_score, 8) AS transition_score, rank FROM transitions"),
    "item_categories": """WITH log AS (SELECT epoch_us(l_shipdate) // 1000 AS timestamp, l_partkey AS item_id, l_suppkey AS v FROM lineitem), until_t AS (SELECT max(timestamp) - CAST(86400000 AS BIGINT) * 365 AS t FROM log)
SELECT item_id, v AS category_id, timestamp AS source_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC, v) AS nth FROM log, until_t WHERE timestamp <= t) WHERE nth = 1""",
    "category_popularity": _with(_M1, _CATEGORIES, _NO_CTX, _ALL, _GRAPH, select="SELECT category_id, item_id, category_rank FROM category_lists"),
    "cooccurrence_scores": _with(*_POOLED, select="SELECT ctx AS user_id, item_id, score, recent_score, n_sources, round(max_similarity, 8) AS max_similarity FROM plain"),
    "cooccurrence_backfill": _with(*_POOLED, select="SELECT ctx AS user_id, item_id, rank, tier FROM pool"),
    "session_source": _with(*_BACK, select="SELECT ctx AS user_id, item_id, rank FROM sources WHERE source = 'session_transition'"),
    "category_source": _with(*_BACK, select="SELECT ctx AS user_id, item_id, rank FROM sources WHERE source = 'category_popularity'"),
    "rrf_fusion": _with(*_BACK, select="SELECT ctx AS user_id, item_id, rrf, rank FROM hybrid"),
    "source_contribution": _with(*_BACK, select=" UNION ALL ".join(f"SELECT '{f[5:]}' AS source, CAST(sum({f}) AS BIGINT) AS fused_items, count(DISTINCT CASE WHEN {f} = 1 THEN ctx END) AS contexts FROM hybrid" for f in FLAGS)),
    "source_flags": _with(*_BACK, select=f"SELECT ctx AS user_id, item_id, {', '.join(FLAGS)} FROM hybrid"),
    "metrics_cooccurrence": _with(*_POOLED, _metrics((5, 10, 20), "pool", "truth"), select="SELECT * FROM metrics"),
    "metrics_hybrid": _with(*_BACK, select=_candidate_metrics((50, 100), "hybrid")),
    "relative_lift": _with(*_POOLED, _POPULAR_RANK, _metrics((5, 10, 20), "pool", "truth", "new"), _metrics((5, 10, 20), "popular_ranked", "truth", "old"), select="SELECT k, " + ", ".join(f"round(CASE WHEN o.{m} <> 0 THEN (n.{m} / o.{m} - 1) * 100 END, 8) AS {m}_relative_pct" for m in ("precision", "recall", "hit_rate", "ndcg")) + " FROM new n JOIN old o USING (k)"),
    "rolling_targets": _with(_M1, _ROLL, select="SELECT ctx AS example_id, user_id, item_id, timestamp, seq FROM found"),
    "rolling_skips": _with(_M1, _ROLL, select="SELECT count(*) AS relevant_rows, count(*) FILTER (seq <> first_seq) AS skipped_repeat_target, count(*) FILTER (seq = first_seq AND seq = 1) AS skipped_no_history FROM flagged, windows WHERE event_type IN ('addtocart', 'transaction') AND timestamp >= g_start"),
    "point_in_time_history": _with(_M1, _ROLL, _CATEGORIES, _GRAPH, select="SELECT ctx AS example_id, item_id, weight, timestamp, position FROM hist"),
    "candidate_features_v1": _with(*_POOLED, select="SELECT ctx AS user_id, item_id, rank, " + ", ".join(f"round({x}, 8) AS {x}" for x in BASE[:5]) + " FROM base"),
    "candidate_features": _with(*_POOLED, select=f"SELECT ctx AS user_id, item_id, rank, {_F} FROM base"),
    "enriched_pool": _with(*_POOLED, _enriched(), select=f"SELECT ctx AS user_id, item_id, rank, {_E} FROM enriched"),
    "enriched_test_groups": _with(*_POOLED, _enriched(zeros=True), select=f"SELECT e.ctx AS user_id, e.item_id, e.rank, CAST(t.item_id IS NOT NULL AS INTEGER) AS label, {_E} FROM enriched e LEFT JOIN truth t ON t.ctx = e.ctx AND t.item_id = e.item_id"),
    "target_timestamp": _with(_M1, _SPLIT, select="SELECT * FROM first_target"),
    "rolling_examples": _with(*_ROLLED, select="SELECT * FROM examples"),
    "temporal_folds": _with(_M1, _CATEGORIES, _rolling(((0.45, 0.60), (0.60, 0.75), (0.75, 0.90), (0.90, 1))), _GRAPH, _SOURCES, _POOL.replace("{more}", ""), _enriched(), "texts AS (SELECT g, ctx, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY position) AS history FROM hist GROUP BY ALL)", "retrieved AS (SELECT f.g, f.ctx, row_number() OVER (ORDER BY f.ctx) AS example_id FROM found f JOIN enriched e ON e.g = f.g AND e.ctx = f.ctx AND e.item_id = f.item_id)",
        select=f"SELECT e.g AS fold, r.example_id, CASE WHEN e.g = 3 THEN 'validation' ELSE 'train' END AS role, f.timestamp, f.user_id, e.item_id AS candidate_item_id, CAST(e.item_id = f.item_id AS INTEGER) AS label, history, {_E} FROM enriched e JOIN found f ON f.g = e.g AND f.ctx = e.ctx JOIN retrieved r ON r.ctx = e.ctx JOIN texts t ON t.ctx = e.ctx"),
    "hash_sample": _with(_M1, select="SELECT timestamp, user_id, item_id FROM ev WHERE (CAST(user_id AS HUGEINT) * 2654435761) % 10000 < 2500"),
    "bpr_pairs": _with(*_ROLLED, _PAIRS, select="SELECT example_id, positive, negative, weight, round(p_prior, 8) AS p_prior, round(n_prior, 8) AS n_prior FROM pairs"),
    "listwise_groups": _with(*_ROLLED, select="SELECT example_id, count(*) AS candidates, CAST(sum(label) AS BIGINT) AS positives, count(*) = 21 AND sum(label) = 1 AS complete FROM examples GROUP BY example_id"),
    "item_index": _with(_M1, select="SELECT item_id, row_number() OVER (ORDER BY item_id) AS idx FROM (SELECT DISTINCT item_id FROM ev)"),
    "prior_score_bce": _with(*_POOLED, select="SELECT ctx AS user_id, item_id, round(8 * (score_share + CAST(0.01 AS DOUBLE) * reciprocal_rank) - 4, 6) AS prior FROM base"),
    "bpr_loss": _with(*_ROLLED, _PAIRS, select="SELECT count(*) AS pairs, round(sum(weight * (greatest(n_prior - p_prior, 0) + ln(1 + exp(-abs(n_prior - p_prior))))) / sum(weight), 6) AS loss FROM pairs"),
    "listwise_loss": _with(*_ROLLED, select="SELECT count(*) AS groups, round(avg(ln(mass) - s), 6) AS loss FROM (SELECT label, 2 * rrf_share + CAST(0.02 AS DOUBLE) * reciprocal_rank AS s, sum(exp(2 * rrf_share + CAST(0.02 AS DOUBLE) * reciprocal_rank)) OVER (PARTITION BY example_id) AS mass FROM examples WHERE split = 'train') WHERE label = 1"),
    "positive_weight": _with(*_ROLLED, select="SELECT round(count(*) FILTER (label = 0) / CAST(greatest(count(*) FILTER (label = 1), 1) AS DOUBLE), 8) AS positive_weight FROM examples"),
    "metrics_prior_ranker": _with(*_ROLLED, "placed AS (SELECT example_id AS ctx, candidate_item_id AS item_id, label, row_number() OVER (PARTITION BY example_id ORDER BY rrf_share DESC, reciprocal_rank DESC, candidate_item_id) AS rank FROM examples WHERE split = 'validation')", "positives AS (SELECT p.ctx, item_id FROM placed p JOIN examples e ON e.example_id = p.ctx AND e.candidate_item_id = p.item_id WHERE p.label = 1 AND e.retrieved_positive = 1)", _metrics((5, 10, 20), "placed", "positives"), select="SELECT k, users AS groups, precision, recall, hit_rate, ndcg FROM metrics"),
    "serve_history": _with(_M1, _FEATURES, _SERVE.split(", scored AS")[0], select="SELECT * FROM ohist"),
    "serve_recommend": _with(*_SERVED, _SERVE.replace("{asked}", "SELECT user_id FROM uf"), select="SELECT user_id, item_id, rrf, rank FROM served WHERE rank <= 10"),
    "serve_features": _with(*_SERVED, _SERVE.replace("{asked}", "SELECT user_id FROM uf"), select="SELECT * FROM online"),
    "serve_cold_start": _with(*_SERVED, _SERVE.replace("{asked}", "SELECT 1000000001 AS user_id UNION ALL SELECT 1000000002"), select="SELECT user_id, item_id, rrf, rank FROM served WHERE rank <= 10"),
    "serve_challenger": _with(*_SERVED, _SERVE.replace("{asked}", "SELECT user_id FROM uf"), select="SELECT * FROM (SELECT user_id, item_id, rank, c AS challenger_score, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, item_id) AS served_rank FROM (SELECT *, round(2 * rrf_share + CAST(0.02 AS DOUBLE) * reciprocal_rank + CAST(0.5 AS DOUBLE) * popularity_share, 6) AS c FROM online)) WHERE served_rank <= 10"),
    "popular_items": _with(_M1, _FEATURES, select="SELECT * FROM (SELECT item_id, weighted_popularity, row_number() OVER (ORDER BY weighted_popularity DESC, item_id) AS rank FROM itf) WHERE rank <= 100"),
    "publish_kv": _with(_M1, _FEATURES, select="SELECT 'features:v1:item:' || item_id AS key, item_id, event_count, weighted_popularity FROM itf"),
    "latency_summary": """SELECT n AS requests, round(m, 8) AS mean_ms, round(list[1 + CAST(round_even((n - 1) * CAST(0.5 AS DOUBLE), 0) AS BIGINT)], 8) AS p50_ms, round(list[1 + CAST(round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) AS BIGINT)], 8) AS p95_ms,
  round(list[1 + CAST(round_even((n - 1) * CAST(0.99 AS DOUBLE), 0) AS BIGINT)], 8) AS p99_ms, round(n / CAST(60 AS DOUBLE), 8) AS throughput FROM (SELECT count(*) AS n, avg(value) AS m, list(value ORDER BY value) AS list FROM events)""",
    "confidence_interval": """SELECT n, round(m, 8) AS mean, round(m - CASE n WHEN 2 THEN 12.706::DOUBLE WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 WHEN 5 THEN 2.776 ELSE 1.96 END * s / sqrt(CAST(n AS DOUBLE)), 8) AS low, round(m + CASE n WHEN 2 THEN 12.706::DOUBLE WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 WHEN 5 THEN 2.776 ELSE 1.96 END * s / sqrt(CAST(n AS DOUBLE)), 8) AS high
FROM (SELECT count(*) AS n, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT event_type, max(value) AS v FROM events GROUP BY event_type))""",
    "latency_histogram": " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b} * 1000::DOUBLE) AS n FROM events GROUP BY event_type" for b in (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)) + " UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY event_type",
    "request_counts": "SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "rate_limit": """WITH RECURSIVE placed AS MATERIALIZED (
  SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS nth,
         1 + count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND 3599999 FOLLOWING) AS following
  FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events)
), admitted AS (
  SELECT user_id, nth, following FROM placed WHERE nth = 1
  UNION ALL SELECT p.user_id, p.nth, p.following FROM admitted a JOIN placed p ON p.user_id IS NOT DISTINCT FROM a.user_id AND p.nth = a.following
)
SELECT p.event_id, p.user_id, p.ms, a.nth IS NOT NULL AS admitted FROM placed p LEFT JOIN admitted a ON a.user_id IS NOT DISTINCT FROM p.user_id AND a.nth = p.nth""",
    "metric_flatten": """SELECT unnest(['events.rows', 'events.users', 'metrics.at_10.mean']) AS metric, unnest([CAST(n AS DOUBLE), CAST(u AS DOUBLE), m]) AS value FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS u, round(avg(value), 8) AS m FROM events)""",
    "embedding_interaction": """WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS mean FROM e GROUP BY label, i)
SELECT vec_id, round(sum(x * mean), 6) AS product_sum, round(sum(abs(x - mean)), 6) AS difference_sum FROM e JOIN m USING (label, i) GROUP BY vec_id""",
}
