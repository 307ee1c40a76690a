"""Quality classification by importance resampling over hashed n-grams, sampled by Gumbel top-k.

Words and runs of punctuation, in their own case, are hashed as unigrams and bigrams into 2^16 buckets;
all bigrams of a word and itself share a bucket.
The target model counts the buckets of a bounded sample of documents labelled good, the raw model those
of all documents. A document's n-grams are not independent draws: with n of them, each two correlated by
CORRELATION, their mean is as sure as that of n / (1 + (n - 1) CORRELATION) independent ones (the design
effect of cluster samples), and the log weight is the sum of log ratios over 1 + (n - 1) CORRELATION, for
texts of every length alike. The sample of k
documents without replacement is the k largest values of log weight plus Gumbel noise (from a hash of
the id, so that a task that runs again draws the same). Unless k is given it is the number of
documents that are not clearly bad: share * weight >= 0.02, share being the part of the labels that
say good. The k-th value is found by counting bins, a bounded table each round.

Bounds: TARGET_ROWS labelled rows for the target model; 2^16 rows of counts reach the driver; each
round of the selection brings it at most BINS rows.

Defined cases: a null text is empty; an empty text has no n-grams and the log weight 0; null labels
count as not good; null ids share one draw of noise; repeated rows share theirs, and all rows tied with
the k-th are kept; without good labels every weight is 1 and everything is kept; an empty table
gives no rows; texts are read whole; columns other than id and text are not read, but handed on in one
struct column on request, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, flat, lean, map_batches, narrow, stage, wrapped
from .hashing import WORDS_AND_MARKS, mix, tokens

BITS = 16
#: Bound of the sample of good documents that the target model is fitted on (the least hashes of ids).
TARGET_ROWS = 20_000
#: Pseudo-count, in target n-grams, that draws each bucket's ratio to 1: else a group of copies of one good
#: text stands or falls, all its n-grams together, with how many of them happen to be labelled.
SMOOTHING = 64.0
#: A document counts against k only if it is this unlikely to be good: doubtful ones are kept.
DOUBT = 0.02
#: Correlation of the log ratios within a document.
CORRELATION = 1 / 64
#: The hash of any word followed by itself: a repeated word is one feature, whatever the word.
TWICE = np.uint64(0x5851F42D4C957F2D)
BINS = 4096
#: Keys are compared as whole numbers of this fraction.
STEPS = 1 << 20


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every unigram and bigram."""
    owner, words = tokens(data, offsets, WORDS_AND_MARKS, lower=False)
    if len(words) == 0:
        return owner, words.astype(np.int64)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    pairs[words[1:] == words[:-1]] = TWICE
    inside = owner[1:] == owner[:-1]
    buckets = np.concatenate([words, pairs[inside]]) >> np.uint64(64 - BITS)
    return np.concatenate([owner, owner[1:][inside]]), buckets.astype(np.int64)


def _count(batches):
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        data, at = flat(batch["text"])
        good = batch["good"].to_numpy(zero_copy_only=False).astype(bool)
        for first, last in blocks(at):
            owner, buckets = ngrams(data, at[first : last + 1])
            raw += np.bincount(buckets, minlength=1 << BITS)
            target += np.bincount(buckets[good[first:last][owner]], minlength=1 << BITS)
    found = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(raw[found]), pa.array(target[found])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, share of good labels). labels: (doc_id, quality 0 or 1)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("good_id"), (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("good"))
    share = marked.agg(F.avg(F.col("good").cast("double"))).first()[0] or 0.0
    good = marked.filter("good AND good_id IS NOT NULL").select("good_id").distinct().orderBy(F.xxhash64("good_id"), "good_id").limit(target_rows)
    texts = narrow(docs, binary=True).join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))
    counted = map_batches(texts, lean(_count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row in counted.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(1 << BITS), 1.0
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + SMOOTHING) - np.log(expected + SMOOTHING), share


def _weigh(ratios: np.ndarray):
    def run(batches):
        for batch in batches:
            data, at = flat(batch["text"])
            n, weight = [], []
            for first, last in blocks(at):
                owner, buckets = ngrams(data, at[first : last + 1])
                n.append(np.bincount(owner, minlength=last - first))
                weight.append(np.bincount(owner, ratios[buckets], minlength=last - first))
            n, weight = (np.concatenate(x) if x else np.zeros(0) for x in (n, weight))
            weight = weight / (1 + np.maximum(n - 1, 0) * CORRELATION)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(weight.astype(np.float64))], names=[batch.schema.names[0], "n_ngrams", "log_weight"])

    return run


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id (or row, a struct of all columns of docs), n_ngrams, log_weight, key: a row for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    own = wrapped(docs, text) if keep_columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    schema = T.StructType([own.schema.fields[0], T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    out = map_batches(own, _weigh(ratios), schema)
    number = F.col("row").getField(id_col).cast("long") if keep_columns else F.col("doc_id")
    uniform = (F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.withColumn("key", F.round((F.col("log_weight") - F.log(-F.log(uniform))) * STEPS).cast("long"))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column `key`, exactly; None if k < 1. The least if there are fewer."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = (high - low) // BINS + 1
        bins = keys.filter(F.col("key").between(low, high)).groupBy(F.expr(f"(key - {low}L) div {width}L").alias("bin")).count()
        for row in sorted(bins.collect(), reverse=True):  # BINS rows at most
            if row["count"] >= k:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            k -= row["count"]
        else:
            return low
        if width == 1:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 42, keep_columns: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id (or row, a struct of all its columns), n_ngrams, log_weight, key, kept.

    Only ids and weights are staged; with keep_columns the texts are weighed once more as they pass."""
    ratios, share = fit(docs, labels)
    scored = stage(weigh(docs, ratios, seed), "weights")
    if k is None:
        k = scored.filter(F.col("log_weight") >= float(np.log(DOUBT / share))).count() if share else 0
    least = kth_largest(scored.select("key"), k)
    out = weigh(docs, ratios, seed, keep_columns=True) if keep_columns else scored
    return out.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)


def op10(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = resample(docs, labels)
    return found.select("doc_id", "n_ngrams", F.round("log_weight", 6).alias("log_weight"), F.round(F.col("key") / STEPS, 6).alias("gumbel_key"), "kept")
