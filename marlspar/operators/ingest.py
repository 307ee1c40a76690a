"""Raw click log to clean, de-duplicated, partitionable events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import WEIGHTS
from ..functions.scoring import millis_date, version_id
from ..sources.adapters import weight_of

KEY = ["timestamp", "user_id", "item_id", "event_type", "transaction_id"]


def after(events: DataFrame, watermark_ms: int) -> DataFrame:
    """Strictly later rows; a bronze table is also pruned by its date partitions."""
    out = events.filter(F.col("timestamp") > watermark_ms)
    if "event_date" in events.columns and watermark_ms >= 0:
        out = out.filter(F.col("event_date") >= millis_date(F.lit(watermark_ms)))
    return out


def normalise(raw: DataFrame) -> DataFrame:
    """Canonical names and weights; other event types are dropped."""
    kept = raw.filter(F.col("event").isin(*WEIGHTS))
    return kept.select("timestamp", F.col("visitorid").alias("user_id"), F.col("itemid").alias("item_id"), F.col("event").alias("event_type"), weight_of(F.col("event")).alias("event_weight"), F.col("transactionid").alias("transaction_id"))


def bronze(raw: DataFrame, watermark_ms: int = -1) -> DataFrame:
    """What a run adds: later than the watermark, valid, once each, with its date."""
    return normalise(after(raw, watermark_ms)).dropDuplicates(KEY).withColumn("event_date", millis_date(F.col("timestamp")))


def watermark(events: DataFrame) -> DataFrame:
    """One row: the latest timestamp, the rows behind it, and the version it names."""
    return events.agg(F.max("timestamp").alias("watermark_ms"), F.count("*").alias("rows")).withColumn("version", version_id(F.col("watermark_ms")))


def out_of_domain() -> F.Column:
    """True where a row breaks the contract; nulls break it too."""
    broken = F.col("user_id").isNull() | F.col("item_id").isNull() | ~F.col("event_type").isin(*WEIGHTS) | (F.col("event_weight") <= 0)
    return F.coalesce(broken, F.lit(True))


def require_domain(events: DataFrame) -> None:
    """ValueError at the first row out of the domain."""
    if not events.filter(out_of_domain()).isEmpty():
        raise ValueError("events hold null ids, unknown types or weights that are not positive")


def domain_counts(events: DataFrame) -> DataFrame:
    """One row: how many rows break which rule."""
    return events.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("user_id").isNull() | F.col("item_id").isNull()).alias("null_ids"),
        F.count_if(~F.coalesce(F.col("event_type").isin(*WEIGHTS), F.lit(False))).alias("unknown_types"),
        F.count_if(F.coalesce(F.col("event_weight") <= 0, F.lit(True))).alias("bad_weights"),
        F.count_if(out_of_domain()).alias("invalid_rows"),
    )


def valid(events: DataFrame) -> DataFrame:
    return events.filter(~out_of_domain())
