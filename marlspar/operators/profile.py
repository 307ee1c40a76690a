"""What a raw log holds, and how it is cut in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import WEIGHTS


def profile(raw_text: DataFrame) -> DataFrame:
    """One row over a raw log of text fields: rows without whole numbers are counted as errors and else
    left out; rows of unknown types are errors but counted."""
    number = {c: F.expr(f"try_cast(`{c}` AS BIGINT)") for c in ("timestamp", "visitorid", "itemid")}
    parsed = raw_text.select(*(e.alias(c) for c, e in number.items()), "event", F.coalesce(F.col("transactionid") != "", F.lit(False)).alias("has_id"))
    fine = F.col("timestamp").isNotNull() & F.col("visitorid").isNotNull() & F.col("itemid").isNotNull()
    known = F.coalesce(F.col("event").isin(*WEIGHTS), F.lit(False))
    bought = F.coalesce(F.col("event") == "transaction", F.lit(False))
    only = lambda c: F.when(fine, F.col(c))
    return parsed.agg(
        F.count("*").alias("rows_read"),
        *(F.count_if(fine & (F.col("event") == x)).alias(f"{x}_count") for x in WEIGHTS),
        F.count_distinct(only("visitorid")).alias("unique_visitors"), F.count_distinct(only("itemid")).alias("unique_items"),
        F.count_if(fine & F.col("has_id")).alias("transactions_with_id"),
        F.min(only("timestamp")).alias("timestamp_min"), F.max(only("timestamp")).alias("timestamp_max"),
        F.count_if(~fine).alias("invalid_numeric_field"), F.count_if(fine & ~known).alias("invalid_event"),
        F.count_if(fine & bought & ~F.col("has_id")).alias("transaction_missing_id"),
        F.count_if(fine & ~bought & F.col("has_id")).alias("non_transaction_has_id"),
    )


def sample(raw_text: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """The first rows of a stated order: a table has no file order."""
    return raw_text.orderBy(*order).limit(rows)


def check_ratios(train: float, validation: float) -> None:
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("ratios lie between 0 and 1 and leave a rest")


def boundaries(events: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """One row: minimum, maximum, and where validation and test begin."""
    check_ratios(train, validation)
    span = F.col("maximum") - F.col("minimum") + 1
    cut = lambda ratio: F.col("minimum") + F.floor(span * F.lit(ratio)).cast("long")
    ends = events.agg(F.min("timestamp").alias("minimum"), F.max("timestamp").alias("maximum"))
    return ends.select("minimum", "maximum", cut(train).alias("train_end"), cut(train + validation).alias("validation_end"))


def assign_split(events: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """events with a column split: a boundary instant belongs to the later part."""
    ends = F.broadcast(boundaries(events, train, validation).select("train_end", "validation_end"))  # one row
    name = F.when(F.col("timestamp") < F.col("train_end"), "train").when(F.col("timestamp") < F.col("validation_end"), "validation").otherwise("test")
    return events.join(ends).withColumn("split", name).drop("train_end", "validation_end")


def split_report(split: DataFrame) -> DataFrame:
    """A row for each of the three parts, empty ones too: rows, share, counts by type, first and last time."""
    spark = split.sparkSession
    names = spark.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    counts = split.groupBy("split").agg(F.count("*").alias("rows"), *(F.count_if(F.col("event_type") == x).alias(f"{x}_count") for x in WEIGHTS), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))
    total = counts.agg(F.sum("rows").alias("total"))
    out = names.join(counts, "split", "left").join(F.broadcast(total))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", *(f"{x}_count" for x in WEIGHTS))]
    share = F.round(F.coalesce("rows", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)), 8).alias("fraction")
    return out.select("split", *filled, share, "first_ms", "last_ms")


def require_known_types(events: DataFrame) -> DataFrame:
    """events whose type column fails the query at the first unknown value."""
    known = F.coalesce(F.col("event_type").isin(*WEIGHTS), F.lit(False))
    return events.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null"))))))
