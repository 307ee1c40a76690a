"""Checks of a feature table in one pass over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_table(table: DataFrame, name: str, keys: list[str], expected_rows: int | None = None) -> DataFrame:
    """One row: rows, null keys, repeated keys, negative recency, and whether all is well."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    by_key = table.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(null_key).alias("null_keys"), F.count_if(F.col("recency_days") < 0).alias("negative"))
    total = by_key.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("n", "rows"), ("null_keys", "null_key_rows"), ("negative", "negative_recency_rows"))), F.count_if(F.col("n") > 1).alias("repeated_keys"))
    matches = F.lit(True) if expected_rows is None else F.col("rows") == expected_rows
    passed = matches & (F.col("null_key_rows") == 0) & (F.col("repeated_keys") == 0) & (F.col("negative_recency_rows") == 0)
    return total.select(F.lit(name).alias("entity"), "rows", "null_key_rows", "repeated_keys", "negative_recency_rows", passed.alias("passed"))
