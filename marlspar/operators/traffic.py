"""Request traffic: rate limits, and flat metrics from nested reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_MS = 60_000


def request_counts(requests: DataFrame, key: str, ms: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """requests with in_window: requests of the key in the window that ends with each, itself included."""
    span = Window.partitionBy(key).orderBy(ms).rangeBetween(1 - window_ms, 0)
    return requests.withColumn("in_window", F.count("*").over(span))


def admit(requests: DataFrame, key: str, ms: str, order: str, limit: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """requests with admitted: refused ones don't count against the limit, which only a fold in time order
    can tell. Each key keeps `limit` times at most; rows stream through in sorted partitions. Null is a key like others."""
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        current, window = object(), deque()
        for frame in frames:
            out = []
            for own, now in zip(frame[key].astype(object).where(frame[key].notna(), None), frame[ms], strict=True):
                if own != current:
                    current, window = own, deque()
                while window and window[0] <= now - window_ms:
                    window.popleft()
                out.append(len(window) < limit)
                if out[-1]:
                    window.append(now)
            yield frame.assign(admitted=out)

    return requests.repartition(key).sortWithinPartitions(key, ms, order).mapInPandas(replay, schema)


def flatten_metrics(reports: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(metric, value) of every number in a nested struct column of one report, names joined by dots, @ as
    at_; flags and texts are left out. The shape comes from the schema, so it is one projection. most: leave the metrics behind the first so many out; all by default."""

    def walk(kind: T.StructType, path: list[str]) -> list[tuple[list[str], T.DataType]]:
        found = []
        for field in kind.fields:
            if isinstance(field.dataType, T.StructType):
                found += walk(field.dataType, [*path, field.name])
            elif isinstance(field.dataType, T.NumericType):
                found.append(([*path, field.name], field.dataType))
        return found

    leaves = walk(reports.schema[column].dataType, [])[:most]

    def value(path: list[str]):
        out = F.col(column)
        for name in path:
            out = out.getField(name)
        return out.cast("double")

    pairs = [F.struct(F.lit(".".join(p).replace("@", "at_")).alias("metric"), value(p).alias("value")) for p, _ in leaves]
    return reports.select(F.explode(F.array(*pairs)).alias("m")).select("m.metric", "m.value")
