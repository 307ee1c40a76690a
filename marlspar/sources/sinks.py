"""Writers: write-once Parquet, routed splits, ranked edges, examples, reports and key-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sidecars import write_json


def write_bronze(events: DataFrame, root: str, version: str) -> str:
    """root/version=<v>/event_date=<d>/; fails if the version is there."""
    path = f"{root}/version={version}"
    events.write.mode("errorifexists").partitionBy("event_date").parquet(path)
    return path


def write_snapshot_table(table: DataFrame, path: str, partitions: int | None = None) -> None:
    """A write-once Parquet table; without a number of files adaptive execution sizes them."""
    out = table.repartition(partitions) if partitions else table.hint("rebalance")
    out.write.mode("errorifexists").parquet(path)


def write_splits(events: DataFrame, path: str) -> None:
    """One pass over events with a column split; a folder for each."""
    events.write.mode("errorifexists").partitionBy("split").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str, key: str, score: str | None = None) -> None:
    """Ranked edges as gzip CSV in key and rank order, scores with 8 decimals. Ranges of keys go to
    files that sort after one another, so no task holds the whole graph."""
    shown = edges.withColumn(score, F.format_string("%.8f", score)) if score else edges
    shown.repartitionByRange(key).sortWithinPartitions(key, "rank").write.option("header", True).option("compression", "gzip").mode("errorifexists").csv(path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Examples as gzip CSV: features with 8 decimals, the history as ids joined by spaces."""
    floats = [x.name for x in examples.schema if x.dataType.simpleString() == "double"]
    shown = examples.withColumns({x: F.format_string("%.8f", x) for x in floats})
    shown.repartitionByRange("example_id").sortWithinPartitions("example_id").write.option("header", True).option("compression", "gzip").mode("errorifexists").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    write_json(report.sparkSession, path, rows[0].asDict(recursive=True))


def write_key_values(rows: DataFrame, put, batch: int = 1000) -> int:
    """Send (key, value) rows in batches to `put(list of pairs)`, called on the executors; the number sent,
    which must equal the rows, else RuntimeError. The caller switches its version pointer afterwards."""
    sent = rows.sparkSession.sparkContext.accumulator(0)

    def send(part):
        pending = []
        for row in part:
            pending.append((row["key"], row["value"]))
            if len(pending) == batch:
                put(pending)
                sent.add(len(pending))
                pending = []
        if pending:
            put(pending)
            sent.add(len(pending))

    rows.foreachPartition(send)
    if sent.value != (expected := rows.count()):
        raise RuntimeError(f"sent {sent.value} of {expected} rows; the version must not be activated")
    return sent.value
