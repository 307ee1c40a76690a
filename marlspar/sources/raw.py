"""Readers of raw and normalised event files, with header checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import EVENTS, HEADERS, PROPERTIES, RAW_EVENTS


def check_header(spark: SparkSession, path: str, expected: list[str]) -> None:
    """ValueError unless the first line is exactly `expected`, order included."""
    first = spark.read.text(path).limit(1).collect()
    found = first[0][0].split(",") if first else []
    if found != expected:
        raise ValueError(f"{path}: expected header {expected}, found {found}")


def check_raw_files(spark: SparkSession, folder: str) -> None:
    """All raw files are there, each with its header."""
    missing, jvm = [], spark.sparkContext._jvm
    for name, header in HEADERS.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            check_header(spark, f"{folder}/{name}", header)
        else:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"missing files: {', '.join(missing)}")


def raw_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw click log; what is no number becomes null (gzip by extension, one task a file)."""
    return spark.read.option("header", True).schema(RAW_EVENTS).csv(list(paths))


def raw_event_text(spark: SparkSession, *paths: str) -> DataFrame:
    """The raw log with every field as text, for profiling what doesn't parse."""
    schema = ", ".join(f"{x.name} string" for x in RAW_EVENTS)
    return spark.read.option("header", True).schema(schema).csv(list(paths))


def property_log(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("header", True).schema(PROPERTIES).csv(list(paths))


def csv_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Normalised events from CSV splits."""
    return spark.read.option("header", True).schema(EVENTS).csv(list(paths))


def parquet_events(spark: SparkSession, *paths: str) -> DataFrame:
    """The six event columns from Parquet, by name; others are never read."""
    return spark.read.parquet(*paths).select(*(F.col(x.name) for x in EVENTS))


def ranked_edges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ranked-edge file as the gzip sink writes it."""
    return spark.read.option("header", True).schema(schema).csv(path)
