"""Small JSON documents beside the tables, in whatever file system the tables lie in: the manifest and the
quality report of a snapshot, the active version, and how far incremental runs have come.

Everything goes through Hadoop's file systems, so that roots may be URIs of any store that Spark reaches. A
document is written under a name of its own and then renamed over the old one: readers meet the old or the
new one, never a part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(str(path))
    return own.getFileSystem(context._jsc.hadoopConfiguration()), own


def is_there(spark: SparkSession, path: str) -> bool:
    files, own = _at(spark, path)
    return files.exists(own)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders directly below root, sorted."""
    files, own = _at(spark, root)
    return sorted(x.getPath().getName() for x in files.listStatus(own) if x.isDirectory()) if files.exists(own) else []


def remove(spark: SparkSession, path: str) -> None:
    files, own = _at(spark, path)
    files.delete(own, True)


def read_json(spark: SparkSession, path: str) -> Any:
    """What a document holds; None where there is none."""
    files, own = _at(spark, path)
    if not files.exists(own):
        return None
    stream = files.open(own)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    context = spark.sparkContext
    files, own = _at(spark, path)
    fresh = context._jvm.org.apache.hadoop.fs.Path(own.getParent(), f".{own.getName()}-{uuid.uuid4().hex}")
    stream = files.create(fresh, True)
    stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True), "utf-8"))
    stream.close()
    kinds = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = context._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), context._jsc.hadoopConfiguration()).rename(fresh, own, over)


@dataclass(frozen=True)
class Progress:
    """How far incremental runs have come: the last event taken, and the version that took it."""

    watermark_ms: int = -1
    latest_version: str | None = None


def read_progress(spark: SparkSession, path: str) -> Progress:
    """A run that never was has taken nothing."""
    return Progress(**(read_json(spark, path) or {}))


def write_progress(spark: SparkSession, path: str, reached: Progress) -> None:
    write_json(spark, path, vars(reached))


def _whole(value: Any, least: int | None = None) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and (least is None or value >= least)


def _named(value: Any) -> bool:
    return isinstance(value, str) and bool(value)


# The fields that a manifest must have, each with its condition.
MANIFEST: dict[str, tuple[Callable[[Any], bool], str]] = {
    "feature_version": (_named, "a name"),
    "watermark_ms": (_whole, "a whole number"),
    "row_counts": (lambda x: isinstance(x, dict) and all(_whole(n, 0) for n in x.values()), "a whole number from 0 for each table"),
    "format": (_named, "a name"),
    "snapshot_type": (lambda x: x in ("full", "delta"), "full or delta"),
}


def manifest_problems(manifest: dict[str, Any]) -> list[str]:
    """What keeps a manifest from being valid, a line a field; empty if nothing does."""
    wrong = [f"{name} must be {says}" for name, (holds, says) in MANIFEST.items() if name not in manifest or not holds(manifest[name])]
    orphan = manifest.get("incremental") and not _named(manifest.get("parent_version"))
    return [*wrong, "parent_version must be given where incremental is set"] if orphan else wrong
