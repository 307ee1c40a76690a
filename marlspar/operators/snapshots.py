"""Immutable, versioned feature snapshots: tables first, sidecars next, the state last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import version_id
from ..sidecars import Progress, folders, is_there, manifest_problems, read_json, read_progress, write_json, write_progress
from ..sources.sinks import write_snapshot_table
from . import features, ingest, quality

KEYS = {"user": ["user_id"], "item": ["item_id"], "interaction": ["user_id", "item_id"]}


def build(events: DataFrame, root: str, state_path: str, incremental: bool = False, version: str | None = None) -> dict:
    """Write one snapshot of events after the stored watermark (all of them if not incremental); its manifest.
    Rows are counted as they are written. root and state_path may be URIs of any file system that Spark reaches."""
    spark = events.sparkSession
    before = read_progress(spark, state_path)
    own = ingest.after(events, before.watermark_ms if incremental else -1)
    ingest.require_domain(own)
    last = features.as_of(own)
    if last is None:
        raise ValueError("no events after the watermark")
    version = version or spark.range(1).select(version_id(F.lit(last))).first()[0]
    path = f"{root}/{version}"
    if is_there(spark, path):
        raise FileExistsError(f"version {version} is there; versions are immutable")
    tables = {"user": features.user_features(own, last), "item": features.item_features(own, last), "interaction": features.interaction_features(own, last)}
    kind = {"snapshot_type": "delta", "incremental": True, "parent_version": before.latest_version} if incremental else {"snapshot_type": "full", "incremental": False}
    manifest = {"feature_version": version, "watermark_ms": last, "row_counts": _write(tables, path), "format": "parquet", **kind}
    if wrong := manifest_problems(manifest):
        raise ValueError("; ".join(wrong))
    write_json(spark, f"{path}/_manifest.json", manifest)
    write_progress(spark, state_path, Progress(last, version))
    return manifest


def _write(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Rows of each table, counted on their way."""
    counts = {}
    for entity, table in tables.items():
        seen = Observation(f"{entity}_rows")
        write_snapshot_table(table.observe(seen, F.count("*").alias("n")), f"{path}/{entity}_features")
        counts[entity] = seen.get["n"]
    return counts


def validate(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Check every table of a snapshot and write the quality sidecar."""
    failures = manifest_problems(manifest)
    for entity, keys in KEYS.items():
        row = quality.check_table(spark.read.parquet(f"{path}/{entity}_features"), entity, keys, manifest["row_counts"][entity]).first()
        if not row["passed"]:
            failures.append(f"{entity}: {row.asDict()}")
    report = {"feature_version": manifest["feature_version"], "passed": not failures, "failures": failures}
    write_json(spark, f"{path}/_quality.json", report)
    return report


def _servable(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(the snapshot is a full one, it passed its quality check)"""
    manifest, report = (read_json(spark, f"{path}/{x}") or {} for x in ("_manifest.json", "_quality.json"))
    return manifest.get("snapshot_type") == "full", bool(report.get("passed"))


def latest_validated(spark: SparkSession, root: str) -> str | None:
    """The last full version whose quality check passed."""
    return max((x for x in folders(spark, root) if all(_servable(spark, f"{root}/{x}"))), default=None)


def activate(spark: SparkSession, root: str, version: str) -> None:
    """Point serving at a full, validated version; a delta is compacted first."""
    full, passed = _servable(spark, f"{root}/{version}")
    if not full:
        raise ValueError("only a full snapshot can serve; compact the deltas into one")
    if not passed:
        raise ValueError("no passed quality check is recorded for the version")
    write_json(spark, f"{root}/_active.json", {"version": version})


def active(spark: SparkSession, root: str) -> str:
    found = read_json(spark, f"{root}/_active.json")
    if found is None:
        raise LookupError("no version is active")
    return found["version"]


def compact(spark: SparkSession, root: str, versions: list[str], new_version: str) -> dict:
    """One full snapshot out of a full one and the deltas after it."""
    read = lambda entity: [spark.read.parquet(f"{root}/{v}/{entity}_features") for v in versions]
    last = max(x.agg(F.max("last_event_timestamp")).first()[0] for x in read("item"))
    pairs = features.compact_interactions(read("interaction"), last)
    tables = {"interaction": pairs, "item": features.compact_items(read("item"), pairs, last), "user": features.compact_users(read("user"), pairs, last)}
    path = f"{root}/{new_version}"
    manifest = {"feature_version": new_version, "watermark_ms": last, "row_counts": _write(tables, path), "format": "parquet", "snapshot_type": "full", "incremental": False, "compacted_from": versions}
    write_json(spark, f"{path}/_manifest.json", manifest)
    return manifest
