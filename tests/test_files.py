"""Files, contracts and streams."""

import json

import pytest
from pyspark.sql import functions as F

from marlspar import sidecars
from marlspar.functions.templates import run_template
from marlspar.operators import ingest, snapshots
from marlspar.sources import raw, sinks
from marlspar.streaming import ingest as stream




def events(spark, first, last):
    return spark.range(first, last).select(F.col("id").alias("timestamp"), (F.col("id") % 4).alias("user_id"), (F.col("id") % 7).alias("item_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("event_weight"), F.lit(None).cast("string").alias("transaction_id"))


def test_progress_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/s/state.json"
    assert sidecars.read_progress(spark, path) == sidecars.Progress()
    for reached in (sidecars.Progress(123, "v1"), sidecars.Progress(456, "v2")):
        sidecars.write_progress(spark, path, reached)
        assert sidecars.read_progress(spark, path) == reached
    assert [p.name for p in (tmp_path / "s").iterdir() if not p.name.endswith(".crc")] == ["state.json"]


def test_manifest():
    good = {"feature_version": "v", "watermark_ms": 1, "row_counts": {"user": 1}, "format": "parquet", "snapshot_type": "full"}
    assert sidecars.manifest_problems(good) == []
    assert [x.split()[0] for x in sidecars.manifest_problems(good | {"incremental": True})] == ["parent_version"]
    assert [x.split()[0] for x in sidecars.manifest_problems({"row_counts": {"user": -1}})] == list(sidecars.MANIFEST)
    assert sidecars.manifest_problems(good | {"snapshot_type": "part", "row_counts": {"user": True}}) and not sidecars.manifest_problems(good | {"incremental": True, "parent_version": "u"})


def test_templates(spark):
    events = spark.createDataFrame([(1, 5), (1, 9), (2, 20)], "user_id long, timestamp long")
    out = run_template("SELECT user_id, count(*) AS n FROM {source} WHERE timestamp <= :as_of_ms GROUP BY user_id", events, 9)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    for bad in ("SELECT 1", "SELECT * FROM {source}", "SELECT :as_of_ms"):
        with pytest.raises(ValueError):
            run_template(bad, events, 9)


def test_headers(spark, tmp_path):
    for name, header in raw.HEADERS.items():
        (tmp_path / name).write_text(",".join(header) + "\n")
    raw.check_raw_files(spark, str(tmp_path))
    (tmp_path / "events.csv").write_text("wrong\n")
    with pytest.raises(ValueError, match="expected header"):
        raw.check_raw_files(spark, str(tmp_path))
    (tmp_path / "category_tree.csv").unlink()
    with pytest.raises((ValueError, FileNotFoundError)):
        raw.check_raw_files(spark, str(tmp_path))


def test_snapshots_incremental_and_compacted(spark, tmp_path):
    root, state = tmp_path / "f", tmp_path / "state.json"
    full = snapshots.build(events(spark, 0, 60), str(root), str(state), version="a")
    delta = snapshots.build(events(spark, 0, 100), str(root), str(state), incremental=True, version="b")
    assert full["snapshot_type"] == "full" and delta["parent_version"] == "a" and sidecars.read_progress(spark, str(state)).watermark_ms == 99
    with pytest.raises(FileExistsError):
        snapshots.build(events(spark, 0, 60), str(root), str(state), version="a")
    made = snapshots.compact(spark, str(root), ["a", "b"], "c")
    assert snapshots.validate(spark, str(root / "c"), made)["passed"] and snapshots.latest_validated(spark, str(root)) == "c"
    snapshots.validate(spark, str(root / "b"), delta)
    with pytest.raises(ValueError):
        snapshots.activate(spark, str(root), "b")
    with pytest.raises(LookupError):
        snapshots.active(spark, str(root))
    snapshots.activate(spark, str(root), "c")
    assert snapshots.active(spark, str(root)) == "c"
    assert spark.read.parquet(str(root / "c/item_features")).agg(F.sum("event_count")).first()[0] == 100


def test_edges_and_splits(spark, tmp_path):
    edges = spark.createDataFrame([(10, 20, 0.8, 1), (10, 30, 0.4, 2)], "item_id long, other long, similarity double, rank int")
    sinks.write_edges(edges, str(tmp_path / "e"), "item_id", "similarity")
    back = raw.ranked_edges(spark, str(tmp_path / "e"), "item_id long, other long, similarity double, rank int")
    assert [tuple(r) for r in back.orderBy("rank").collect()] == [(10, 20, 0.8, 1), (10, 30, 0.4, 2)]
    sinks.write_splits(events(spark, 0, 9).withColumn("split", F.when(F.col("timestamp") < 5, "train").otherwise("test")), str(tmp_path / "s"))
    assert raw.csv_events(spark, str(tmp_path / "s/split=train")).count() == 5
    path = sinks.write_bronze(events(spark, 0, 9).withColumn("event_date", F.to_date(F.lit("2024-01-01"))), str(tmp_path / "b"), "v")
    assert raw.parquet_events(spark, path).count() == 9 and ingest.after(spark.read.parquet(path), 4).count() == 4
    report = tmp_path / "r.json"
    sinks.write_report(edges.agg(F.count("*").alias("n")), str(report))
    assert json.loads(report.read_text()) == {"n": 2}


def test_key_values_and_examples(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(25)], "key string, value string").repartition(3)
    folder = str(tmp_path / "sent")

    def put(pairs):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{k}={v}\n" for k, v in pairs)

    assert sinks.write_key_values(rows, put, batch=4) == 25
    sent = [x for f in (tmp_path / "sent").iterdir() for x in f.read_text().split()]
    assert sorted(sent) == sorted(f"k{i}=v{i}" for i in range(25))
    examples = spark.createDataFrame([(2, "1 2", 0.5), (1, "3", 0.25)], "example_id long, history string, score double")
    sinks.write_examples(examples, str(tmp_path / "x"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "x")).orderBy("example_id").collect()] == [("1", "3", "0.25000000"), ("2", "1 2", "0.50000000")]


def test_sessions(spark):
    e = spark.createDataFrame([(7, 0), (7, 1_799_000), (7, 5_000_000), (8, 0)], "user_id long, timestamp long")
    found = sorted((r.user_id, r.events) for r in stream.sessions(e).collect())
    assert found == [(7, 1), (7, 2), (8, 1)]


def test_stream_equals_batch(spark, tmp_path):
    both = spark.createDataFrame([(1_700_000_000_000 + t % 50 * 1000, t % 3, "view", t % 5, None) for t in range(120)], "timestamp long, visitorid long, event string, itemid long, transactionid string")
    source = str(tmp_path / "raw")
    both.filter("timestamp < 1700000030000").write.parquet(source)
    clean = lambda: stream.clean_stream(stream.raw_stream(spark, source, 1))
    for _ in range(2):
        stream.write_bronze_stream(clean(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        both.filter("timestamp >= 1700000030000").write.mode("append").parquet(source)
    stream.write_bronze_stream(clean(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == ingest.bronze(both).count()
    versions = []
    stream.publish_versions(stream.raw_stream(spark, source), str(tmp_path / "cp2"), lambda batch, v: versions.append((v, batch.count()))).awaitTermination()
    assert versions and versions[0][0] == "batch-00000000"
