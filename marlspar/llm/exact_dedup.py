"""Exact deduplication against a persistent digest index.

The index is a folder that outlives the session: Parquet bucketed and sorted by the digest, a partition
for each batch that was added. New rows are reduced to one row a digest (partial aggregation first, so
that a hot text costs one row a task), those digests meet the index in a sort-merge anti-join on its
bucket layout, and the unseen ones are appended as the batch's own partition. A batch that runs again
doesn't meet its own rows and replaces them, so a restarted job decides as the first run did. Texts never
pass that shuffle: only 32-byte digests and ids do. All DataFrame code.

A whole table is taken as two batches, the upper half of the ids first: the lower half then meets an index
that holds the largest id of every text it repeats.

Defined cases: a null text is an empty text; a null id stands below every other id; of rows that repeat
both id and text exactly one stays; an empty table gives no rows; texts of any length are hashed whole;
columns other than id and text are not read, and keep_first hands all of them on whatever their names.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed, narrow, scratch, stage, wrapped


def digest(text) -> F.Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased and every other character as it is."""
    return F.unhex(F.sha2(F.translate(text, string.ascii_uppercase, string.ascii_lowercase).cast("binary"), 256))


class DigestIndex:
    """Digests with the id that stands for each, one row a distinct text, in a folder.

    Folder: layout/ (generation, buckets; a row a generation, the last one counts) and digests-<generation>/
    batch=<name>/, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets: files a batch, of a new index; by default the session's shuffle partitions, so that it follows the data."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _layout(self) -> tuple[int, int] | None:
        files, path = _files(self.spark, f"{self.path}/layout/_SUCCESS")
        if not files.exists(path):
            return None
        found = self.spark.read.schema("generation int, buckets int").parquet(f"{self.path}/layout")
        return found.agg(F.max(F.struct("generation", "buckets"))).first()[0]

    def _note(self, generation: int) -> None:
        """From here on this generation counts."""
        self.spark.range(1).select(F.lit(generation).alias("generation"), F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("append").parquet(f"{self.path}/layout")

    def _table(self, generation: int, buckets: int) -> str:
        """The name under which this session knows a generation; its batches are looked up anew."""
        files, path = _files(self.spark, f"{self.path}/digests-{generation}")
        files.mkdirs(path)
        name = f"marlspar_index_{hashlib.md5(self.path.encode()).hexdigest()}_{generation}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/digests-{generation}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(name)
        return name

    def _current(self) -> tuple[str, int, int]:
        """(table, generation, buckets); makes an empty index where there is none."""
        found = self._layout()
        if found is None:
            self._note(0)
            found = 0, self.buckets
        return self._table(*found), *found

    def read(self) -> DataFrame:
        return self.spark.table(self._current()[0])

    def unseen(self, digests: DataFrame, batch: str) -> DataFrame:
        """Rows of `digests` (with a column digest) that the index lacks, the batch's own rows aside."""
        held = self.read().filter(F.col("batch") != batch).select("digest")
        return digests.join(held.hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Make (digest, keep_id) rows the batch's partition, a file a bucket, sorted within it."""
        name, generation, buckets = self._current()
        self._write(rows, batch, f"{self.path}/digests-{generation}", buckets, name)

    def _write(self, rows: DataFrame, batch: str, folder: str, buckets: int, name: str) -> None:
        out = rows.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(buckets, "digest")
        known = {x[0].partition("=")[2] for x in self.spark.sql(f"SHOW PARTITIONS {name}").collect()}
        if batch in known:
            self.spark.sql(f"ALTER TABLE {name} DROP PARTITION (batch = '{batch}')")
            _delete(self.spark, f"{folder}/batch={batch}")
        out.write.mode("append").insertInto(name)
        self.spark.catalog.refreshTable(name)

    def merge(self) -> None:
        """All batches as one, so that a bucket is one sorted file again: a new generation, which counts once
        it is whole. Afterwards batches added so far can't be run again."""
        name, generation, self.buckets = self._current()
        after = generation + 1
        _delete(self.spark, f"{self.path}/digests-{after}")
        self._write(self.spark.table(name), "merged", f"{self.path}/digests-{after}", self.buckets, self._table(after, self.buckets))
        self._note(after)
        self.spark.sql(f"DROP TABLE {name}")
        _delete(self.spark, f"{self.path}/digests-{generation}")

    def drop(self) -> None:
        _delete(self.spark, self.path)


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system, path)"""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _delete(spark: SparkSession, path: str) -> None:
    files, own = _files(spark, path)
    files.delete(own, True)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch (letters, digits, - and _ in its name) against `index` and within itself; append what is new.

    One row for each row of `docs`: doc_id, digest, keep_id, group_size (rows of this batch with the
    text), copy (from 1 among rows that repeat id and text), kept, seen (the text was indexed before;
    then keep_id is the indexed row's and no row of the batch stays). Within a batch the largest id stays.
    """
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a name for a batch: {batch!r}")
    hashed = narrow(docs, id_col, text_col).select("doc_id", digest(F.col("text")).alias("digest"))
    rows = stage(hashed.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
    groups = stage(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    fresh = stage(index.unseen(groups, batch).select("digest", "keep_id"), "fresh")  # before the append changes what the index holds
    index.append(fresh, batch)
    known = groups.select("digest", "group_size").join(index.read().hint("merge"), "digest")
    groups = stage(known.select("digest", "keep_id", "group_size", (F.col("batch") != batch).alias("seen")), "known")
    out = rows.join(groups.hint("merge"), "digest")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "digest", "keep_id", "group_size", "copy", (~F.col("seen") & (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "seen")


def deduplicate_table(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A whole table as two batches, larger ids first: doc_id, digest, keep_id, group_size (over both), copy, kept."""
    number = F.col(id_col).cast("long")
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("long")
    cut = docs.agg(F.min(number).cast("decimal(38,0)").alias("low"), F.max(number).cast("decimal(38,0)").alias("high")).select(middle.cast("long")).first()[0]
    upper = number >= F.lit(cut).cast("long")
    parts = [docs.filter(upper), docs.filter(~F.coalesce(upper, F.lit(False)))]
    done = [stage(deduplicate(part, index, name, id_col, text_col), name) for name, part in zip(("upper", "lower"), parts)]
    both = done[0].unionByName(done[1])
    again = done[1].filter("seen").groupBy("digest").agg(F.max("group_size").alias("lower_size"))
    first = done[0].groupBy("digest").agg(F.max("group_size").alias("upper_size"))
    sizes = again.join(first, "digest").select("digest", (F.col("lower_size") + F.col("upper_size")).alias("whole"))
    out = both.join(sizes.hint("merge"), "digest", "left")
    return out.select("doc_id", "digest", "keep_id", F.coalesce("whole", "group_size").alias("group_size"), "copy", "kept")


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; what goes is known by id and digest."""
    found = deduplicate_table(docs, index, id_col, text_col).select("doc_id", "digest", "kept", "copy")
    found = stage(found.filter("NOT kept"), "gone")
    own = wrapped(docs, F.col(id_col).cast("long").alias("doc_id"), digest(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"))
    clear, doubtful = listed(own, found, "doc_id", "digest")
    gone = found.groupBy("doc_id", "digest").agg(F.min("copy").alias("first_copy"))  # from 2 on: one row stays
    same = doubtful["doc_id"].eqNullSafe(gone["doc_id"]) & (doubtful["digest"] == gone["digest"])
    met = doubtful.join(gone.hint("merge"), same, "left").select("row", doubtful["doc_id"], doubtful["digest"], "first_copy").filter("first_copy IS NULL OR first_copy > 1")
    once = met.filter("first_copy > 1").dropDuplicates(["doc_id", "digest"])
    return clear.select("row.*").union(met.filter("first_copy IS NULL").select("row.*")).union(once.select("row.*"))


def temporary_index(spark: SparkSession) -> DigestIndex:
    """An index in the shared folder, for one run over a whole table."""
    return DigestIndex(spark, scratch(spark, "index"))


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = deduplicate_table(docs, temporary_index(spark))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
