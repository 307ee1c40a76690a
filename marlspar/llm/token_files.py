"""Token-id output: flat unsigned integer files with 64-bit document offsets, read back memory-mapped.

Documents are range-partitioned and sorted by id; each partition is encoded and written as one shard
(ids, document ids, lengths). A shard's base is the prefix sum of the shards before it; a second pass
writes every shard's global offsets. All files lie in the shared folder and take their final names by
an atomic move, so that a task that runs twice leaves the same files.

Files of shard k: tokens-k.bin (uint16, or uint32 if the vocabulary needs it), docs-k.bin (int64),
offsets-k.bin (int64, one more than documents: global positions), and manifest.json for all.

Defined cases: a null text is empty, and an empty text is the end id alone; a null id stands first and
is kept as the least int64; equal ids stand in the order of a hash of the text, then of the text, so that
an id (or null) that very many rows share is dealt over many shards; an empty table gives no shards; texts
of any length are encoded whole; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, narrow, scratch
from .encoding import encoder

NULL_ID = np.iinfo(np.int64).min


def _open(directory: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(directory)


def _put(system: fs.FileSystem, path: str, arrays) -> None:
    """Write to a name of this attempt's own, then move."""
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(own) as out:
        for x in arrays:
            out.write(x)
    system.move(own, path)


class _Ranges:
    """A flat file read through the file system's own client, only where it is sliced."""

    def __init__(self, system: fs.FileSystem, path: str, dtype, size: int):
        self.file, self.dtype, self.length = system.open_input_file(path), np.dtype(dtype), size // np.dtype(dtype).itemsize

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> np.ndarray:
        first, last, _ = part.indices(self.length)
        self.file.seek(first * self.dtype.itemsize)
        return np.frombuffer(self.file.read_buffer(max(last - first, 0) * self.dtype.itemsize), self.dtype)


def _get(system: fs.FileSystem, path: str, dtype):
    """What a file holds, by slices: memory-mapped where the folder is mounted, else ranges of it."""
    size = system.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    return np.memmap(path, dtype, "r") if isinstance(system, fs.LocalFileSystem) else _Ranges(system, path, dtype, size)


def _write_shards(directory: str, tokenizer: str, byte_level: bool, end_id: int):
    def run(batches):
        enc, shard = encoder(tokenizer, byte_level), TaskContext.get().partitionId()
        system, root = _open(directory)
        ids, lengths = [], []

        def tokens():
            for batch in batches:
                ids.append(batch["doc_id"].fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                for made, counts in enc.encode_column(batch["text"]):
                    lengths.append(counts + 1)
                    yield np.insert(made, np.cumsum(counts), end_id).tobytes()

        _put(system, f"{root}/tokens-{shard:06d}.bin", tokens())
        if lengths:
            _put(system, f"{root}/docs-{shard:06d}.bin", [np.concatenate(ids).astype("<i8").tobytes()])
            counts = np.concatenate(lengths).astype("<i8")
            _put(system, f"{root}/lengths-{shard:06d}.bin", [counts.tobytes()])
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": len(counts), "n_tokens": int(counts.sum())}], pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        else:
            system.delete_file(f"{root}/tokens-{shard:06d}.bin")

    return run


def _write_offsets(directory: str):
    def run(batches):
        system, root = _open(directory)
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _get(system, f"{root}/lengths-{row['shard']:06d}.bin", "<i8")[:]
                _put(system, f"{root}/offsets-{row['shard']:06d}.bin", [(row["base"] + np.concatenate([[0], np.cumsum(lengths)])).astype("<i8").tobytes()])
            yield batch.select(["shard"])

    return run


def _read_shards(directory: str, dtype: str, block: int = 4096):
    def run(batches):
        system, root = _open(directory)
        for shard in (x for batch in batches for x in batch["shard"].to_pylist()):
            tokens, docs, at = (_get(system, f"{root}/{name}-{shard:06d}.bin", kind) for name, kind in (("tokens", dtype), ("docs", "<i8"), ("offsets", "<i8")))
            base = int(at[:1][0]) if len(at) else 0
            for first in range(0, len(docs), block):
                ends = at[first : first + block + 1]
                local = ends - base
                crcs = [zlib.crc32(tokens[int(a) : int(b)].astype("<u4").tobytes()) for a, b in zip(local[:-1], local[1:])]
                own = np.array(docs[first : first + block])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(np.array(ends[:-1]), pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, directory: str, tokenizer: str, end_id: int, byte_level: bool = True, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the files of `docs` to `directory` (a URI that all executors reach); the manifest."""
    spark = docs.sparkSession
    system, root = _open(directory)
    system.create_dir(root, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = narrow(docs, id_col, text_col).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    found = sorted(map(tuple, map_batches(ordered, _write_shards(directory, tokenizer, byte_level, end_id), "shard int, n_docs long, n_tokens long").collect()))
    bases = [0, *accumulate(x[2] for x in found)]
    shards = [{"shard": s, "n_docs": d, "n_tokens": t, "base": b} for (s, d, t), b in zip(found, bases)]
    if shards:
        map_batches(_rows(spark, shards), _write_offsets(directory), "shard int").count()
    manifest = {"dtype": encoder(tokenizer, byte_level).dtype.str, "end_id": end_id, "n_tokens": bases[-1], "shards": shards}
    _put(system, f"{root}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def _rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """A task a few shards; one row a shard, so that many tasks can share them."""
    schema = "shard int, base long"
    rows = [(x["shard"], x["base"]) for x in shards]
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "shard")


def read_tokens(spark: SparkSession, directory: str) -> DataFrame:
    """One row a document from the files: doc_id, start (global), n_tokens, ids_crc32 (over 32-bit ids)."""
    system, root = _open(directory)
    with system.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    return map_batches(_rows(spark, manifest["shards"]), _read_shards(directory, manifest["dtype"]), schema)


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    directory = scratch(spark, "tokens")
    write_tokens(docs, directory, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, directory)
