"""Sequence packing: shortest-pack-first over the length histogram.

Documents are encoded and cut into pieces of at most 4096 ids; pieces are staged in the shared folder.
Only the histogram (one count a length) reaches the driver, where lengths go longest first, each into
the packs with the most room, whole groups of equal packs at a time. The patterns so found are joined
back by rank: a piece's rank among those of its length is a salted count plus a row number, with as many
salts as keep each part of the most common length small, so no length, however common, meets in one task.

Defined cases: a null text is empty, and an empty text is the end id alone; null ids are kept and rank
first; repeated rows are packed once each; an empty table gives no rows; texts of any length are cut
whole; columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, narrow, stage
from .encoding import MOST, encoder, groups

#: Pieces of one length whose ranks are counted in one task, about.
RANKED = 20_000


def _cut(tokenizer: str, end_id: int, most: int, kept: int, ids_too: bool):
    def run(batches):
        enc = encoder(tokenizer, False, kept)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            ids = batch["doc_id"].to_pylist()
            texts = batch["text"].to_pylist()
            at = 0
            for group in groups(texts):
                for x in enc.encode(group):
                    tokens = np.concatenate([np.frombuffer(x, enc.dtype).astype("<u4"), end])
                    for start in range(0, len(tokens), most):
                        piece = tokens[start : start + most]
                        rows.append((ids[at], start, len(piece), zlib.crc32(piece.tobytes()), len(tokens), *([piece.astype(enc.dtype).tobytes()] if ids_too else [])))
                    at += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids_too else [])]
            kinds = [pa.binary() if x == "ids" else pa.int64() for x in names]
            yield pa.RecordBatch.from_arrays([*map(pa.array, [*zip(*rows)] or [()] * len(names), kinds)], names)

    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, most: int = 4096, id_col: str = "doc_id", text_col: str = "text", kept: int = MOST, ids_too: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, with ids_too, ids (binary, little-endian, 2 bytes an id if the vocabulary allows)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if ids_too else "")
    return map_batches(narrow(docs, id_col, text_col), _cut(tokenizer, end_id, most, kept, ids_too), schema)


def patterns(histogram: dict[int, int], most: int = 4096) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, copies), ...]) of packs that hold every length as often as the histogram has it."""
    packs: list[tuple[int, int, int, list]] = []  # (-room, order, count, pattern)
    order = 0

    def push(room: int, count: int, pattern: list) -> None:
        nonlocal order
        order += 1
        heapq.heappush(packs, (-room, order, count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not packs or -packs[0][0] < length:
                each = most // length
                full, rest = divmod(left, each)
                if full:
                    push(most - each * length, full, [(length, each)])
                if rest:
                    push(most - rest * length, 1, [(length, rest)])
                break
            room, _, count, pattern = heapq.heappop(packs)
            room = -room
            other = -packs[0][0] if packs else -1
            take = min(count, left)
            copies = max(1, min(room // length, left // count, (room - other) // length + 1)) if take == count else 1
            if take < count:
                push(room, count - take, pattern)
            push(room - copies * length, take, [*pattern, (length, copies)])
            left -= take * copies
    return [(count, pattern) for _, _, count, pattern in sorted(packs, key=lambda x: x[1])]


def _slots(found, most: int):
    """By length: first rank, copies, first sequence and first offset of each place, in rank order."""
    table: list[list[tuple]] = [[] for _ in range(most + 1)]
    ranks = np.zeros(most + 1, np.int64)
    sequence = 0
    for count, pattern in found:
        offset = 0
        for length, copies in pattern:
            table[length].append((ranks[length], copies, sequence, offset))
            ranks[length] += count * copies
            offset += length * copies
        sequence += count
    return [np.array(x, np.int64).reshape(-1, 4) for x in table]


def _place(slots):
    def run(batches):
        for batch in batches:
            length, rank = (batch[x].to_numpy() for x in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                place = slots[own]
                found = place[np.searchsorted(place[:, 0], rank[at], "right") - 1]
                pack, copy = np.divmod(rank[at] - found[:, 0], found[:, 1])
                sequence[at], offset[at] = found[:, 2] + pack, found[:, 3] + copy * own
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, most: int = 4096) -> DataFrame:
    """The layout of staged pieces: their columns but ids, with sequence_id and offset."""
    histogram = {x["length"]: x["count"] for x in pieces.groupBy("length").count().collect()}  # `most` rows at most
    slots = _slots(patterns(histogram, most), most)
    salts = -(-max(histogram.values(), default=1) // RANKED)
    salted = pieces.drop("ids").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()  # a row for each part of a length
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("nth", F.row_number().over(own)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return map_batches(ranked, _place(slots), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def assemble(pieces: DataFrame, layout: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary: the pieces' ids by offset), segments (document and length)."""
    own = pieces.select(F.col("doc_id").alias("own_id"), F.col("start").alias("own_start"), F.col("ids_crc32").alias("own_crc"), "ids").dropDuplicates()
    both = layout.join(own, layout["doc_id"].eqNullSafe(own["own_id"]) & (layout["start"] == own["own_start"]) & (layout["ids_crc32"] == own["own_crc"]))
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"], x["length"])).alias("segments"))


def op4(spark: SparkSession, docs: DataFrame, kept: int = MOST) -> DataFrame:
    """kept: chunks that a worker keeps with their ids; fewer take less memory and more time."""
    import public_tokenizers

    return pack(stage(cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=kept, ids_too=False), "pieces"))
