"""What the corpus operators share: narrow inputs, the shared folder, Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import scratch, shared_dir, stage  # noqa: F401  (the operators take them from here)

#: Rows in one Arrow batch sent to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 1000


#: Slots of the filter that listed() broadcasts: at most so many whole numbers, whatever the data.
SLOTS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = False) -> DataFrame:
    """(doc_id, text) alone, so that no other column of `docs` can clash; a null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over bounded slices of the batches, however many rows the session puts into one."""
    ship(df.sparkSession)

    def bounded(batches):
        return function(batch.slice(first, BATCH_ROWS) for batch in batches for first in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(bounded, schema)


def wrapped(docs: DataFrame, *columns) -> DataFrame:
    """docs with each row in one struct column `row`, so that none of its names can clash; row.* gives it back."""
    return docs.select(F.struct("*").alias("row"), *columns)


def listed(keyed: DataFrame, table: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `keyed` whose key surely isn't in `table`, rows whose key may be). Keys are hashed to SLOTS
    slots, and the slots that the table takes are broadcast: a bounded filter at every size of the table. Only
    rows of the second kind need meet the table itself, in a merge join, and so only they pass a shuffle."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    taken = F.broadcast(stage(table.select(slot.alias("slot")).distinct(), "slots"))
    own = keyed.withColumn("slot", slot)
    return tuple(own.join(taken, "slot", how).drop("slot") for how in ("left_anti", "left_semi"))


def lean(function):
    """function for map_batches in a worker that has dropped the tokenizers' tables of earlier tasks and
    hands its own memory back in the end."""

    def run(batches):
        from .encoding import release, trim

        release()
        yield from function(batches)
        trim()

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a binary Arrow column, without a copy of the bytes."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (first, last) of documents of about `most` bytes together, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)
