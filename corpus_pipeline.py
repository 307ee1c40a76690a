"""A training corpus from raw documents, in five stages.

Each stage takes what the one before kept and returns rows with the columns of documents, the last one
the layout of packed sequences. Ids may repeat or be null: rows are known by id and text, and exact
deduplication has left no two rows of one text. A null text is an empty one, of which one row stays; an
empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspar.llm import exact_dedup, importance, near_dup, packing, secret_scan
from marlspar.llm.common import documents, listed, stage, wrapped

#: Some stages are not expressible in SQL (hashed models, samples of weighted sets, tokenizers).
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents outside the importance resample go."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=True).filter("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts the largest id stays."""
    return exact_dedup.keep_first(docs, exact_dedup.temporary_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each near-duplicate class one row stays, of the least id; rows are known by id and text."""
    found = near_dup.near_duplicates(docs, keyed=True).filter("NOT kept").select("doc_id", "key").distinct()
    gone = stage(found, "gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clear, doubtful = listed(wrapped(docs, F.col("doc_id").cast("long").alias("doc_id"), near_dup.text_key(text).alias("key")), gone, "doc_id", "key")
    same = doubtful["doc_id"].eqNullSafe(gone["doc_id"]) & (doubtful["key"] == gone["key"])
    return clear.select("row.*").union(doubtful.join(gone.hint("merge"), same, "left_anti").select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are replaced in the texts; n_chars follows."""
    cleaned = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the layout of the packed sequences."""
    return packing.op4(spark, docs, kept=150_000)  # executors still hold the memory of the stages before


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dup", near), ("secrets", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
