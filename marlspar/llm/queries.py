"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, importance, license_scan, media, near_dup, packing, secret_scan, token_counts, token_files
from .common import documents

QUERIES = {
    "op1_license_scan": lambda spark, d: license_scan.op1(documents(spark, d)),
    "op2_media_columns": lambda spark, d: media.op2(documents(spark, d)),
    "op3_near_dup": lambda spark, d: near_dup.op3(documents(spark, d)),
    "op4_packing": lambda spark, d: packing.op4(spark, documents(spark, d)),
    "op5_exact_dedup": lambda spark, d: exact_dedup.op5(spark, documents(spark, d)),
    "op6_token_files": lambda spark, d: token_files.op6(spark, documents(spark, d)),
    "op7_secret_scan": lambda spark, d: secret_scan.op7(documents(spark, d)),
    "op8_byte_bpe": lambda spark, d: bpe.op8(documents(spark, d)),
    "op9_token_counts": lambda spark, d: token_counts.op9(documents(spark, d)),
    "op10_quality_classifier": lambda spark, d: importance.op10(spark, documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
}
SQL = {"op5_exact_dedup": exact_dedup.ORACLE, "op7_secret_scan": secret_scan.oracle()}
