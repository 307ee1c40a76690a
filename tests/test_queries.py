"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from marlspar.plans import catalogue, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.7g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))


# Queries that differ from another one only in the last projection are left to the driver's check.
SKIPPED = """bpr_loss listwise_loss positive_weight listwise_groups enriched_test_groups cooccurrence_pairs metrics_hybrid relative_lift candidate_features_v1
source_contribution source_flags prior_score_bce serve_features serve_challenger serve_cold_start metrics_prior_ranker category_source session_source candidate_features cooccurrence_scores""".split()
NAMES = [n for n in oracle.SQL if n not in SKIPPED]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF).toPandas()
    expected = duck.sql(oracle.SQL[name]).df()
    spark.catalog.clearCache()
    assert sorted(out.columns) == sorted(expected.columns)
    assert normal(out) == normal(expected)


def test_all_are_registered():
    assert set(oracle.SQL) <= set(catalogue.QUERIES)
