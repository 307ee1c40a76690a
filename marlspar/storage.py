"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or (unset, as in local tests) a temporary one for this context."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(context, "_marlspar_shared", None) or "file://" + tempfile.mkdtemp(prefix="marlspar-")
        context._marlspar_shared = found
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/marlspar-{label}-{uuid.uuid4().hex}"


#: Paths staged inside passing().
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)
# What a write shuffled goes with it, and joins on (g, ctx, item) stay where rows already are by (g, ctx).
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}

# A union takes its parts' columns for others where inferred filters have made them not null, and forgets their buckets.
_BUCKETS = {"spark.sql.constraintPropagation.enabled": "false"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, label: str, keep: bool = False, by: tuple[str, ...] = (), buckets: int = 0) -> DataFrame:
    """Write to the shared folder and read back: plans stay small, nothing is computed twice, and what is
    written outlives lost executors. keep: passing() around it leaves it there. buckets: rows lie in so many
    buckets by `by`, so that what is staged alike is joined and grouped by these columns without a shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    if not keep and (made := _PASSING.get()) is not None:
        made.append(path)
    with _settings(spark, _STAGING | (_BUCKETS if buckets else {})):
        if not buckets:
            df.write.option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        name = path.rpartition("/")[2].replace("-", "_")
        df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).options(compression="zstd", path=path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; files stay, and `found` knows them
    return found


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """Inside, a join broadcasts what a hint names or what adaptive execution has seen the rows' bytes of, never what is
    only small as a file: sorted columns take a byte a row or two there, and a hundred in the driver."""
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or own
    with _settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": seen}):
        yield


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside, but for what is kept. Only for steps whose result is kept."""
    token = _PASSING.set(made := [])
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
