"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, local runs) is a folder of our own used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` the rows are computed a single time, the copy is
    columnar with known size (so later joins choose well) and it outlives lost
    executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cadastra_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialise` that no plan reads any more."""
    path = getattr(df, "_cadastra_path", None)
    if path is None:
        return
    sc = df.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def stream_partitions(spark: SparkSession):
    """State partitions for a stream started inside: the cluster's cores, unless chosen by the user.

    A stream keeps the number it starts with and is not coalesced at run time, so the
    general default of 200 fits neither a small session nor a large cluster.
    """
    key, default = "spark.sql.shuffle.partitions", "200"
    before = spark.conf.get(key)
    if before == default:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pin(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns (SQL text) that are computed once and then only referred to.

    Filters and projections above do not copy the expressions back down, which
    would otherwise repeat costly ones (JSON parsing, regular expressions) once per
    reference.
    """
    fields = ", ".join(f"'{name}', {text}" for name, text in columns.items())
    return df.selectExpr("*", f"inline(array(named_struct({fields})))")
