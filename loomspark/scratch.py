"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; a private one only where none is set and all is one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loom-')}"
        spark.conf.set("loomspark.scratch", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage (a lost executor costs one stage, not the whole plan), forgets the
    output partitioning, so that later joins plan exchanges which AQE can split when a key
    is hot, and lets Spark drop the shuffle files of what came before.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/loom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_loom_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of finished, unreferenced plans."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
