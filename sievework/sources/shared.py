"""Tables between the steps of a query, in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The driver's garbage is collected before a step at most so often; short steps leave little behind.
GC_SECONDS = 3
_collected = 0.0


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores after it until no column is called so (case doesn't tell columns apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    name = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(name) or spark.conf.get(name, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{name} must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set(name, found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps survive a lost executor and don't redo the work."""
    global _collected
    spark = df.sparkSession
    if time.monotonic() - _collected > GC_SECONDS:
        gc.collect()
        spark._jvm.System.gc()  # Spark deletes shuffle files of earlier steps when their plans are collected as garbage
        _collected = time.monotonic()
    path = f"{shared_folder(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, key: str, count: int, name: str) -> DataFrame:
    """materialise(), in `count` buckets by the key: a join on it doesn't deal these rows anew. Only files stay, no table."""
    spark, id_ = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/sievework/{id_}"
    df.write.bucketBy(count, key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(id_)
    stored = spark.table(id_)
    spark.sql(f"DROP TABLE {id_}")  # the files aren't its own, and the frame knows them
    return stored


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote for this frame; only for frames that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/sievework/" in str(path.toString()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
