"""What several operators share: table paths, shared storage, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only where a local session has none is a temporary folder set; elsewhere its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, partitioned_by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    out = df.write.mode("error").option("compression", "zstd")
    (out.partitionBy(*partitioned_by) if partitioned_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partitioned_by else spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later step reads."""
    spark = df.sparkSession
    base = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in path and path.split("/table-")[0].split(":")[-1].rstrip("/").endswith(base.split(":")[-1].lstrip("/")):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, array_col: str, entries: int) -> DataFrame:
    """``df`` marked for broadcast if all its arrays together have at most so many entries; else as it is."""
    total = df.agg(F.sum(F.size(array_col) + 1)).first()[0] or 0
    return F.broadcast(df) if total <= entries else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix); wraps silently."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
