"""Tables written once to the folder that all executors share, so that what reads them does not evaluate their plan again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own; a cluster is refused."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="amalgam-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/amalgam/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """The rows, written and read again, and the folder that holds them (for :func:`deleted`). Columns of no type become strings."""
    path = scratch_path(df.sparkSession, name)
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any longer."""
    for p in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
