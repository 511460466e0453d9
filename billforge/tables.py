"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master, whose tasks share this machine's disk, may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append("file://" + tempfile.mkdtemp(prefix="billforge-"))
    return _local_root[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written in the shared folder and read back: later steps see the same rows, and lost executors cost no earlier work."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for df in tables:
        if path := getattr(df, "_written_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
