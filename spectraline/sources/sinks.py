"""Tables written to the folder all executors share and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(df: DataFrame) -> str:
    return f"{shared_root(df.sparkSession)}/sink-{uuid.uuid4().hex}"


def swept(spark: SparkSession, path: str) -> None:
    """Have the file system of a path that exists delete it when the application ends; until then a frame may read it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one if one machine runs all; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spectraline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its plan; the table goes when the application ends."""
    path = place(df)
    out = written(df, path=path)
    swept(df.sparkSession, path)
    return out


def written(df: DataFrame, kind: str = "parquet", path: str | None = None) -> DataFrame:
    """Write df, failing where something is already, and read it again."""
    path = path or place(df)
    out = df.write.mode("errorifexists")
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)
    read = df.sparkSession.read.schema(df.schema)
    return (read.option("header", True) if kind == "csv" else read).format(kind).load(path)


def replaced(old: DataFrame, new: DataFrame, by: list[str], path: str | None = None) -> DataFrame:
    """A table partitioned by `by` in which the partitions that new holds take the place of old's."""
    path = path or place(old)
    old.write.partitionBy(*by).parquet(path)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return old.sparkSession.read.schema(old.schema).parquet(path)
