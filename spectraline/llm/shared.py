"""Tables that cut a plan: written once to the folder all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and one machine runs all (tests) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spectraline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a frame that reads it.

    A lost executor then costs only the tasks it ran: nothing before the written table is run again. The table goes when the application ends, as
    frames that read it may be used until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spectraline-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
