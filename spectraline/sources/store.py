"""A store of pixel data that is read back without an exchange: region partitions, pixel buckets, an axis, labels and a mode.

A store is four tables of one name in the catalog, their files in the shared folder: <name>_values (region, y, x, channel, value), partitioned by region and, in each,
bucketed and sorted by pixel; <name>_axis (channel, lo, hi, mz); <name>_labels (region, y, x, class, weight), partitioned and bucketed
alike; <name>_mode (mode, buckets). So grouping by pixel, joins of pixels with their labels and windows inside a pixel take the rows where
they lie, a region is a folder that a filter on it prunes, and a binned or normalised copy keeps what belongs to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraline.operators import binning
from spectraline.sources import sinks

#: Of the values: channels in common, or peaks with an m/z of their own (channel numbers the peaks of a pixel).
MODES = ("continuous", "processed")
#: Rows of bins or of an axis that are sent to every task, about 50 MB; more are joined by shuffles.
MOST = 1_000_000
PIXEL = ["region", "y", "x"]


@dataclass
class Store:
    values: DataFrame
    axis: DataFrame
    labels: DataFrame
    mode: str
    buckets: int


def write(spark: SparkSession, name: str, values: DataFrame, axis: DataFrame, labels: DataFrame, mode: str, buckets: int = 64) -> Store:
    """Write the four tables, failing where one is there already, and open them. Labels without values and values without labels are kept."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode}")
    root = f"{sinks.shared_root(spark)}/stores"
    fine = values.select(*PIXEL, "channel", "value", *(["mz"] if mode == "processed" else []))
    for table, rows, order in ((f"{name}_values", fine, ["y", "x", "channel"]), (f"{name}_labels", labels.select(*PIXEL, "class", "weight"), ["y", "x"])):
        # one task a bucket writes all of it, so a bucket is one file of each region
        spread = rows.repartition(buckets, "y", "x")
        spread.write.mode("errorifexists").partitionBy("region").bucketBy(buckets, "y", "x").sortBy(*order).option("path", f"{root}/{table}").format("parquet").saveAsTable(table)
    axis.select("channel", "lo", "hi", "mz").coalesce(1).write.mode("errorifexists").option("path", f"{root}/{name}_axis").saveAsTable(f"{name}_axis")
    spark.createDataFrame([(mode, buckets)], "mode string, buckets int").write.mode("errorifexists").option("path", f"{root}/{name}_mode").saveAsTable(f"{name}_mode")
    return opened(spark, name)


def opened(spark: SparkSession, name: str) -> Store:
    mode, buckets = spark.table(f"{name}_mode").first()
    return Store(spark.table(f"{name}_values"), spark.table(f"{name}_axis"), spark.table(f"{name}_labels"), mode, buckets)


def dropped(spark: SparkSession, name: str) -> None:
    for part in ("values", "axis", "labels", "mode"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def few(rows: DataFrame) -> bool:
    return rows.limit(MOST + 1).count() <= MOST


def binned(store: Store, bins: DataFrame) -> DataFrame:
    """region, y, x, channel, value: sums of a store's values in bins (bin_idx, lo, hi), on the m/z of the axis or of the peaks; values are exchanged only if there are more than MOST bins or channels."""
    rows = store.values
    if store.mode == "continuous":
        axis = store.axis.select("channel", "mz")
        rows = rows.join(F.broadcast(axis) if few(axis) else axis, "channel")
    met = binning.range_join(rows.select(*PIXEL, "mz", "value"), bins, small=few(bins))
    return met.groupBy(*PIXEL, F.col("bin_idx").alias("channel")).agg(F.sum("value").alias("value"))


def normalised(store: Store, by: str = "tic") -> DataFrame:
    """The store's values over their pixel's sum (tic), maximum (max) or Euclidean norm (vect); a pixel without any is left out, as its norm is 0."""
    norm = {"tic": F.sum("value"), "max": F.max("value"), "vect": F.sqrt(F.sum(F.col("value") * F.col("value")))}[by]
    norms = store.values.groupBy(*PIXEL).agg(norm.alias("_norm")).filter("_norm <> 0")
    return store.values.join(norms, PIXEL).withColumn("value", F.col("value") / F.col("_norm")).drop("_norm")


def labelled(store: Store) -> DataFrame:
    """Values with the class and weight of their pixels; pixels without a label are left out."""
    return store.values.join(store.labels, PIXEL)
