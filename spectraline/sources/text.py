"""Delimited lines, commented tables, lipid windows and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniff(line: str) -> str:
    """The separator that splits a line most often."""
    return max((",", ";", "\t", "|"), key=line.count)


def parse_lines(lines: DataFrame, schema: str, sep: str | None = None) -> DataFrame:
    """Columns of the lines in `value`; without sep it is read off the first line."""
    if sep is None:
        first = lines.first()
        sep = sniff(first.value) if first else ","
    fields = T.StructType.fromDDL(schema).fields
    parts = F.split("value", "\\" + sep)
    return lines.select(*[F.get(parts, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def drop_comments(lines: DataFrame) -> DataFrame:
    """Lines that do not begin with #; a # further on is data."""
    return lines.filter(~F.col("value").startswith("#"))


def scan_lipids(spark: SparkSession, path: str) -> DataFrame:
    """idx, mz, width, name of a lipid table with a header line and any separator; idx is 0, 1, ... in the order of lines.

    Lines are numbered inside their split and lifted by the counts of the splits before, a row for each split.
    """
    sep = sniff(spark.read.text(path).first().value)
    rows = spark.read.option("sep", sep).option("header", True).schema("mz double, width double, name string").csv(path)
    number = F.monotonically_increasing_id()
    rows = rows.withColumns({"_split": F.shiftright(number, 33), "_at": number.bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_split").agg(F.count("*").alias("_n")).select("_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, "_split").select((F.col("_first") + F.col("_at")).alias("idx"), "mz", "width", "name")


def lipid_window(lipids: DataFrame, which: Column) -> DataFrame:
    """name, lo, hi: half the width to either side; anything but one match is an error."""
    found = lipids.filter(which)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError("no such lipid" if n == 0 else "several lipids match")
    return found.select("name", (F.col("mz") - 0.5 * F.col("width")).alias("lo"), (F.col("mz") + 0.5 * F.col("width")).alias("hi"))


def scan_commented(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    """Columns of delimited files without a header whose comment lines begin with #."""
    return parse_lines(drop_comments(spark.read.text(path)), schema, sep)


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of run logs with what their file's name says: problem, normalization, grouped, line.

    A name is <problem>_no_norm or <problem>_norm_<kind>, then _gcv.log (grouped folds) or _cv.log; _p and _n in a problem stand for + and -. The logs may
    also be folders of that name (a partition column `file`), as Spark writes them.
    """
    lines = spark.read.text(path)
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    # Fixed value: the form of the files' names.
    name = r"^(.*?)(?:_no_norm|_norm_(.+?))_(g?)cv\.log$"
    part = lambda i: F.regexp_extract("file", name, i)
    known = lines.filter(F.col("file").rlike(name))
    return (
        known
        .select(
            F.replace(F.replace(part(1), F.lit("_p"), F.lit("+")), F.lit("_n"), F.lit("-")).alias("problem"), F.when(part(2) == "", "none").otherwise(part(2)).alias("normalization"),
            (part(3) == "g").alias("grouped"), F.col("value").alias("line"),
        )
    )


def run_scores(logs: DataFrame) -> DataFrame:
    """problem, normalization, grouped, score (mean over folds), max_occ (share of the most frequent class) of each run."""
    listed = F.split(F.regexp_extract("line", r"\[root\] \[INFO\] : scores: \[(.*)\]", 1), r"\s+")
    scores = F.transform(F.filter(listed, lambda x: x != ""), lambda x: x.cast("double"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    occ = F.nullif(F.regexp_extract("line", r"\[root\] \[INFO\] : max rel\. occurrence = (0\.\d+)", 1), F.lit("")).cast("double")
    rows = logs.select("problem", "normalization", "grouped", total.alias("total"), F.size(scores).alias("n"), occ.alias("occ"))
    return (
        rows.groupBy("problem", "normalization", "grouped")
        .agg((F.sum("total") / F.sum("n")).alias("score"), F.max("occ").alias("max_occ"))
    )


def run_importances(logs: DataFrame) -> DataFrame:
    """problem, normalization, grouped, id, name, importance from the lines `<id> ( <name> ) : <number>` of runs."""
    # Fixed value: the form of the lines.
    pattern = r"\[root\] \[INFO\] :\s+(\d+) \(\s*(.*?)\s*\) :\s+(\d+\.\d+)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return (
        logs.filter(F.col("line").rlike(pattern))
        .select("problem", "normalization", "grouped", part(1).cast("int").alias("id"), part(2).alias("name"), part(3).cast("double").alias("importance"))
    )


def load_mask(spark: SparkSession, path: str) -> DataFrame:
    """name, y, x, on_ of greyscale images: whether a pixel is above half of its image's brightest one."""
    image = spark.read.format("image").load(path).select("image.*")
    at = F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("data"), F.col("nChannels")),
        lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int"),
    ))
    pixel = image.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "width", at.alias("i", "v"))
    top = pixel.groupBy("name").agg(F.max("v").alias("top"))
    return (
        pixel.join(top, "name")
        .select("name", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).alias("x"), (F.col("v") > F.col("top") / 2).alias("on_"))
    )
