"""Mixing sources to target weights by capped water-filling, in DataFrame expressions.

Sources share a total in proportion to their weights; a source whose share exceeds `epochs` times its size is
clamped there and the excess goes to the rest by weight, until none exceeds. With sources in order of
epochs * size / weight the clamped ones come first, so one ordered pass over the small table of sources finds the level.
A source at rate target/size takes every document floor(rate) times, and then documents in the seeded order of
md5(doc_id|seed) (of the text's md5 where doc_id is null) until the remaining words are taken; the last of them is taken in part, so taken words meet the
rounded target. The order is cut into 4096 buckets per source, summed first, so no source is ever one task's.

Edge cases: null text has size 0; null sources form one source, ordered last; a source without words has
target 0; an empty table gives an empty result; rows repeating a doc_id are separate documents; very long texts count, and are taken,
whole; further columns are ignored by mixture() and carried along by mixed_rows(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 8


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from (source, size): a row for each source. The ordered passes see sources, not documents."""
    out = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    out = out.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", epochs * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("total", share * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    out = out.withColumn("level", level).withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    top = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(everything)["level"]
    return out.select("source", "source_size", F.when(top.isNull(), F.col("cap")).otherwise(F.least("cap", top * F.col("w"))).alias("target"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, keep: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (times the document is taken whole), part (words taken once more), taken."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))), F.lit(f"|{seed}")))
    sized = (
        docs
        .select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), key.alias("key"),
            F.substring(key, 1, 3).alias("bucket"), *keep,
        )
    )
    goal = (
        targets(sized, weights, share, epochs)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )
    goal = (
        goal.withColumn("whole", F.floor("rate"))
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        sized.groupBy("source", "bucket")
        .agg(F.sum("size").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    sums = (
        sums.alias("s")
        .join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select("s.source", "s.bucket", "s.offset", "g.source_size", "g.target", "g.whole", "g.rest")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = (
        placed.alias("d")
        .join(sums.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.bucket") == F.col("t.bucket")))
    )
    out = out.select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.whole",
        F.greatest(F.lit(0).cast("long"), F.least("d.size", F.col("t.rest") - F.col("t.offset") - F.col("d.start"))).alias("part"),
        *[f"d.{c}" for c in keep],
    )
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs as the mixture takes them: a row for each whole repetition, and one with the first words of the part, if any."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    out = mixture(rows, keep=("_row",), **options).filter("taken > 0")
    whole_text = F.col("_row")["text"]
    piece = F.concat_ws(" ", F.slice(F.filter(F.split(whole_text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col("part").cast("int")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") + F.when(F.col("part") > 0, 0).otherwise(-1))))
    text = F.when((F.col("copy") == F.col("whole")) & (F.col("part") < F.col("size")), piece).otherwise(whole_text)
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || '|8') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER o, 0)) AS level FROM r
  WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE cap / w > level)), cap) AS target FROM l),
g AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
p AS (SELECT d.*, g.source_size, g.target, g.whole, CAST(round(g.target - g.whole * g.source_size) AS BIGINT) AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM p
"""
