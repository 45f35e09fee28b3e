"""Intensity-weighted Gaussian mixtures over m/z: densities, likelihoods, posteriors and weighted EM."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraline.sources import sinks

FLOOR = 1e-6


def density(value: Column, mu: Column, lv: Column) -> Column:
    return F.exp(-0.5 * (value - mu) ** 2 / F.exp(lv)) / F.sqrt(2 * math.pi * F.exp(lv))


def equispaced(spark: SparkSession, lo: float, hi: float, k: int, heads: tuple = ("n", "p")) -> DataFrame:
    """head, comp_idx, pi, mu, lv: means spread evenly (the middle if one), widths (hi - lo) / 2k, equal weights."""
    mu = F.lit((lo + hi) / 2) if k == 1 else lo + F.col("id") * ((hi - lo) / (k - 1))
    rows = (
        spark.range(k)
        .select(
            F.explode(F.array(*[F.lit(h) for h in heads])).alias("head"), F.col("id").alias("comp_idx"),
            F.lit(1.0 / k).alias("pi"), mu.cast("double").alias("mu"), F.lit(2 * math.log((hi - lo) / (2 * k))).alias("lv"),
        )
    )
    return rows


def mixture_prob(values: DataFrame, components: DataFrame, value: str = "mz", block: int = 64) -> DataFrame:
    """values for each head, with p = sum of pi * N(value; mu, exp(lv)).

    Components are parameters of the model and reach the driver. They become one plain expression, which Spark compiles; of many
    components, blocks of terms are added one after another, so that no generated method grows too large.
    """
    found: dict[str, list] = {}
    for c in components.orderBy("head", "comp_idx").collect():
        found.setdefault(c.head, []).append((c.pi / math.sqrt(2 * math.pi * math.exp(c.lv)), c.mu, -0.5 / math.exp(c.lv)))
    out = values.withColumn("head", F.explode(F.array(*[F.lit(h) for h in found]))).withColumn("p", F.lit(0.0))
    for at in range(0, max(map(len, found.values()), default=0), block):
        total = F.lit(0.0)
        for h, terms in found.items():
            part = F.lit(0.0)
            for a, mu, b in terms[at : at + block]:
                d = F.col(value) - mu
                part = part + a * F.exp(b * d * d)
            total = F.when(F.col("head") == h, part).otherwise(total)
        out = out.withColumn("p", F.col("p") + total)
    return out


def nll(p: Column) -> Column:
    return -F.ln(FLOOR + p)


def masses(peaks: DataFrame, heads: list[str]) -> DataFrame:
    """mz, weights: each mass once, with the summed intensity of every head (null if it has no peak there), from peaks (head, mz, intensity).

    A weighted fit needs no more than this table, which has as many rows as masses that differ.
    """
    of = [F.sum(F.when(F.col("head") == h, F.col("intensity"))) for h in heads]
    return peaks.filter("mz is not null").groupBy("mz").agg(F.array(*of).cast("array<double>").alias("weights"))


def em_sums(table: DataFrame, components: dict[str, list[tuple]]) -> DataFrame:
    """Sums of a weighted EM step for each head and component, of masses with weights, one a head; l adds up to the head's weighted NLL.

    Components are (comp_idx, pi, mu, lv) by head, in the order of the weights. Tasks add up batches, one row a head and component leaves them.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("mz").to_numpy(zero_copy_only=False)
            weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at, (head, comps) in enumerate(components.items()):
                there = ~np.isnan(weights[:, at])
                if not there.any():
                    continue
                mz, own = x[there], weights[there, at]
                _, pi, mu, lv = (np.array(c, float)[:, None] for c in zip(*comps, strict=True))
                w = pi * np.exp(-0.5 * (mz - mu) ** 2 / np.exp(lv)) / np.sqrt(2 * math.pi * np.exp(lv))
                total = 1e-300 + w.sum(0)
                r = own * w / total
                found = np.stack([r.sum(1), r @ mz, r @ mz**2, r @ -np.log(FLOOR + total)], axis=1)
                for c, v in zip(comps, found, strict=True):
                    out[head, c[0]] = out.get((head, c[0]), 0.0) + v
        rows = [(*k, *map(float, v)) for k, v in out.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("head", "comp_idx", *"rmql"), x, strict=True)) for x in rows], kind)

    kind = pa.schema([("head", pa.string()), ("comp_idx", pa.int64()), *[(c, pa.float64()) for c in "rmql"]])
    each = table.select(F.col("mz").cast("double").alias("mz"), "weights").mapInArrow(sums, "head string, comp_idx long, r double, m double, q double, l double")
    return each.groupBy("head", "comp_idx").agg(*[F.sum(c).alias(c) for c in "rmql"])


def fit(peaks: DataFrame, components: DataFrame, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """Components after at most `rounds` steps over peaks (head, mz, intensity), or once no head's mean NLL moves by tol."""
    heads = sorted(r["head"] for r in components.select("head").distinct().collect())
    return fit_masses(sinks.stage(masses(peaks, heads)), components, rounds, tol)


def fit_masses(table: DataFrame, components: DataFrame, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """`fit` of masses with a weight for each head of components, in ascending order. A step is one job; only sums of components (parameters) are collected."""
    spark, before, held = table.sparkSession, {}, {}
    for c in components.orderBy("head", "comp_idx").collect():
        held.setdefault(c.head, []).append((c.comp_idx, c.pi, c.mu, c.lv))
    for _ in range(rounds):
        rows = sorted(em_sums(table, held).collect())
        weight, loss = {}, {}
        for x in rows:
            weight[x.head] = weight.get(x.head, 0.0) + x.r
            loss[x.head] = loss.get(x.head, 0.0) + x.l
        now = {h: loss[h] / max(weight[h], 1e-12) for h in weight}
        if before and all(abs(now[h] - before.get(h, math.inf)) < tol for h in now):
            break
        before = now
        held = {h: [] for h in held}  # a head without peaks keeps its place among the weights
        for x in rows:
            r = max(x.r, 1e-12)
            held[x.head].append((x.comp_idx, x.r / max(weight[x.head], 1e-12), x.m / r, math.log(max(x.q / r - (x.m / r) ** 2, 1e-4))))
    return spark.createDataFrame([(h, *c) for h, own in held.items() for c in own], "head string, comp_idx long, pi double, mu double, lv double")
