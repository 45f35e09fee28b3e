"""The store: no exchange of values, pruned regions, labels and mode kept."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from spectraline.sources import store


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    name = f"test_{uuid.uuid4().hex}"
    values = spark.range(4000).selectExpr("int(id % 2) as region", "int(id % 40) as y", "int(id % 7) as x", "id % 10 as channel", "double(id % 13) as value")
    values = values.groupBy("region", "y", "x", "channel").agg(F.sum("value").alias("value"))
    labels = values.select("region", "y", "x").distinct().withColumns({"class": F.concat(F.lit("c"), F.col("y") % 3), "weight": F.lit(0.5)})
    axis = spark.range(10).selectExpr("id as channel", "double(id) as lo", "double(id + 1) as hi", "id + 0.5 as mz")
    out = store.write(spark, name, values, axis, labels, "continuous", 8)
    yield values, labels, out, name
    store.dropped(spark, name)


def exchanges(df):
    """Exchanges of the plan as run, broadcasts aside."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return re.findall(r"(?<!Broadcast)Exchange hashpartitioning", final)


def test_read_back(made):
    values, labels, out, _ = made
    assert out.mode == "continuous" and out.buckets == 8
    assert sorted(map(tuple, out.values.select(*values.columns).collect())) == sorted(map(tuple, values.collect()))
    assert sorted(map(tuple, out.labels.select(*labels.columns).collect())) == sorted(map(tuple, labels.collect())) and out.axis.count() == 10


def test_nothing_is_exchanged(spark, made):
    """Sums in bins by pixel, norms and labels take values from their buckets."""
    _, _, out, _ = made
    bins = spark.createDataFrame([(0, 0.0, 5.0), (1, 5.0, 10.0)], "bin_idx long, lo double, hi double")
    assert not exchanges(store.binned(out, bins)) and not exchanges(store.normalised(out)) and not exchanges(store.labelled(out))


def test_values(spark, made):
    values, _, out, _ = made
    bins = spark.createDataFrame([(0, 0.0, 4.9), (1, 5.0, 10.0)], "bin_idx long, lo double, hi double")
    want = {}
    for r in values.collect():
        k = r.region, r.y, r.x, int(r.channel + 0.5 > 4.9)
        want[k] = want.get(k, 0) + r.value
    assert {(r.region, r.y, r.x, r.channel): r.value for r in store.binned(out, bins).collect()} == want
    for by in ("tic", "max", "vect"):
        each = {}
        for r in store.normalised(out, by).collect():
            each.setdefault((r.region, r.y, r.x), []).append(r.value)
        total = {"tic": sum, "max": max, "vect": lambda v: sum(x * x for x in v)}[by]
        assert all(total(v) == pytest.approx(1) for v in each.values())


def test_a_region_is_a_folder(made):
    plan = made[2].values.filter("region = 1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*region", plan)


def test_errors(spark, made):
    values, labels, out, name = made
    with pytest.raises(ValueError, match="mode"):
        store.write(spark, "x", values, out.axis, labels, "other")
    with pytest.raises(Exception, match="already exists"):
        store.write(spark, name, values, out.axis, labels, "continuous")
