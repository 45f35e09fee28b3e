"""Registry of named queries: a Spark function and, where SQL can say it, the same in SQL over the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VIEWS = """WITH pk AS (SELECT l_orderkey AS spectrum_id, l_linenumber AS idx, l_orderkey % 100 AS y, l_orderkey // 100 AS x, l_extendedprice / 100 AS mz, l_quantity AS intensity, l_linestatus AS dataset, l_suppkey AS supp, l_returnflag AS flag FROM lineitem),
sp AS (SELECT spectrum_id, CAST(count(*) AS INTEGER) AS len, list(mz ORDER BY mz, intensity) AS mzs, list(intensity ORDER BY mz, intensity) AS ints FROM pk GROUP BY spectrum_id),
lab AS (SELECT o_orderkey AS spectrum_id, o_orderstatus AS target, o_custkey % 3 AS region, o_orderpriority AS ann, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS weight FROM orders),
dn0 AS (SELECT vec_id, label, label % 2 AS target, vec_id % 3 AS region, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS channel FROM embeddings),
dn AS (SELECT vec_id, label, target, region, CAST(channel AS INTEGER) AS channel, CAST(v AS DOUBLE) AS value FROM dn0),
ub AS (SELECT range AS bin_idx, 0.0::DOUBLE + range * 10.5::DOUBLE AS lo, 0.0::DOUBLE + (range + 1) * 10.5::DOUBLE AS hi FROM range(100)),
gb AS (SELECT * FROM ub WHERE bin_idx % 3 <> 2),
lip AS (SELECT p_partkey AS idx, p_retailprice / 2 AS mz, p_size / 100 AS width, p_name AS name FROM part),
tic AS (SELECT y, x, sum(intensity) AS v FROM pk GROUP BY y, x)
"""


def op(name: str, sql: str | None = None, recursive: bool = False):
    """Register a query; sql continues VIEWS, with further views first if it begins with a comma."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (VIEWS.replace("WITH", "WITH RECURSIVE", 1) if recursive else VIEWS) + sql
        return f

    return keep
