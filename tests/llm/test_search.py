"""Ranked search against DuckDB SQL, and against a plain loop on odd rows and small lanes."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from spectraline.llm import queries as Q
from spectraline.llm import search

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, item_id string, terms string, lane string, rank string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def terms(text):
    return re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k):
    table = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in docs], SCHEMA)
    wanted = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in search.search(table, wanted, k).collect()), key=repr)


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    out = Q.op11_search(spark, SF)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(search.ORACLE).fetchall())


@pytest.mark.parametrize("k", [1, 3, 50])
def test_plain_loop(spark, k, monkeypatch):
    import random

    rng = random.Random(k)
    docs = [(i, " ".join(WORDS[min(int(rng.expovariate(0.2)), 19)] for _ in range(rng.randint(1, 60)))) for i in range(400)]
    docs += [(7, docs[7][1]), (None, "Tau TAU"), (None, None), (500, ""), (501, "é中 x-y_z\u0085w " * 5000), (502, "..."), (503, "tau tau")]
    items = [(i, " ".join(rng.sample(WORDS, 9))) for i in range(6)] + [(2, "tau sigma"), (None, "tau TAU pi"), (8, "é中 w y"), (9, "unheard"), (10, None), (11, "")]
    assert got(spark, docs, items, k) == plain(docs, items, k)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")], 5) == [] and got(spark, [(1, "a")], [], 5) == [] and got(spark, [(1, None)], [(1, "a")], 5) == []
