"""The manifest against DuckDB SQL, a plain recursion over small trees, superblocks of several steps, and odd rows."""

import hashlib
import zlib

import duckdb
import pytest

from spectraline.llm import merkle
from spectraline.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, at string, part string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """The same by going over whole levels in memory."""

    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])

    def climb(nodes):
        """The root of nodes, and each one's path of (before, after)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                first = p // 8 * 8
                paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 8])))
            nodes, at = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], paths

    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)), i) for i, r in enumerate(rows) if r.lang == lang)
        trees.append(([i for _, i in own], [k[2] for k, _ in own], *climb([k[2] for k, _ in own])))
    root, upper = climb([t[2] for t in trees]) if trees else (None, [])
    out = []
    for (ids, leaves, subroot, paths), up in zip(trees, upper, strict=True):
        for i, own, path in zip(ids, leaves, paths, strict=True):
            r, path = rows[i], path + up
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)) if hit else own
            for before, after in path:
                now = H(before, now, after)
            out.append((r.doc_id, own, subroot, root, H(*[x for p in path for x in p]), now, now == root))
    return out


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"Text {i}", "en" if i % 3 else "é", "S", i, "a", "b", "c", "d") for i in range(1, 90)]
    rows += [(5, "Text 5", "en", "S", 5, "a", "b", "c", "d"), (5, "other", "en", None, None, None, None, None, None), (7, None, None, None, None, "a", "b", "c", "d")]
    rows += [(None, "X Y", "en", "s", 1, "a", "b", "c", "d"), (None, "X Y", None, "s", 1, "a", "b", "c", "d"), (9007199254740993, "", "zz", "", 0, "a", "b", "c", "d")]
    rows += [(100, "Long A " * 30000, "en", "s", 1, "a", "b", "c", "d")]
    return spark.createDataFrame(rows, SCHEMA)


def manifest(df, **options):
    return [tuple(r) for r in merkle.manifest(df, *merkle.lower_cased(), **options).select(*COLUMNS).collect()]


def test_sql_and_plain_recursion(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = [tuple(r) for r in Q.op12_merkle(spark, SF).select(*COLUMNS).collect()]
    assert same(got, con.sql(merkle.ORACLE).select(*[duckdb.ColumnExpression(c) for c in COLUMNS]).fetchall())
    assert same(got, plain(spark.read.parquet(f"{SF}/documents.parquet").collect()))


def test_odd_rows(spark, odd):
    assert same(manifest(odd), plain(odd.collect()))
    assert same(manifest(odd.limit(1)), plain(odd.limit(1).collect()))
    assert manifest(odd.limit(0)) == []


def test_many_steps(spark, odd):
    """Superblocks of eight leaves: languages and subroots take several steps up and down."""
    more = odd.unionByName(spark.range(200, 230).selectExpr(
        "id as doc_id", "'A' as text", "concat('l', id) as lang", "'s' as source", "1L as n_chars", "'' as leaf", "'' as tree", "'' as at", "'' as part"))
    assert same(manifest(more, levels=1), plain(more.collect()))
