"""Merkle manifest of a table of documents: digests of rows, one tree a language, and a proof for every row.

A leaf is the SHA-256 of a row's fields, each with its length. In each tree the leaves stand by doc_id (nulls first, then by leaf);
every eight nodes in a row become their digest until one is left, the subroot. Subroots, by language (null first, by bytes), go on
likewise to the root. The proof of a leaf is its siblings, level by level; folding it with a leaf gives the root again, or, if the
leaf was tampered with, something else.

Leaves are dealt to superblocks of 4096, four levels of eight. A first pass over the superblocks gives the node on top of each; these
nodes are the leaves of the next step, so a few steps reach the subroots at any size. Coming down again, leaves (or nodes) are
cogrouped by superblock with the one outer row of the block: the siblings from its top to the root. One call then finishes the local
levels, joins local and outer siblings to proofs, and folds. No task has more than a superblock and its outer row, whatever the size
of a language. Positions come from a range partitioned table, whose partitions may split a language anywhere.

Edge cases: a null field is written `-`; a null doc_id is a leaf like others, is never tampered with, and comes first; rows that repeat
a doc_id are leaves of their own, equal rows in any order; a null or empty text is never changed; an only leaf is the subroot, an
only subroot the root, with an empty proof; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraline.llm.shared import cut

RUN, LEVELS = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTER = "tree long, at long, subroot string, root string, before array<string>, after array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its number of bytes in front; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column, change: Column) -> DataFrame:
    """doc_id, lang, leaf, and the changed leaf of rows tampered with."""
    head = F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    leaf = lambda text: F.sha2(F.concat(head, field(text)), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(change)).alias("changed"))


def placed(rows: DataFrame) -> DataFrame:
    """rows with tree (number of the language), at (place in the tree from 0) and size (of the tree).

    The rows are range partitioned by language, doc_id and leaf; the last key, a number of each row, lets even equal rows be split.
    Places are counted inside partitions and lifted by the counts of the partitions before, a row for each language and partition.
    """
    order = ["lang", "doc_id", "leaf", "nth"]
    numbered = cut(rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    number = F.monotonically_increasing_id()  # partition and place in it
    ordered = cut(
        numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
        .withColumn("part", F.shiftright(number, 33)).withColumn("at", number.bitwiseAND((1 << 33) - 1)),
        "ordered-leaves",
    )
    sizes = ordered.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("lang")
    sizes = sizes.withColumns({
        "size": F.sum("n").over(tree),
        "lift": F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first"),
    })
    trees = sizes.select("lang").distinct().withColumn("tree", (F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1).cast("long"))
    trees = cut(sizes.alias("s").join(trees.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang"))).select("s.*", "t.tree"), "trees")
    return (
        ordered.alias("r")
        .join(trees.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")) & (F.col("r.part") == F.col("t.part")))
        .select("r.doc_id", "r.leaf", "r.changed", "t.tree", (F.col("r.at") + F.col("t.lift")).alias("at"), "t.size")
    )


def block(levels: int) -> Column:
    return F.floor(F.col("at") / RUN**levels).cast("long")


def local_levels(nodes: list[str], size: int, levels: int) -> list[list[str]]:
    """The levels over a superblock's nodes in a tree of `size` nodes: up to its top, at most `levels` above them."""
    out = [nodes]
    while len(out) <= levels and size > 1:
        below = out[-1]
        out.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
        size = -(-size // RUN)
    return out


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, at, digest, size of the nodes on top of the superblocks; a tree that has one node keeps it."""

    def top(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        above = local_levels(group.sort_values("at")["digest"].tolist(), size, levels)
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "digest": above[-1], "size": [-(-size // RUN**levels)]})

    return (
        nodes.select("tree", "at", "digest", "size").groupBy("tree", block(levels).alias("block"))
        .applyInPandas(top, "tree long, at long, digest string, size long")
    )


def siblings(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each level but the top, and each of its nodes, the nodes before and after it in its run of eight."""
    out = []
    for level in levels[:-1]:
        out.append([])
        for first in range(0, len(level), RUN):
            run = level[first : first + RUN]
            out[-1] += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def upward(sides: list[list[tuple[str, str]]], at: int) -> list[tuple[str, str]]:
    return [level[at // RUN**k] for k, level in enumerate(sides)]


def outer_of(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """The outer rows of all nodes: their siblings inside the superblock, then those of the superblock's own outer row."""

    def joined(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, up = group.sort_values("at"), above.iloc[0]
        sides = siblings(local_levels(group["digest"].tolist(), int(group["size"].iloc[0]), levels))
        paths = [upward(sides, i) for i in range(len(group))]
        return pd.DataFrame({
            "tree": group["tree"], "at": group["at"], "subroot": up["subroot"], "root": up["root"],
            "before": [[b for b, _ in p] + list(up["before"]) for p in paths], "after": [[a for _, a in p] + list(up["after"]) for p in paths],
        })

    return (
        nodes.groupBy("tree", block(levels).alias("block"))
        .cogroup(outer.withColumnRenamed("at", "block").groupBy("tree", "block"))
        .applyInPandas(joined, OUTER)
    )


def proofs(rows: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: superblocks of leaves with their outer rows."""

    def finished(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, up = group.sort_values("at"), above.iloc[0]
        sides = siblings(local_levels(group["leaf"].tolist(), int(group["size"].iloc[0]), levels))
        outside = list(zip(up["before"], up["after"], strict=True))
        proof, folded = [], []
        for i, (leaf, changed) in enumerate(zip(group["leaf"], group["changed"], strict=True)):
            path, now = [*upward(sides, i), *outside], changed or leaf
            proof.append(digest("".join([x for both in path for x in both])))
            for before, after in path:
                now = digest(before + now + after)
            folded.append(now)
        return pd.DataFrame({
            "doc_id": group["doc_id"], "leaf": group["leaf"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": proof, "folded_root": folded,
        })

    ids = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make numbers with nulls inexact
    out = (
        ids.groupBy("tree", block(levels).alias("block"))
        .cogroup(outer.withColumnRenamed("at", "block").groupBy("tree", "block"))
        .applyInPandas(finished, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))


def climb(nodes: DataFrame, largest: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes step by step, and the one node that each tree ends in."""
    steps = [nodes]
    while True:
        top = cut(tops(steps[-1], levels), "tops")
        largest = -(-largest // RUN**levels)
        if largest <= 1:
            return steps, top
        steps.append(top)


def manifest(docs: DataFrame, tampered: Column, change: Column, levels: int = LEVELS) -> DataFrame:
    """The proofs of all rows of docs; `change` is the text that a row has once it was tampered with; superblocks have `levels` levels."""
    rows = placed(leaves(docs, tampered, change))
    largest, trees = rows.agg(F.max("size"), F.max("tree")).first()
    steps, subroots = climb(rows.withColumnRenamed("leaf", "digest"), largest or 0, levels)
    forest = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit((trees or 0) + 1).cast("long").alias("size"))
    higher, root = climb(forest, (trees or 0) + 1, levels)
    nothing = F.array().cast("array<string>")
    outer = root.select("tree", "at", F.lit("").alias("subroot"), F.col("digest").alias("root"), nothing.alias("before"), nothing.alias("after"))
    for nodes in reversed(higher):
        outer = outer_of(nodes, outer, levels)
    outer = (
        subroots.select("tree", "digest").join(outer.drop("tree").withColumnRenamed("at", "tree"), "tree")
        .select("tree", F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "root", "before", "after")
    )
    for nodes in reversed(steps[1:]):
        outer = outer_of(nodes, outer, levels)
    return proofs(rows, outer, levels)


def lower_cased(every: int = 3) -> tuple[Column, Column]:
    """Rows whose crc32 of the decimal doc_id is a multiple of `every`, and their text with A-Z in lower case."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False)), F.translate("text", UPPER, LOWER)


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) END AS crc FROM documents),
f AS (SELECT doc_id, lang, crc % 3 = 0 AS hit, text, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head FROM crc),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
up AS (SELECT tree, 0 AS level, pos, leaf AS digest, size FROM p
    UNION ALL SELECT tree, any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((size + 7) // 8) FROM up WHERE size > 1 GROUP BY tree, pos // 8),
s AS (SELECT tree, digest AS subroot FROM up WHERE size = 1),
forest AS (SELECT 0 AS level, tree AS pos, subroot AS digest, (SELECT count(*) FROM s) AS size FROM s
    UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((size + 7) // 8) FROM forest WHERE size > 1 GROUP BY pos // 8),
sides AS (SELECT tree, level, pos, string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM up WHERE size > 1 WINDOW w AS (PARTITION BY tree, level, pos // 8 ORDER BY pos)),
higher AS (SELECT level, pos, string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM forest WHERE size > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
path AS (SELECT p.tree, p.pos, sides.level, sides.before, sides.after FROM p JOIN sides ON sides.tree = p.tree AND sides.pos = p.pos // CAST(8 ** sides.level AS BIGINT)
    UNION ALL SELECT p.tree, p.pos, 100 + higher.level, higher.before, higher.after FROM p JOIN higher ON higher.pos = p.tree // CAST(8 ** higher.level AS BIGINT)),
steps AS (SELECT tree, pos, list(struct_pack(b := coalesce(before, ''), a := coalesce(after, '')) ORDER BY level) AS path FROM path GROUP BY tree, pos),
fold AS (SELECT p.tree, p.pos, 1 AS i, coalesce(p.changed, p.leaf) AS now, coalesce(len(steps.path), 0) AS n, steps.path FROM p LEFT JOIN steps USING (tree, pos)
    UNION ALL SELECT tree, pos, i + 1, sha256(path[i].b || now || path[i].a), n, path FROM fold WHERE i <= n)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(array_to_string(list_transform(fold.path, lambda x: x.b || x.a), ''), '')) AS proof_sha256, fold.now AS folded_root, fold.now = r.root AS verified
FROM p JOIN fold ON fold.tree = p.tree AND fold.pos = p.pos AND fold.i = fold.n + 1 JOIN s ON s.tree = p.tree, (SELECT digest AS root FROM forest WHERE size = 1) r
"""
