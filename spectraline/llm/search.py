"""Ranked lexical search by pipelined term partitioning: the best documents for each item, with integer scores.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case. Documents are dealt to
lanes as they are read, some thousands in one; a lane's index has a packed row for each term (places of the documents, occurrences)
and one for its documents. Terms belong to four owners by rarity. Items travel in bundles, one copy a lane, and meet the owners one
after another: each stage cogroups the bundles of a lane with what the stage's owner has there, and adds whole numbers to the sparse
accumulators (place, score) that an item carries. The last stage gives the best of each lane, and a window the best of all.

Owners of rare terms come first, so an item soon knows how good its k-th best document of the lane is. Where that score is above all
that the owners to come can add at most, documents not met so far are left out, and where a document can no longer reach it, so is
this one. Both are exact: what is left out has k better documents in its own lane.

Bounds: a group of a stage holds the documents of one lane (8,192 of them and 16 MB of text at most, or one longer text) and one
bundle (about 256 items); of bundles there are as many as the items need, and the lane's rows go to each. Of the whole corpus the
driver sees two sums and a fixed bitmap of 4 MB that tells terms of items from others while texts are read.

Edge cases: null and empty texts have no term, are counted nowhere and never found; items without terms, or with none that any
document has, give no rows; rows that repeat an item_id are one item with the terms of all; a null item_id is an item; rows that repeat
a doc_id are documents of their own; equal scores stand by doc_id, null last; empty tables give an empty result; further columns
are not read. Very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraline.llm.shared import cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a byte: itself in lower case if terms have it, else a space.
BYTES = bytes([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)]).lower()
LANE_DOCS, LANE_BYTES, BUNDLE = 8192, 16_000_000, 256
BITS, PAGE = 1 << 25, 1 << 15
#: An owner has the terms that at most one of so many documents holds; the last owner has the rest.
RARITY = (1000, 100, 10)
INDEX = "pid int, lane long, term string, df long, most long, docs long, terms long, at binary, tf binary, ids array<long>"
STATE = "terms array<struct<owner int, term string, w long, bound long>>, at binary, score binary"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: distinct terms of each item."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(found)).alias("term")).distinct()


def bitmap(terms: DataFrame) -> np.ndarray:
    """BITS bits, one set for the crc32 of each term: at most 1,024 rows of 4 kB reach the driver."""
    bit = F.crc32(F.col("term").cast("binary")) % BITS
    pages = terms.groupBy(F.floor(bit / PAGE).alias("page")).agg(F.bitmap_construct_agg(bit % PAGE).alias("bits"))
    out = np.zeros((BITS // PAGE, PAGE // 8), np.uint8)
    for page, bits in pages.collect():
        out[page] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def indexed(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Rows of INDEX: for each lane one without term, which has its documents, and one for each term whose bit is set."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        bits, pid, lane = held.value, TaskContext.get().partitionId(), 0
        known: dict[bytes, bool] = {}
        ids, lengths, postings, size = [], [], {}, 0

        def closed() -> pa.RecordBatch:
            at = [np.array(x[0], np.uint16) for x in postings.values()]
            tf = [np.array(x[1], np.uint32) for x in postings.values()]
            n = len(at)
            rows = {
                "pid": [pid] * (n + 1), "lane": [(pid << 32) + lane] * (n + 1), "term": [None, *(t.decode() for t in postings)],
                "df": [None, *map(len, at)], "most": [None, *(int(x.max()) for x in tf)], "docs": [len(ids)] + [None] * n, "terms": [sum(lengths)] + [None] * n,
                "at": [None, *(x.tobytes() for x in at)], "tf": [np.array(lengths, np.int64).tobytes(), *(x.tobytes() for x in tf)], "ids": [ids] + [None] * n,
            }
            kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                terms = (text.as_py() or b"").translate(BYTES).split()
                if not terms:
                    continue
                if ids and (len(ids) == LANE_DOCS or size + len(text.as_py()) > LANE_BYTES):
                    yield closed()
                    ids, lengths, postings, size, lane = [], [], {}, 0, lane + 1
                for term, tf in Counter(terms).items():
                    want = known.get(term)
                    if want is None:
                        if len(known) > 500_000:
                            known.clear()
                        bit = crc32(term) % BITS
                        want = known[term] = bool(bits[bit >> 3] >> (bit & 7) & 1)
                    if want:
                        found = postings.get(term)
                        if found is None:
                            found = postings[term] = ([], [])
                        found[0].append(len(ids))
                        found[1].append(tf)
                ids.append(doc_id)
                lengths.append(len(terms))
                size += len(text.as_py())
        if ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lanes, INDEX)


def weighted(wanted: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """item_id and its terms (owner, term, w, bound): weights of those that any document has; bound is the most that a term adds to a score."""
    stats = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owner = sum(((F.col("df") * r > n_docs).cast("int") for r in RARITY), F.lit(0))
    # twenty times a document's m is 1,000 at least
    bound = F.expr("w * ((1000000000 * most) div (1000 * most + 1000))")
    term = F.struct(owner.alias("owner"), "term", "w", bound.alias("bound"))
    return wanted.join(stats, "term").withColumn("w", w).filter("w > 0").groupBy("item_id").agg(F.collect_list(term).alias("terms"))


def gains(right: pa.Table, n_docs: int, n_terms: int) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], pa.Array]:
    """Of the terms in a lane, the places and what they add for a weight of 1; the lane's doc_ids."""
    rows = right.select(["term", "at", "tf", "ids"]).to_pydict()
    own = rows["term"].index(None)
    n = np.frombuffer(rows["tf"][own], np.int64)
    if 50 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (50 + (50 * n * n_docs) // n_terms).astype(np.int64)
    out = {}
    for term, at, tf in zip(rows["term"], rows["at"], rows["tf"], strict=True):
        if term is not None:
            place, count = np.frombuffer(at, np.uint16), np.frombuffer(tf, np.uint32).astype(np.int64)
            out[term] = place, (1_000_000_000 * count) // (1000 * count + 20 * m[place])
    return out, pa.array(rows["ids"][own], pa.int64())


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th best score; below all where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -1


def stage(owner: int, k: int, n_docs: int, n_terms: int, kind: pa.DataType, last: bool):
    """What the owner's stage does with the bundles of a lane (left) and its terms there (right)."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        gain, ids = gains(right, n_docs, n_terms)
        sums, out = np.zeros(len(ids), np.int64), []
        for terms, at, score in zip(left["terms"].to_pylist(), left["at"].to_pylist(), left["score"].to_pylist(), strict=True):
            place, found = np.frombuffer(at or b"", np.uint16), np.frombuffer(score or b"", np.int64)
            bound = sum(t["bound"] for t in terms if t["owner"] >= owner)
            later = sum(t["bound"] for t in terms if t["owner"] > owner)
            closed = kth(found, k) > bound
            sums[:] = 0
            sums[place] = found
            for t in terms:
                if t["owner"] == owner and t["term"] in gain:
                    where, what = gain[t["term"]]
                    sums[where] += t["w"] * what
            if not closed:
                place = np.flatnonzero(sums).astype(np.uint16)
            found = sums[place]
            stay = found + later >= kth(found, k)
            out.append((place[stay], found[stay]))
        if not last:
            rest = pa.array([[t for t in terms if t["owner"] > owner] for terms in left["terms"].to_pylist()], left.schema.field("terms").type)
            return pa.table({
                "pid": left["pid"], "lane": left["lane"], "bundle": left["bundle"], "item_id": left["item_id"], "terms": rest,
                "at": pa.array([p.tobytes() for p, _ in out], pa.binary()), "score": pa.array([s.tobytes() for _, s in out], pa.binary()),
            })
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        best = [p[np.lexsort((number[p], missing[p], -s))[:k]] for p, s in out]
        scores = [dict(zip(p.tolist(), s.tolist(), strict=True)) for p, s in out]
        item = np.repeat(np.arange(len(best)), list(map(len, best)))
        place = np.concatenate(best) if best else np.zeros(0, np.uint16)
        return pa.table({
            "item_id": left["item_id"].combine_chunks().cast(kind).take(pa.array(item)), "doc_id": ids.take(pa.array(place.astype(np.int64))),
            "score": pa.array([scores[i][p] for i, p in zip(item.tolist(), place.tolist(), strict=True)], pa.int64()),
        })

    return add


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for each item."""
    wanted = cut(item_terms(items), "item-terms")
    index = cut(indexed(docs, bitmap(wanted)), "index")
    lanes = index.filter("term IS NULL")
    n_docs, n_terms, last_pid = lanes.agg(F.sum("docs"), F.sum("terms"), F.max("pid")).first()
    bundles = cut(weighted(wanted, index, n_docs or 0), "bundles")
    n_items = bundles.count()
    kind = items.schema["item_id"].dataType
    many = max(1, -(-n_items // BUNDLE))
    state = (  # a merge join, as Spark underrates what the sequence makes and would broadcast it
        bundles.withColumns({"bundle": F.pmod(F.xxhash64("item_id"), F.lit(many)).cast("int"), "pid": F.explode(F.sequence(F.lit(0), F.lit(last_pid or 0)))}).hint("merge")
        .join(lanes.select(F.col("pid").alias("pid"), F.col("lane").alias("lane")), "pid")
        .select("pid", "lane", "bundle", F.col("item_id").alias("item_id"), "terms", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("score"))
    )
    schema = f"pid int, lane long, bundle int, item_id {kind.simpleString()}, {STATE}"
    owned = index.join(bundles.select(F.explode("terms").alias("t")).select("t.term", "t.owner").distinct(), "term")
    every = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("bundle")
    for owner in range(len(RARITY) + 1):
        last = owner == len(RARITY)
        columns = ["lane", "term", "at", "tf", "ids"]
        there = owned.filter(F.col("owner") == owner).select(*columns).unionByName(lanes.select(*columns)).select("*", every)
        state = (
            state.groupBy("lane", "bundle").cogroup(there.groupBy("lane", "bundle"))
            .applyInArrow(stage(owner, k, n_docs or 0, n_terms or 1, to_arrow(kind), last), f"item_id {kind.simpleString()}, doc_id long, score long" if last else schema)
        )
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
n AS (SELECT row, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM c GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT i.item_id, n.row, any_value(n.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * n.n * g.n_docs) // g.n_terms)))) AS BIGINT) AS score
    FROM i JOIN w USING (term) JOIN c USING (term) JOIN n USING (row), g GROUP BY i.item_id, n.row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50
"""
