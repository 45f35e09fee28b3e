"""Near-duplicates by MinHash: fast similarity sketches, banding, exact verification, components.

Contract. A text is lower-cased (A-Z) and cut into words; its set holds the distinct k-word shingles,
with fewer than k words the whole sequence as one, without words (or text) nothing. Two documents are
linked if 100 * |A & B| >= percent * |A | B|. Sets are compared in full, as 64-bit shingle hashes.

Sketch. Dahlgaard, Knudsen and Thorup's fast similarity sketching: in each of the first t rounds every
element is thrown into one random bin, in round t + i into bin i; a bin keeps the least value of the first
round that reaches it; a document leaves once its bins are full, so 2t rounds fill every coordinate.
The t coordinates make bands of `rows`; a pair with similarity s shares no band with probability
(1 - s**rows)**bands: 1.2e-5 at s = 0.85 with 24 bands of 6, and every band chance is independent of size.

Groups. Equal sets collapse to their smallest doc_id before banding. In a bucket, members are compared with
one leader (first the smallest id, then the member with most links); what is then still in different
components is compared member by member, one side always outside the bucket's largest component, so a hot
bucket of real copies costs rows in proportion to its size. Of pairs of different components only those are skipped
whose similarity is too low by an exact bound, from their sizes and the parities of their members' hashed slots.

What is linked are sets, each known by the smallest doc_id that has it and a hash of the set (`id`), so that rows
which repeat a doc_id with another text are separate documents; a component is named by its smallest doc_id.

Edge cases: null or empty text has n_shingles 0 and its own component; a null doc_id gives a null component
and is kept; rows repeating a doc_id give one row each, linked by their texts alone; very long texts are used whole;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraline.llm.shared import cut, free_name
from spectraline.llm.words import U, Words, lists, mix, runs, signed, slices, words

K, PERCENT, BANDS, ROWS, PARITY = 3, 85, 24, 6, 16
MINOR = 500  # members outside a bucket's largest component that one task pairs with the bucket
ID = "struct<doc_id:bigint,s:bigint>"


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, end to end, and the n + 1 places where rows begin."""
    first = w.first()
    at, h = runs(w.hash, w.row, k)
    cuts = np.searchsorted(at, first)
    out = []
    for r in range(w.n):
        if cuts[r] < cuts[r + 1]:
            out.append(np.unique(h[cuts[r] : cuts[r + 1]]))
        elif first[r] < first[r + 1]:
            a, b = first[r], first[r + 1]
            out.append(runs(w.hash[a:b], w.row[a:b], int(b - a))[1])
        else:
            out.append(h[:0])
    size = np.fromiter(map(len, out), np.int64, w.n)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(size)])


def sketch(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each set; those of empty sets are left at the top value."""
    n, top = len(first) - 1, np.iinfo(U).max
    out = np.full((n, t), top, U)
    row = np.repeat(np.arange(n), np.diff(first))
    live = np.diff(first) > 0
    for i in range(2 * t):
        if not live.any():
            break
        if i:
            use = live[row]
            values, row = values[use], row[use]
        h = mix(values ^ mix(np.array([i + 1], U)))
        fill = np.full(n * t, top, U)
        place = (h >> U(32)) % U(t) if i < t else np.full(len(h), i - t, U)
        np.minimum.at(fill, row * t + place.astype(np.int64), h)
        fill = fill.reshape(n, t)
        empty = out == top
        out = np.where(empty, fill, out)
        live &= (out == top).any(axis=1)
    return out


def bands_of(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketches.reshape(len(sketches), bands, rows)
    total = np.zeros(parts.shape[:2], U) + mix(np.arange(1, bands + 1, dtype=U))
    for j in range(rows):
        total = mix(total + parts[:, :, j])
    return total


def set_hash(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each set, 0 for an empty one."""
    out, some = np.zeros(len(first) - 1, U), np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(mix(values ^ U(seed)), first[some])
    return out


def _signer(k: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            for part in slices(batch):
                values, first = shingle_sets(words(part.column("text"), lower=True), k)
                size = np.diff(first)
                both = [set_hash(values, first, j) for j in (77, 78)]
                marks = bands_of(sketch(values, first, bands * rows), bands, rows)
                each = np.where(size > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(size), signed(both[0]), signed(both[1]),
                     lists(signed(marks[size > 0].ravel()), np.concatenate([[0], np.cumsum(each)]))],
                    names=["doc_id", "key", "n_shingles", "set1", "set2", "bands"])

    return sign


def parities(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each set, by 64 * PARITY hashed slots, whether the slot holds an odd number of members; packed in PARITY integers."""
    n, width = len(first) - 1, 64 * PARITY
    slot = (mix(values ^ U(991)) % U(width)).astype(np.int64)
    odd = np.stack([np.bincount(slot[a:b], minlength=width) & 1 for a, b in zip(first, first[1:], strict=False)]) if n else np.zeros((0, width), np.int64)
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64).reshape(n, PARITY)


def _setter(k: int):
    def put(batches):
        for batch in batches:
            for part in slices(batch):
                values, first = shingle_sets(words(part.column("text"), lower=True), k)
                ids = pa.StructArray.from_arrays([part.column("doc_id"), signed(set_hash(values, first, 77))], names=["doc_id", "s"])
                odd = (pa.array(x) for x in parities(values, first).T.copy())
                yield pa.RecordBatch.from_arrays([ids, lists(signed(values), first), *odd], names=["id", "members", *(f"p{i}" for i in range(PARITY))])

    return put


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b); by least labels and label jumps, O(log) rounds."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        seen = edges.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        near = label.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = label.select(F.col("id").alias("c"), F.col("component").alias("j"))
        step = cut(near.join(jump, "c", "left").select("id", F.least("c", F.coalesce("j", "c")).alias("component"), "old"), "labels")
        label = step.select("id", "component")
        if step.filter("component <> old").isEmpty():
            return label


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); and the hash of its text as `key` if asked for."""
    docs = docs.select("doc_id", "text")
    signed_docs = cut(
        docs.withColumn("key", F.xxhash64("text")).mapInArrow(_signer(k, bands, rows), "doc_id long, key long, n_shingles long, set1 long, set2 long, bands array<long>"),
        "sketches",
    )
    same = ["n_shingles", "set1", "set2"]
    rep = cut(signed_docs.filter("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "bands")).alias("r"))
              .select(*same, F.struct("r.doc_id", F.col("set1").alias("s")).alias("id"), "r.bands"), "representatives")
    member = rep.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    many = member.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    member = cut(member.join(many, "bucket"), "buckets")
    parity = ", ".join(f"p{i} long" for i in range(PARITY))
    sets = cut(docs.join(member.select("id.doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_setter(k), f"id {ID}, members array<long>, {parity}")
               .dropDuplicates(["id"]), "sets")

    close = F.col("na") * 100 >= F.col("nb") * percent
    close &= F.col("nb") * 100 >= F.col("na") * percent

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("members").alias("set_a"))
        two = sets.select(F.col("id").alias("b"), F.col("members").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        return (
            pairs.join(one, "a")
            .join(two, "b")
            .filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
            .select("a", "b")
        )

    def led(members: DataFrame, order) -> DataFrame:
        leader = (
            members.groupBy("bucket")
            .agg(F.min(F.struct(*order, "id", "n")).alias("l"))
            .select("bucket", F.col("l.id").alias("a"), F.col("l.n").alias("na"))
        )
        return (members.join(leader, "bucket").select("a", F.col("id").alias("b"), "na", F.col("n").alias("nb"), *[c for c in ("component",) if c in members.columns])
                .filter("a <> b").filter(close))

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    done = cut(led(member, []).select(*ordered).distinct(), "pairs")
    links = cut(verified(done), "links")
    label = components(links)

    def placed(label: DataFrame) -> DataFrame:
        """Members of buckets that still hold several components."""
        at = member.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        return at.join(open_, "bucket")

    at = cut(placed(label), "open")
    if not at.isEmpty():
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("id")).agg((-F.count("*")).alias("rank"))
        hubs = led(at.join(degree, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0))), ["rank"])
        pairs = cut(hubs.select(*ordered).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        done, links = done.union(pairs), links.union(cut(verified(pairs), "links"))
        label = components(links)
        at = cut(placed(label), "open")
        # Slots of unequal parity each hold a shingle of the symmetric difference: their number is at most its size.
        at = cut(at.join(sets.drop("members"), "id"), "bounded")
        size = at.groupBy("bucket", "component").agg(F.count("*").alias("c"))
        largest = size.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("total"))
        # a bucket's minor members are dealt to parts, each of which meets the whole bucket
        largest = (
            largest
            .select("bucket", F.col("m.component").alias("main"), F.ceil((F.col("total") - F.col("m.c")) / MINOR).cast("int").alias("parts"))
        )
        side = lambda x: [F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), *(F.col(f"p{i}").alias(f"p{i}{x}") for i in range(PARITY))]
        both_sides = at.join(largest, "bucket")
        minor = (
            both_sides.filter("component <> main")
            .select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *side("a"))
        )
        every = both_sides.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *side("b"))
        apart = sum((F.bit_count(F.col(f"p{i}a").bitwiseXOR(F.col(f"p{i}b"))) for i in range(1, PARITY)), F.bit_count(F.col("p0a").bitwiseXOR(F.col("p0b"))))
        both = F.col("na") + F.col("nb")  # |A & B| is at most (both - apart) / 2, |A | B| at least (both + apart) / 2
        rest = minor.join(every, ["bucket", "part"]).filter("ca <> cb").filter(close & (100 * (both - apart) >= percent * (both + apart)))
        pairs = cut(rest.select(*ordered).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = links.union(cut(verified(pairs), "links"))
            label = components(links)

    of_rep = rep.join(label, "id", "left").select(*same, F.coalesce("component", "id")["doc_id"].alias("component_id"))
    own = signed_docs.select("doc_id", "key", *same).join(of_rep, same, "left")
    own = own.withColumn("component_id", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id")))
    return own.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *["key"] * key)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """docs without those whose component has a smaller doc_id; a null doc_id stays. At s = 0.8 a pair misses all bands with 3e-6."""
    key = free_name(docs.columns, "key")
    gone = near_duplicates(docs, k, percent, bands, rows, key=True).filter("not kept").select("doc_id", F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(gone, ["doc_id", key], "left_anti").select(*docs.columns)
