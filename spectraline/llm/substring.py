"""Substring dedup: suffix automata of reference shards, through which documents are streamed.

Contract. Words are runs of [^\\x20\\x09-\\x0D], unchanged. A word is removed if a window of `length` words
that covers it also starts in a document with a smaller doc_id; windows are judged on the input.

An automaton of all texts would not fit one task, and every document against every shard would be quadratic.
So exact filters come first, all of them shuffles on hashes that keep every repeated window:
1. anchors: each window selects the least of its k-grams (leftmost on ties), so equal windows select equal
   k-grams; k-grams of one document only are left out by a combined min/max;
2. runs: the windows under the anchors left, as maximal runs of words; equal runs collapse to the smallest
   doc_id, so that groups of copies shrink to one before windows are spelled out;
3. owners: the smallest doc_id of each window of these runs.
The passages that own repeated windows are the reference, as are runs that have copies. They are dealt to shards of bounded
size by owner, copied runs in pieces by their hash; in each task the shard's suffix automaton is built and the segments routed
to it are streamed for matching statistics, which alone decide what is removed. Of equal runs one is streamed for all, asking
for documents above the smallest that has it. A shard that many segments reach is copied to several tasks.

A row is known by its doc_id and the hash of its text (`key`), so rows that repeat a doc_id keep their own spans; doc_id
alone decides which document is smaller, and rows of one doc_id never remove words from each other.

Edge cases: null or empty text has no words; rows with a null doc_id keep all words and remove none elsewhere; equal rows
get equal results; very long texts are used whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraline.llm.automaton import SuffixAutomaton
from spectraline.llm.shared import cut, free_name
from spectraline.llm.words import U, Words, mix, runs, signed, slices, words

LENGTH, GRAM = 13, 6
WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
SHARD_WORDS, TASK_WORDS, PIECE = 40_000, 1_000_000, 20_000


def window_anchors(w: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the word at which the k-gram they select begins, and that k-gram's hash."""
    at, h = runs(w.hash, w.row, gram)
    if not len(at):
        return at, at, h
    best, span, need = np.arange(len(h)), 1, length - gram + 1
    while span < need:
        step = min(span, need - span)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        span += step
    starts = np.flatnonzero(w.row[: max(0, len(w.row) - length + 1)] == w.row[length - 1 :])
    pick = best[np.searchsorted(at, starts)] if len(starts) else starts
    return starts, at[pick], h[pick]


def _anchor(length: int, gram: int):
    def put(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                _, place, h = window_anchors(w, length, gram)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                place, h = place[new], h[new]
                row = w.row[place]
                yield pa.RecordBatch.from_arrays(
                    [signed(h), part.column("doc_id").take(pa.array(row)), pa.array((place - w.first()[row]).astype(np.int32))], names=["h", "doc_id", "pos"])

    return put


def spans_of(index: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of consecutive values in sorted distinct integers."""
    if not len(index):
        return []
    gap = np.flatnonzero(np.diff(index) > 1)
    return list(zip(index[np.concatenate([[0], gap + 1])].tolist(), index[np.concatenate([gap, [len(index) - 1]])].tolist(), strict=True))


def _run(length: int, gram: int):
    def put(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                starts, place, _ = window_anchors(w, length, gram)
                first = w.first()
                marks = part.column("marks")
                flagged = np.zeros(len(w.row), bool)
                for r in range(w.n):
                    at = first[r] + np.array(marks[r].values.to_numpy(zero_copy_only=False), np.int64)
                    flagged[at[at < first[r + 1]]] = True  # a mark may stem from another text of the same doc_id
                hit = starts[flagged[place]]
                out = []
                for a, b in spans_of(hit):
                    while a <= b:  # a run stays in one row
                        r = int(w.row[a])
                        last = min(b, int(first[r + 1]) - length)
                        text = b" ".join(w.data[w.start[a] : w.end[last + length - 1]].tobytes().split())
                        out.append((r, a - int(first[r]), last - a + 1, text.decode()))
                        a = last + 1
                rows, start, n, text = zip(*out, strict=True) if out else ((), (), (), ())
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("key").take(rows), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "key", "start", "n", "text"])

    return put


def _windows(length: int):
    def put(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                at, h = runs(w.hash, w.row, length)
                row = w.row[at]
                take = lambda c: part.column(c).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [signed(h), take("doc_id"), take("run"), pa.array((at - w.first()[row]).astype(np.int32))],
                    names=["h", "doc_id", "run", "offset"],
                )

    return put


def _deal(length: int, shards: int):
    """Cut a run by the owners of its windows: reference passages (own) and segments to be judged."""

    def put(batches):
        for batch in batches:
            out = []
            for doc, key, start, text, owned in zip(*(batch.column(c) for c in ("doc_id", "key", "start", "text", "owned")), strict=True):
                doc, key, start, tokens = doc.as_py(), key.as_py(), start.as_py(), text.as_py().split(" ")
                offset = owned.values.field("offset").to_numpy()
                order = np.argsort(offset)
                offset, owner = offset[order].astype(np.int64), owned.values.field("owner").to_numpy()[order]
                shard = (mix(owner.astype(np.int64).view(U)) % U(shards)).astype(np.int64)
                kind = np.where(owner == doc, -1, shard)
                edge = np.flatnonzero((np.diff(offset) != 1) | (np.diff(kind) != 0))
                for a, b in zip(np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(offset) - 1]]), strict=True):
                    lo, hi = int(offset[a]), int(offset[b]) + length
                    out.append((int(shard[a]), int(kind[a] >= 0), doc, key, start + lo, hi - lo, " ".join(tokens[lo:hi])))
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "kind", "doc_id", "key", "start", "n", "text"), x, strict=True)) for x in out], schema=pa.schema(
                [("shard", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("text", pa.string())]))

    return put


def _copied(length: int, shards: int):
    """Runs that have copies, in pieces of PIECE windows: each as reference of its document and as a segment (kind 2) that asks for the next greater one."""

    def put(batches):
        for batch in batches:
            out = []
            for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "text")), strict=True):
                tokens = text.split(" ")
                for lo in range(0, len(tokens) - length + 1, PIECE):
                    words_ = tokens[lo : lo + PIECE + length - 1]
                    shard = int(mix(np.array([(h + lo) % (1 << 64)], U))[0] % U(shards))
                    out += [(shard, kind, doc + kind // 2, h, lo, len(words_), " ".join(words_)) for kind in (0, 2)]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["shard", "kind", "doc_id", "key", "start", "n", "text"],
            )

    return put


def _judge(length: int):
    """Rows come sorted by (shard, copy, kind): passages of a shard, then the segments to stream through its automaton."""

    def put(batches):
        here, machine, ready = None, None, False
        for batch in batches:
            out = []
            for shard, copy, kind, doc, key, start, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "copy", "kind", "doc_id", "key", "start", "text")), strict=True):
                if (shard, copy) != here:
                    here, machine, ready = (shard, copy), SuffixAutomaton(), False
                if not kind:
                    machine.add(text.split(" "), doc)
                    continue
                if not ready:
                    machine.spread_owners()
                    ready = True
                owners = machine.owners_of_windows(text.split(" "), length)
                ends = np.array([i for i, o in enumerate(owners) if o is not None and o < doc], np.int64)
                out += [(kind, doc, key, start + a - length + 1, start + b + 1) for a, b in spans_of(ends)]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["kind", "doc_id", "key", "lo", "hi"])

    return put


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, lo, hi): words lo..hi-1 of a row are covered by windows that start in a smaller document; spans may overlap."""
    docs = docs.select("doc_id", "text", text_key().alias("key")).filter("doc_id is not null and text is not null")
    anchors = docs.mapInArrow(_anchor(length, gram), "h long, doc_id long, pos int")
    # written, so that the join below reads two plain shuffles and a hot anchor's rows can be split among tasks
    several = cut(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h"), "shared-anchors")
    marks = anchors.join(several, "h").groupBy("doc_id").agg(F.collect_set("pos").alias("marks"))
    found = docs.join(marks, "doc_id").mapInArrow(_run(length, gram), "doc_id long, key long, start long, n long, text string")
    found = cut(found.withColumns({"k1": F.xxhash64("text"), "k2": F.md5("text")}), "runs")
    first = cut(found.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "first")
    placed = found.join(first, ["k1", "k2"])
    rep = placed.filter("doc_id = least").select("doc_id", "key", "start", "text", "k1", (F.col("most") > F.col("least")).alias("copied"))
    rep = cut(rep.withColumn("run", F.xxhash64("key", "start")), "distinct-runs")
    window = rep.select("doc_id", "run", "text").mapInArrow(_windows(length), "h long, doc_id long, run long, offset int")
    # A window that collapsed runs alone share is still owned by the run that stands for them, and need not be looked at.
    owners = window.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).filter("owner < hi").select("h", "owner")
    owned = window.join(owners, "h").groupBy("doc_id", "run").agg(F.collect_set(F.struct("offset", "owner")).alias("owned"))
    total = rep.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, int(total // (6 * SHARD_WORDS)))
    schema = "shard long, kind int, doc_id long, key long, start long, n long, text string"
    dealt = (
        rep.select("doc_id", "key", "start", "text", "run")
        .dropDuplicates(["doc_id", "run"])
        .join(owned, ["doc_id", "run"])
        .mapInArrow(_deal(length, shards), schema)
    )
    copied = (
        rep.filter("copied")
        .select("doc_id", "k1", "text")
        .dropDuplicates(["doc_id", "k1"])
        .mapInArrow(_copied(length, shards), schema)
    )
    dealt = cut(dealt.unionByName(copied), "dealt")
    load = dealt.filter("kind > 0").groupBy("shard").agg(F.ceil(F.sum("n") / TASK_WORDS).cast("int").alias("copies"))
    each = (
        F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("copies") - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")))
    )
    routed = dealt.join(load, "shard").withColumn("copy", F.explode(each)).select("shard", "copy", "kind", "doc_id", "key", "start", "text")
    sorted_ = routed.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "doc_id", "key", "start")
    judged = cut(sorted_.mapInArrow(_judge(length), "kind long, doc_id long, key long, lo long, hi long"), "judged")
    own = judged.filter("kind = 1").select("doc_id", "key", "lo", "hi")
    of_run = judged.filter("kind = 2").select((F.col("doc_id") - 1).alias("least"), F.col("key").alias("k1"), "lo", "hi")
    copies = placed.filter("doc_id > least").select("doc_id", "key", "start", "least", "k1").join(of_run, ["least", "k1"])
    return own.union(copies.select("doc_id", "key", F.col("start") + F.col("lo"), F.col("start") + F.col("hi")))


def text_key() -> Column:
    """With the doc_id, what a row is known by."""
    return F.xxhash64("text")


def _keep_mask(spans, total: int) -> np.ndarray | None:
    """Which of the words stay; None if all do."""
    if not spans.is_valid or not len(spans):
        return None
    keep = np.ones(total, bool)
    for lo, hi in zip(spans.values.field("lo").to_pylist(), spans.values.field("hi").to_pylist(), strict=True):
        keep[lo:hi] = False
    return keep


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left, joined by one space (or, without texts, that text's SHA-256)."""

    def put(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, spans in zip(part.column("text"), part.column("spans"), strict=True):
                    tokens = (text.as_py() or "").encode().split()
                    keep = _keep_mask(spans, len(tokens))
                    left = tokens if keep is None else [tokens[i] for i in np.flatnonzero(keep)]
                    line = b" ".join(left)
                    out.append((len(tokens), len(tokens) - len(left), line.decode() if texts else hashlib.sha256(line).hexdigest()))
                n, gone, last = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(last, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    keyed = docs.select("doc_id", "text", text_key().alias("key"))
    return (
        keyed.join(_spans(docs, length, gram), ["doc_id", "key"], "left")
        .mapInArrow(put, "doc_id long, n_words long, n_removed long, kept string")
    )


def _spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row (doc_id, key, spans) for each text with something to remove."""
    return cut(repeated_spans(docs, length, gram), "spans").groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated words cut out of text, all else of a text kept; rows left without a word go, n_chars follows the text."""

    def put(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column(spans_at), strict=True):
                old = text.as_py()
                raw = (old or "").encode()
                found = list(WORD.finditer(raw)) if spans.is_valid else []
                keep = _keep_mask(spans, len(found))
                if keep is None:
                    texts.append(old)
                elif not keep.any():
                    texts.append("")
                else:
                    out, at = [], 0
                    for lo, hi in spans_of(np.flatnonzero(~keep)):
                        out.append(raw[at : found[lo].start()])
                        at = found[hi].end()
                    texts.append(b"".join([*out, raw[at:]]).decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    columns = docs.columns
    key_at, spans_at = free_name(columns, "key"), free_name(columns, "spans")
    found = _spans(docs, length, gram).withColumnsRenamed({"key": key_at, "spans": spans_at})
    out = (
        docs.withColumn(key_at, text_key())
        .join(found, ["doc_id", key_at], "left")
        .select(*columns, spans_at)
        .mapInArrow(put, docs.schema)
    )
    out = out.filter(F.col("text").isNull() | (F.col("text") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
