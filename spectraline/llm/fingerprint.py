"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003).

Rolling hashes of all k-grams of code points; in each window of w of them the least is chosen, the rightmost
on ties; chosen hashes are kept with their positions. Two texts that share k + w - 1 code points in a row
share a chosen hash. A written fingerprint has the chosen hashes (32 bits of them) and positions, so likeness and shared
places follow from two of them. A text shorter than that has one window; one shorter than k is one gram of its own.

Edge cases: null is the empty text, whose fingerprint is empty; two empty fingerprints are alike to 1. Equal
doc_ids are ordered by text; rows with a null doc_id come last in descending order; very long texts are used whole;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraline.llm.words import U, mix, powers

K, WINDOW, BLOCKS, BLOCK_ROWS = 16, 32, 20_000, 1000


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    if not len(code):
        return np.zeros(0, U), np.zeros(0, np.int64)
    k = min(k, len(code))
    h, size, power = np.zeros(len(code) - k + 1, U), 0, powers(k + 1)
    gram, step = code, 1  # gram: hashes of all runs of `step` code points; k is the sum of the powers of two that it holds
    while step <= k:
        if k & step:
            h = h * power[step] + gram[size : size + len(h)]
            size += step
        if 2 * step <= k:
            gram = gram[:-step] * power[step] + gram[step:]
        step *= 2
    h = mix(h)
    best, span, w = np.arange(len(h)), 1, min(w, len(h))
    while span < w:
        step = min(span, w - span)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        span += step
    at = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


PAIR = np.dtype([("hash", ">u4"), ("position", ">u4")])


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: 16 hexadecimal digits for each chosen gram, the last 8 of its hash and 8 of its position."""
    pairs = np.empty(len(hashes), PAIR)
    pairs["hash"], pairs["position"] = hashes & U(0xFFFFFFFF), positions
    return pairs.tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a written fingerprint."""
    pairs = np.frombuffer(bytes.fromhex(fingerprint), PAIR)
    return pairs["hash"].astype(np.int64), pairs["position"].astype(np.int64)


def written_likeness(a: str, b: str) -> float:
    """Likeness of two written fingerprints."""
    return likeness(read(a)[0], read(b)[0])


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long>, positions array<long>: the winnowed fingerprint of each text."""

    def put(batches):
        for batch in batches:
            found = [winnow(t or "", k, w) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.view(np.int64) for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                                             names=["doc_id", "hashes", "positions"])

    return docs.select("doc_id", "text").mapInArrow(put, "doc_id long, hashes array<long>, positions array<long>")


def _deal(bounds: list, heads: dict):
    """Block of each row by doc_id; the first row of a block, in descending order, is also dealt to the end of the block before."""
    edges = np.array(bounds, np.int64)

    def put(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            block = np.searchsorted(edges, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            tail = pa.array(np.zeros(len(ids), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(block), tail, ids, batch.column("text")], names=["block", "tail", "doc_id", "text"])
            again = [i for i, x in enumerate(ids.to_pylist()) if x in heads]
            if again:
                to = pa.array([heads[ids[i].as_py()] for i in again], pa.int64())
                at = pa.array(again)
                yield pa.RecordBatch.from_arrays(
                    [to, pa.array(np.ones(len(again), np.int32)), ids.take(at), batch.column("text").take(at)],
                    names=["block", "tail", "doc_id", "text"],
                )

    return put


def _pairs(judge):
    """Give judge(text, next text, seen) each row with its next; rows come sorted within blocks; seen is dropped when a block ends."""

    def put(batches):
        held = None
        for batch in batches:
            out = []
            for block, tail, doc, text in zip(*(batch.column(c) for c in ("block", "tail", "doc_id", "text")), strict=True):
                now = (block.as_py(), doc.as_py(), text.as_py() or "")
                if held is not None and held[0] == now[0]:
                    out.append({"doc_id": held[1]} | judge(held[2], now[2]))
                held = None if tail.as_py() else now
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return put


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, k: int = K, w: int = WINDOW, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced from the next document, and their likeness.

    The next document is the next in descending doc_id, after the last the first. Ids are cut into blocks of about
    BLOCK_ROWS rows, at most `blocks`, at quantiles; only the blocks' first ids (so at most `blocks` numbers) reach the driver.
    Repeated doc_ids make the first row of their block stand for all of them where blocks meet.
    """
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id")
    blocks = max(2, min(blocks, docs.count() // BLOCK_ROWS))
    share = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", share, 10 * blocks)).first()[0] or []))
    low = -(2**63)

    def top(batches):
        cuts = np.array(bounds, np.int64)
        for batch in batches:
            x = batch.column("doc_id").fill_null(low).to_numpy()
            block = np.searchsorted(cuts, x, side="right")
            best = np.full(len(cuts) + 1, low, np.int64)
            np.maximum.at(best, block, x)
            some = np.unique(block)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], names=["block", "top"])

    tops = sorted(ids.mapInArrow(top, "block long, top long").groupBy("block").agg(F.max("top").alias("top")).collect(), reverse=True)
    heads = {}
    for at, (_, first) in enumerate(tops):
        heads[None if first == low else first] = tops[at - 1][0]  # the first block's head ends the last block
    seen: dict[str, tuple] = {}

    def marked(text: str) -> tuple[str, np.ndarray]:
        """The written fingerprint and the hashes in it."""
        h, at = winnow(text, k, w)
        return written(h, at), h & U(0xFFFFFFFF)

    def judge(text: str, after: str) -> dict:
        own = seen.pop(text, None)
        if own is None:
            own = marked(text)
        follow = marked(after)
        seen.clear()
        seen[after] = follow
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        other = marked(changed)
        return {"n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": own[0], "edited_fingerprint": other[0],
                "near_edited": likeness(own[1], other[1]), "near_next": likeness(own[1], follow[1])}

    dealt = docs.mapInArrow(_deal(bounds, heads), "block long, tail int, doc_id long, text string")
    return (
        dealt.repartition("block")
        .sortWithinPartitions("block", "tail", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(_pairs(judge), DDL)
    )
