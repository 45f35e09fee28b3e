"""Scores of texts by a hidden Markov language model.

Tokens are lower-cased words and one end per text. Every word has a symbol: the SYMBOLS commonest training
tokens one each, all others the class of their last byte and length. Latent states emit symbols; a word in a class is drawn with
probability (c + 1) / (N + V + 1) of that class's counts, one share being left for words never seen, so each
text has an exact likelihood. It is the scaled forward recursion's sum of log scales plus the words' own terms.

Training. Word counts cover all training rows. Baum-Welch starts from state-dependent seeds and makes EARLY passes over one
in SHARE of the training rows, whole texts chosen by their hash, then LATE over all of them; each task adds up expected counts, which meet in one sum per state and symbol.
Training and scoring run over whole texts, all rows of a slice in step from their starts. For the backward pass of training,
forward rows are kept at every BLOCK-th token and made again block by block, which bounds memory for very long texts. Words outside the HEAD commonest are joined to their counts by
shuffle: what is broadcast is bounded by SYMBOLS, HEAD and STATES, whatever the data. Words are known by 64-bit hashes.

Edge cases: null or empty text is one end; a null doc_id is a training row; equal rows get equal scores;
without training rows every token is unseen; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraline.llm.shared import cut
from spectraline.llm.words import U, mix, slices, words

STATES, SYMBOLS, HEAD, BLOCK, SLICE = 8, 4000, 100_000, 256, 6_000_000
#: Passes over a share (one row in SHARE) of the training rows, whole texts by their hash, then over all of them.
EARLY, SHARE, LATE = 8, 8, 2
END = int(mix(np.array([0xE0D], U)).view(np.int64)[0])
CLASSES = 1024
SEED = 3


def classes(last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Class of a word by its last byte and its length in bytes."""
    return last.astype(np.int64) * 4 + np.minimum(3, size // 4)


@dataclass
class Tokens:
    """Tokens of n rows, each row's end last: row, hash, class."""

    n: int
    row: np.ndarray
    hash: np.ndarray
    kind: np.ndarray
    first: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    w = words(column, lower=True)
    first = w.first()
    ends = first[1:] + np.arange(w.n)  # each row has its words and one end
    total = len(w.hash) + w.n
    is_word = np.ones(total, bool)
    is_word[ends] = False
    row, h, kind = np.empty(total, np.int64), np.full(total, END, np.int64), np.zeros(total, np.int64)
    row[ends] = np.arange(w.n)
    row[is_word] = w.row
    h[is_word] = w.hash.view(np.int64)
    if len(w.hash):
        kind[is_word] = classes(w.data[w.end - 1], w.end - w.start)
    return Tokens(w.n, row, h, kind, np.concatenate([[0], ends + 1]))


def look_up(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the sorted keys; -1 where absent."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, kind, c): counts of all tokens; each task sums its own words first."""

    def put(batches):
        held: list[np.ndarray] = []
        size = 0

        def out():
            h, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            return keys, kind[first], np.bincount(back, n).astype(np.int64)

        for batch in batches:
            for part in slices(batch):
                t = tokens(part.column("text"))
                keys, first, n = np.unique(t.hash, return_index=True, return_counts=True)
                held.append((keys, t.kind[first], n))
                size += len(keys)
                if size > 1_000_000:
                    held = [out()]
                    size = len(held[0][0])
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["h", "kind", "c"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], names=["h", "kind", "c"])

    return (
        docs.select("text")
        .mapInArrow(put, "h long, kind long, c long")
        .groupBy("h")
        .agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))
    )


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the tokens with a symbol of their own
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x (len(keys) + CLASSES)

    def symbols(self, t: Tokens) -> np.ndarray:
        at = look_up(self.keys, t.hash)
        return np.where(at >= 0, at, len(self.keys) + t.kind)

    def forward(self, symbol: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Natural log likelihood of each row's symbols: scaled forward recursion, all rows in step, longest first."""
        size = np.diff(first)
        order, total, alpha = np.argsort(-size, kind="stable"), np.zeros(len(size)), None
        for part in blocks(size[order], block):
            rows, scale, _, _ = self.advance(part, symbol[first[:-1][order][part.row] + part.step], alpha)
            alpha = rows[part.at[-2] :]
            total[: part.at[1]] += np.bincount(part.row, np.log(scale))
        out = np.empty(len(size))
        out[order] = total
        return out

    def advance(self, part: Block, symbol: np.ndarray, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward rows of a block in step order, their scales, the emission rates and the symbols."""
        emitted = self.emit.T[symbol]
        rows, scale = np.empty(emitted.shape), np.empty(len(symbol))
        for lo, hi in itertools.pairwise(part.at):
            x = rows[lo:hi]
            if alpha is None:
                x[:] = self.start
            else:
                np.matmul(alpha[: hi - lo], self.move, out=x)
            x *= emitted[lo:hi]
            x.sum(axis=1, out=scale[lo:hi])
            x /= scale[lo:hi, None]
            alpha = x
        return rows, scale, emitted, symbol

    def expected(self, symbol: np.ndarray, first: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of whole rows: starts, moves, emissions."""
        k, width = len(self.start), self.emit.shape[1]
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, width))
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, parts, entries = first[:-1][order], list(blocks(size[order], block)), [None]
        for part in parts[:-1]:  # forward rows at the ends of blocks; the blocks are made again on the way back
            entries.append(self.advance(part, symbol[begin[part.row] + part.step], entries[-1])[0][part.at[-2] :].copy())
        later = np.zeros((0, k))  # of the step after: emission times backward row over scale
        for part, entry in zip(reversed(parts), reversed(entries), strict=True):
            rows, scale, emitted, seen = self.advance(part, symbol[begin[part.row] + part.step], entry)
            emitted /= scale[:, None]
            beta, ahead = np.ones(rows.shape), np.empty(rows.shape)
            for lo, hi in reversed(list(itertools.pairwise(part.at))):
                np.matmul(later, self.move.T, out=beta[lo : lo + len(later)])
                later = np.multiply(beta[lo:hi], emitted[lo:hi], out=ahead[lo:hi])
            cut = part.at[1]  # rows of the block's first step come from the block before, or are starts
            if entry is not None:
                moves += self.move * (entry[:cut].T @ ahead[:cut])
            before = part.at[part.step[cut:] - part.step[0] - 1] + part.row[cut:]
            moves += self.move * (rows[before].T @ ahead[cut:])
            rows *= beta
            if entry is None:
                starts += rows[:cut].sum(axis=0)
            for j in range(k):
                emits[j] += np.bincount(seen, rows[:, j], width)
        return starts, moves, emits


@dataclass
class Block:
    """Tokens of rows that go in step, some steps long: at[i]..at[i + 1] are those of step i, row and step of each token."""

    at: np.ndarray
    row: np.ndarray
    step: np.ndarray


def blocks(size: np.ndarray, block: int) -> Iterator[Block]:
    """Blocks of at most `block` steps of rows with these sizes, which fall."""
    steps = int(size[0]) if len(size) else 0
    for lo in range(0, steps, block):
        step = np.arange(lo, min(lo + block, steps))
        live = np.searchsorted(-size, -step, side="left")  # rows longer than a step
        at = np.concatenate([[0], np.cumsum(live)])
        yield Block(at, np.arange(at[-1]) - np.repeat(at[:-1], live), np.repeat(step, live))


def seeded(keys: np.ndarray, weight: np.ndarray, states: int, seed: int = SEED) -> Model:
    """First parameters: the symbols' own rates, tilted by state with a fixed generator."""
    rng = np.random.default_rng(seed)
    emit = (weight + 0.5) * rng.uniform(0.2, 1.8, (states, len(weight)))
    move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
    return Model(keys, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def baum_welch(docs: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One pass: expected counts of all rows, summed by row and column of the three tables."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    k, width = model.emit.shape

    def put(batches):
        total = np.zeros((k, 1 + k + width))
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                t = tokens(part.column("text"))
                starts, moves, emits = held.value.expected(held.value.symbols(t), t.first)
                total[:, 0] += starts
                total[:, 1 : 1 + k] += moves
                total[:, 1 + k :] += emits
        state, at = np.nonzero(total > 1e-9)
        yield pa.RecordBatch.from_arrays(
            [pa.array(state.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[state, at])],
            names=["state", "at", "n"],
        )

    summed = docs.select("text").mapInArrow(put, "state int, at int, n double").groupBy("state", "at").agg(F.sum("n").alias("n"))
    total = np.zeros((k, 1 + k + width))
    for r in summed.collect():  # states * (1 + states + symbols) numbers at most
        total[r.state, r["at"]] = r.n
    start, move = total[:, 0] + 0.1, total[:, 1 : 1 + k] + 0.1
    emit = total[:, 1 + k :] + prior[None, :]
    return Model(model.keys, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def language_model_scores(docs: DataFrame, held_out: Column, states: int = STATES, symbols: int = SYMBOLS, head: int = HEAD, rounds: tuple[int, int] = (EARLY, LATE), share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learns from rows that are not held out."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    train = docs.filter(~F.col("held_out"))
    count = cut(word_counts(train), "counts")
    n_all, v_all = count.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = count.orderBy(F.desc("c"), "h").limit(head).toArrow()
    h, c, kind = (top.column(x).to_numpy() for x in ("h", "c", "kind"))
    order = np.argsort(h[:symbols])
    keys, own = h[:symbols][order], c[:symbols][order]
    of_class = np.zeros((2, CLASSES))
    for r in count.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        of_class[:, r.kind] = r.n, r.v
    for j in (0, 1):
        of_class[j] -= np.bincount(kind[:symbols], c[:symbols] if j == 0 else None, CLASSES)
    rates = np.concatenate([own, of_class[0]]).astype(float)
    prior = 0.5 * (rates + 0.5) / (rates + 0.5).sum() * len(rates)
    model = seeded(keys, rates, states)
    some = train.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    for rows in [some] * rounds[0] + [train] * rounds[1]:
        model = baum_welch(rows, model, prior)
    log_class = np.log10(of_class.sum(axis=0) + 1)  # a class's tokens, its distinct ones, and one share for unseen words
    order = np.argsort(h)
    known, c_known = h[order], c[order]
    base = np.log10(n_all + v_all + 1)
    held = docs.sparkSession.sparkContext.broadcast((model, known, c_known, log_class))

    def put(batches):
        model, known, c_known, log_class = held.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                t = tokens(part.column("text"))
                s = model.symbols(t)
                score = model.forward(s, t.first) / np.log(10)
                at = look_up(known, t.hash)
                inside = at >= 0
                log_c = np.log10(np.where(inside, c_known[np.maximum(at, 0)] if len(known) else 0, 0) + 1.0)
                in_class = s >= len(model.keys)
                score += np.bincount(t.row, np.where(in_class, np.where(inside, log_c, 0) - log_class[t.kind], 0), t.n)
                sums = np.bincount(t.row, np.where(inside, log_c, 0), t.n)
                size = np.diff(t.first)
                row, far = t.row[~inside], t.hash[~inside]
                order = np.lexsort((far, row))
                row, far = row[order], far[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (far[1:] != far[:-1])
                cuts = np.append(np.flatnonzero(new), len(row))
                per_row = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=t.n))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(per_row), pa.array(x)) for x in (far[new], np.diff(cuts).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(np.bincount(t.row, inside, t.n).astype(np.int64)), pa.array(sums), pa.array(score), *lists],
                                                 names=["doc_id", "held_out", "n_tokens", "n_near", "near_log", "score", "far", "times"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_near long, near_log double, score double, far array<long>, times array<int>"
    rows = cut(docs.mapInArrow(put, schema).withColumn("id", F.monotonically_increasing_id()), "rows")
    far = (
        rows.select("id", F.explode(F.arrays_zip("far", "times")).alias("x"))
        .select("id", F.col("x.far").alias("h"), F.col("x.times").alias("times"))
    )
    met = (
        far.join(count.select("h", "c"), "h")
        .groupBy("id")
        .agg(F.sum("times").alias("n_far"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("far_log"))
    )
    out = (
        rows.drop("far", "times")
        .join(met, "id", "left")
        .withColumns({"n_far": F.coalesce("n_far", F.lit(0)), "far_log": F.coalesce("far_log", F.lit(0.0))})
    )
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_near") + F.col("n_far")).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                      (F.col("near_log") + F.col("far_log") - F.col("n_tokens") * F.lit(float(base))).alias("base_score"), (F.col("score") + F.col("far_log")).alias("score"))
