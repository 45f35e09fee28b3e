"""Toxicity by compression distance with zstandard dictionaries.

Training. Of the labelled rows that may be learnt from, at most SAMPLE toxic and SAMPLE ordinary ones are used,
in the order of md5(doc_id): a documented bound, as this fits a classifier. Of a text over LIMIT code points a span of
LIMIT is learnt from, at a place drawn by that md5. Both dictionaries are made by zstd's trainer, the ordinary one from the words of
ordinary texts, the toxic one from the stretches of words of toxic texts made of 4-grams that toxic documents have far more
often than ordinary ones: trained on toxic texts as they are, it holds what both kinds share (held-out AUC 0.49 to 0.75, see README).
The commonest words and stretches that the trainer leaves out, as it does with few samples, follow after its dictionary.

Scoring. A window is one word with a space at each end. It is compressed with either dictionary behind a lead
that both end in, which pays for the first sequence of a frame, so that the difference of the two lengths is
what the dictionary explains of the word. Each difference has a weight, the log ratio of its rates in toxic and
ordinary training text; differences under a threshold, and words that share no 4 bytes with the toxic dictionary and can't
be shortened by it, have one negative weight together. A text's evidence is the largest sum of weights over any stretch of its words, so that
neither a long clean rest hides a toxic passage nor hits far apart add up. The best stretch of ordinary text grows with
the logarithm of its words; log odds are linear in the evidence less that logarithm and in the logarithm, fitted to the
labels. Weights and fit use differences by dictionaries of the other half of the training rows only.

Edge cases: null, empty and wordless texts get the score of no evidence; without toxic or ordinary training rows all
do, at the labels' own odds, half a document added to each; repeated rows give equal rows; very long texts are scored whole;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, LIMIT, LEAST_WEIGHT, GRAM = 1500, 20_000, 2.5, 4
LEAD = b"<<>>[[]]{{}}##@@"
KEPT_WORDS, MOST = 200_000, 8.0
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
WORD = regex.compile(r"\p{L}+")


def grams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def word_set(text: str) -> set[str]:
    return {f" {w} " for w in WORD.findall(text.lower())}


@dataclass
class Classifier:
    ordinary: bytes
    toxic: bytes
    odds: float
    weight: dict[int, float] = field(default_factory=dict)
    line: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def start(self) -> Classifier:
        """Compressors are made where they are used; they can't be sent to another process."""
        self.squeeze = [self.compressor(x + LEAD).compress for x in (self.ordinary, self.toxic)]
        self.parts = {self.toxic[i : i + GRAM] for i in range(len(self.toxic) - GRAM + 1)}
        self.kept: dict[str, int] = {}
        return self

    @staticmethod
    def compressor(content: bytes) -> zstd.ZstdCompressor:
        options = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY2, min_match=3, window_log=14, hash_log=12, chain_log=12, search_log=6, target_length=16,
                                                 write_checksum=False, write_content_size=False, write_dict_id=False)
        return (
            zstd
            .ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=options)
        )

    def distance(self, word: str) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one, 0 to 9; -1 if it can't match the word at all."""
        found = self.kept.get(word)
        if found is None:
            raw = f" {word} ".encode()
            found = -1
            if not self.parts.isdisjoint([raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)]):
                raw = LEAD + raw
                found = max(0, min(9, len(self.squeeze[0](raw)) - len(self.squeeze[1](raw))))
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            if len(word) < 64:
                self.kept[word] = found
        return found

    def score(self, text: str | None) -> float:
        found = list(map(self.distance, WORD.findall(text.lower()))) if text else []
        total = self.odds + sum(a * x for a, x in zip(self.line, (1.0, *evidence(found, self.weight)), strict=True)) if found else self.odds
        return 1 / (1 + math.exp(-max(-30.0, min(total, 30.0))))


def evidence(found: list[int], weight: dict[int, float]) -> tuple[float, float]:
    """The largest sum of weights over a stretch of words (0 for none) less the log of the number of words, at most MOST; that log."""
    best = total = 0.0
    for n in found:
        total += weight.get(n, 0.0)
        if total < 0.0:
            total = 0.0
        elif total > best:
            best = total
    size = math.log1p(len(found))
    return min(best - size, MOST), size


def dictionaries(toxic: list[str], ordinary: list[str]) -> Classifier:
    """A classifier without weights."""
    share = [Counter(), Counter()]
    for y, texts in enumerate((ordinary, toxic)):
        for t in texts:
            share[y].update({g for w in word_set(t) for g in grams(w)})
    scale = len(toxic) / max(1, len(ordinary))
    telling = {g for g, n in share[1].items() if n >= max(3, 0.004 * len(toxic)) and n >= 20 * (share[0][g] * scale + 0.3)}
    samples, cores, common = [], Counter(), Counter()
    for t in toxic:
        found = []
        for w in WORD.findall(t.lower()):
            w = f" {w} "
            hit = [i for i, g in enumerate(grams(w)) if g in telling]
            if hit:
                lo, hi = hit[0], hit[-1] + GRAM
                found.append(w[lo - (lo == 1) : hi + (hi == len(w) - 1)])
        cores.update(set(found))
        if found:
            samples.append("".join(found).encode())
    for t in ordinary:
        common.update(word_set(t))
    words = [f" {' '.join(WORD.findall(t.lower()))} ".encode() for t in ordinary]
    least = max(3, 0.002 * len(toxic))
    return Classifier(dictionary(words, common, 1000, 1, ORDINARY_BYTES), dictionary(samples, cores, 400, least, TOXIC_BYTES), 0.0).start()


def dictionary(samples: list[bytes], pieces: Counter, most: int, least: float, size: int) -> bytes:
    """A dictionary by zstd's trainer, and after it those of the commonest pieces that the trainer left out, as it does where samples are few."""
    try:
        base = zstd.train_dictionary(size, samples, k=50, d=8).as_bytes()
    except (zstd.ZstdError, ValueError):
        base = b""
    top = sorted((x for x, n in pieces.items() if n >= least), key=lambda x: (-pieces[x], x))[:most]
    return base + "|".join(reversed([x for x in top if x.encode() not in base])).encode()[-size:]


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Classifier:
    """A classifier from bounded lists of toxic and ordinary texts; odds: log odds of the class where they differ from the lists' own."""
    own = math.log((len(toxic) + 0.5) / (len(ordinary) + 0.5))
    out = dictionaries(toxic, ordinary)
    out.odds = own if odds is None else odds
    if toxic and ordinary:
        held = [], []
        for k in (0, 1):
            judge = dictionaries(toxic[1 - k :: 2], ordinary[1 - k :: 2])
            for y, texts in enumerate((ordinary, toxic)):
                held[y].extend([judge.distance(w) for w in WORD.findall(t.lower())] for t in texts[k::2])
        rate = [Counter(n for found in x for n in found) for x in held]
        all_ = [c.total() + 10 for c in rate]
        ratio = lambda *n: math.log((sum(rate[1][i] for i in n) + 0.5) / all_[1]) - math.log((sum(rate[0][i] for i in n) + 0.5) / all_[0])
        rest = [n for n in range(-1, 10) if n < 1 or not rate[1][n] or ratio(n) < LEAST_WEIGHT]
        out.weight = {-1: min(0.0, ratio(*rest))}
        for n in range(10):  # a difference not met in training weighs as the next smaller one
            out.weight[n] = ratio(n) if n not in rest else out.weight[-1] if rate[0][n] or rate[1][n] else out.weight[n - 1]
        seen = [(*evidence(found, out.weight), y) for y in (0, 1) for found in held[y] if found]
        if len({y for *_, y in seen}) == 2:
            base, *line = logistic(np.array([x[:2] for x in seen]), np.array([x[2] for x in seen]))
            out.line = base - own, *line
    out.squeeze = out.parts = out.kept = None
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Intercept and slopes of the log odds of y; the ridge keeps slopes finite where the classes are apart."""
    x = np.column_stack([np.ones(len(x)), x])
    b, hold = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    loss = lambda b: np.logaddexp(0, x @ b).sum() - y @ (x @ b) + b @ hold @ b / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + hold, x.T @ (p - y) + hold @ b)
        while loss(b - step) > loss(b) and abs(step).max() > 1e-9:
            step = step / 2
        b = b - step
        if abs(step).max() < 1e-8:
            break
    return b.tolist()


def trained(docs: DataFrame, labels: DataFrame, kept: Column, sample: int = SAMPLE) -> Classifier:
    """Fit on the labelled rows for which `kept` is true; labels: doc_id, toxic."""
    rows = labels.filter(kept & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    order, texts = F.md5(F.col("doc_id").cast("string")), {}
    odds = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    at = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.length("text") - LIMIT + 1) + 1
    usable = docs.filter(F.col("text").isNotNull()).select("doc_id", F.substring("text", at.cast("int"), F.lit(LIMIT)).alias("text"))
    for y in (0, 1):
        ids = rows.filter(F.col("toxic") == y).select("doc_id", order.alias("o")).orderBy("o").limit(sample)
        # at most `sample` ids, hence the broadcast
        texts[y] = [r.text for r in usable.join(F.broadcast(ids), "doc_id").orderBy("o", "text").limit(sample).collect()]
    return fit(texts[1], texts[0], math.log((odds.get(1, 0) + 0.5) / (odds.get(0, 0) + 0.5)))


def scores(docs: DataFrame, classifier: Classifier, *columns: str, name: str = "score") -> DataFrame:
    """doc_id, the score as `name`, and the named further columns of each row."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)
    names = ["doc_id", *columns]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{name}` double"

    def put(batches):
        judge = held.value.start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([judge.score(t.as_py()) for t in batch.column("text")], pa.float64())],
                names=[*names, name],
            )

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(put, schema)
