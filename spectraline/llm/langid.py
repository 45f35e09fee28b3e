"""Language identification by cross-parsing entropy.

From each language's labelled training text a suffix automaton is made, of a bounded sample: SAMPLE documents in the order of
md5(doc_id), of each a span of at most LIMIT code points from a place drawn by that md5, at most SYMBOLS code points in all.
A text is lower-cased and its runs of letters are joined by one space. Cross-parsing it with a language, from each place the
longest match in the language's text makes a phrase, the next phrase starts after it; phrases may cross words. The language
whose text parses it into the fewest phrases, normalised by code points and by the logarithm of its text's length, wins; ties
go to the smaller name. The score is the softmax share of the winner over mean bits per code point.

Texts are used whole, of any length; repeated rows get equal results; further columns are ignored.
Edge cases: null text or text without a letter gives `und` with score 0; without training text all do; an empty table gives
an empty result; rows without a language, text or doc_id are learnt from only if they have the former two.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraline.llm.automaton import SuffixAutomaton

SAMPLE, LIMIT, SYMBOLS = 60, 4000, 40_000
LETTERS = regex.compile(r"\p{L}+")


def training_rows(docs: DataFrame, kept: Column, sample: int = SAMPLE, limit: int = LIMIT) -> dict[str, str]:
    """Bounded training text of each language; `kept` is a Column that is true on rows that may be learnt from."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    at = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.length("text") - limit + 1) + 1
    rows = (
        docs.filter(kept & F.col("lang").isNotNull() & (F.length("text") > 0))
        .select("lang", order.alias("o"), F.substring("text", at.cast("int"), F.lit(limit)).alias("text"))
    )
    # of each language no more than `sample` rows leave a task: the ranks are cut before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))
    found: dict[str, list] = {}
    for r in rows.withColumn("rank", rank).filter(F.col("rank") <= sample).collect():
        found.setdefault(r.lang, []).append((r["rank"], r.text))
    return {lang: " ".join(letters(text) for _, text in sorted(found[lang]))[:SYMBOLS] for lang in sorted(found)}


def letters(text: str) -> str:
    return " ".join(LETTERS.findall(text.lower()))


def automaton(text: str) -> dict:
    """The start state of the suffix automaton of a text; a state is a dict from symbols to states."""
    machine = SuffixAutomaton()
    machine.add(text)
    states: list[dict] = [{} for _ in machine.next]
    for state, arcs in zip(states, machine.next, strict=True):
        state.update({c: states[to] for c, to in arcs.items()})
    return states[0]


def phrases(start: dict, text: str) -> int:
    """Number of phrases of the cross-parse; a symbol that the automaton lacks is a phrase by itself."""
    n, state = 0, {}
    for c in text:
        to = state.get(c)
        if to is None:
            n += 1
            to = start.get(c, {})
        state = to
    return n


class CrossParser:
    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        self.starts = [automaton(f" {texts[name]} ") for name in self.names]
        self.bits = np.array([math.log2(len(texts[name]) + 2) for name in self.names])

    def predict(self, text: str | None) -> tuple[str, float]:
        plain = letters(text) if text and self.names else ""
        if not plain:
            return "und", 0.0
        plain = f" {plain} "
        bits = np.array([phrases(s, plain) for s in self.starts]) * self.bits / len(plain)
        best = int(np.argmin(bits))
        return self.names[best], float(1 / np.exp((bits[best] - bits) * math.log(2) * 4).sum())


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score of each row; texts: bounded training text of each language."""
    held = docs.sparkSession.sparkContext.broadcast(texts)

    def put(batches):
        parser = CrossParser(held.value)
        for batch in batches:
            found = [parser.predict(t.as_py()) for t in batch.column("text")]
            names, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(put, "doc_id long, lang_pred string, score double")
