"""Byte-pair encoding by a tokenization automaton (after Berglund, Martens, van der Merwe).

Merge gadgets are applied in order of rank to an automaton over the byte arcs. The gadget of merge (u, v)
takes arc v away from the state that arc u enters, and adds an arc uv beside the path u v where that path is
still there. The result is deterministic: it accepts one token path for each byte string, the one greedy
merging makes. A state is known by the arc that enters it, so the gadgets leave these tables: the arcs of the
start state as a byte trie of live tokens, and for state t and arc x whether some gadget took x away.
The latter rows are filled when first asked for and kept, which spares the full square table of 50k states.
A pre-split word is run over the tables from left to right; decoding emits the labels of the arcs.

Pre-splitting is that of byte-level BPE; strings of special tokens are cut out first, as the tokenizers
library does by default.

Edge cases: null is the empty text, without ids; repeated rows give equal rows; very long texts are read whole, word by word, in a time that
grows with their length; an empty table gives an empty result; further columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The pattern of byte-level pre-splitting.
PATTERN = (
    regex
    .compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
)
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
KEPT_WORDS = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        letter, vocab = byte_letters(), spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.label = {i: bytes(letter[c] for c in t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.labels = [self.label.get(i, b"") for i in range(max(self.label) + 1)]
        self.size = list(map(len, self.labels))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.gadget, self.born, self.parts = {}, {}, {}
        for rank, (u, v) in enumerate(pairs):
            a, b, whole = vocab[u], vocab[v], vocab[u + v]
            self.gadget[a, b] = rank
            if whole not in self.born:
                self.born[whole], self.parts[whole] = rank, (a, b)
        self.after: dict[tuple[int, int], bool] = {}
        self.trie: dict = {}
        for t, label in self.label.items():
            if t in self.parts and self.removed(*self.parts[t], self.born[t]) or t in self.special.values() or t not in self.parts and len(label) > 1:
                continue
            node = self.trie
            for b in label:
                node = node.setdefault(b, {})
            node[-1] = t

    def edge(self, t: int, side: int, end: int) -> list[tuple[int, int]]:
        """Tokens at one end of t as merging goes on, each with the rank at which it becomes part of the next."""
        out = [(t, end)]
        while t in self.parts:
            out.append((self.parts[t][side], self.born[t]))
            t = self.parts[t][side]
        return out

    def removed(self, t: int, x: int, end: int = 1 << 60) -> bool:
        """Whether a gadget of a rank below `end` takes arc x from state t: a merge of tokens that meet there while both stand.

        Of equal merges that overlap the left one is made, hence the two comparisons.
        """
        right = self.edge(x, 0, end)
        for u, until in self.edge(t, 1, end):
            for v, to in right:
                rank = self.gadget.get((u, v))
                if rank is not None and rank < until and (rank <= to and rank < end):
                    return True
        return False

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path: arcs are followed longest first, and places from which no arc goes on are left again.

        A prefix has one accepted path as well, so a place that was left once need not be entered again.
        """
        trie, after, size, n = self.trie, self.after, self.size, len(word)
        out: list[int] = []
        at, state, open_, left = 0, -1, [], set()
        while True:
            node, arcs = trie, []
            for j in range(at, n):
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None:
                    arcs.append(t)
            open_.append(arcs)
            while True:
                while not arcs:
                    open_.pop()
                    arcs = open_[-1]
                    left.add(at)
                    at -= size[out.pop()]
                    state = out[-1] if out else -1
                t = arcs.pop()
                if at + size[t] in left:
                    continue
                if state >= 0:
                    gone = after.get((state, t))
                    if gone is None:
                        if len(after) > 500_000:
                            after.clear()
                        gone = after[state, t] = self.removed(state, t)
                    if gone:
                        continue
                break
            out.append(t)
            at += size[t]
            state = t
            if at == n:
                return out

    def encode(self, text: str, kept: Splitter) -> bytes:
        """Ids as little-endian 32-bit integers. Pre-splits never cross a single space between two letters, digits or marks, so what stands there is known as a whole."""
        if self.cut is None or not any(x in text for x in self.special):
            return kept.ids(text)
        return b"".join([np.array([self.special[x]], "<u4").tobytes() if x in self.special else kept.ids(x) for x in self.cut.split(text)])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Kept(dict):
    """What make() gave for words met before. When full, only words met since the last time it was full stay."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) < 64:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Uneven(Exception):
    """A piece between two spaces that is empty or has white space at an end, so that pre-splits may cross its spaces."""


class Splitter:
    """Ids of texts without special tokens."""

    def __init__(self, machine: Automaton) -> None:
        self.words = Kept(lambda word: np.array(machine.encode_word(word.encode()), "<u4").tobytes())
        self.pieces = Kept(self.spaced)

    def split(self, text: str) -> bytes:
        return b"".join([self.words[x] for x in PATTERN.findall(text)])

    def spaced(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Uneven
        return self.split(" " + piece)

    def ids(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            if head and not head[-1].isspace():
                return self.split(head) + b"".join(map(self.pieces.__getitem__, rest))
        except Uneven:
            pass
        head, *rest = LONE_SPACE.split(text)
        return b"".join([self.split(head), *[self.split(" " + x) for x in rest]])


@lru_cache(1)
def machine_of(definition: str) -> Automaton:
    """One automaton for all tasks of a worker; what it has split is kept within a task only, so that idle workers stay small."""
    return Automaton(definition)


def encode_decode(docs: DataFrame, path: str, texts: bool = True) -> DataFrame:
    """doc_id, ids array<long>, decoded; without texts, doc_id, n_tokens, ids_sha256, decoded_sha256.

    The vocabulary file at `path` is read by the driver and broadcast: its size does not depend on the data.
    """
    with open(path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())

    def put(batches):
        machine = machine_of(held.value)
        kept = Splitter(machine)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for text in part.column("text").to_pylist():
                    raw = machine.encode(text or "", kept)
                    ids = np.frombuffer(raw, "<u4")
                    decoded = machine.decode(ids)
                    out.append((ids.astype(np.int64), decoded) if texts else (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                columns = zip(*out, strict=True)
                kinds = [pa.list_(pa.int64()), pa.string()] if texts else [pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["doc_id", "ids", "decoded"] if texts else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return (
        docs.select("doc_id", "text")
        .mapInArrow(put, "doc_id long, ids array<long>, decoded string" if texts else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    )
