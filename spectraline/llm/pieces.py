"""SentencePiece encoding and decoding for merge-type vocabularies, by a table of each prefix's last token.

Merging joins, best score first and leftmost first, neighbours whose union is a piece. Its result for a text is the one
sequence in which every two neighbours stand the test of the pair: merging the two alone makes no token across their border.
So the last token of a prefix that ends at i is the one token t ending at i that is compatible with the last token of the prefix
before t. An automaton of all pieces (Aho and Corasick) names the tokens that end at i; the table keeps the one that passes, and
the ids are read off backwards from the end. The test of a pair runs over the two tokens' own merges, of which only the
ends that face each other matter; its answers are kept, up to a bound.

Where two characters stand side by side in no piece, a border is certain. White space marks after another character, and ASCII
characters that no piece has, are such places in all usual vocabularies; texts are looked up by the stretches between them, each
of which has a table of its own. Characters outside the vocabulary become byte pieces if it has them, else the unknown id.

Edge cases: null is the empty text, which has the end id only; repeated rows give equal rows; very long texts are read
whole, in a time that grows with their length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from spectraline.llm.bpe import Kept

# The white space mark of the model files, and their kinds of pieces and of models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MERGES = 2
KEPT_PAIRS = 500_000


def fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised message."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        out.append((key >> 3, value))
    return out


class Vocabulary:
    """Pieces of a model file with their scores and kinds. Only what this module can encode exactly is let in."""

    def __init__(self, raw: bytes) -> None:
        self.piece, self.score, self.kind = [], [], []
        trainer, normalizer = {}, {}
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                self.piece.append(own[1].decode())
                self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != MERGES:
            raise ValueError("the model must be of the merge type")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("only models that keep all characters, put a mark first and escape white space are supported")
        if {USER, UNUSED} & set(self.kind):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kind.index(UNKNOWN)
        self.end = self.piece.index(trainer[47].decode() if 47 in trainer else "</s>")
        self.surface = trainer.get(44, " ⁇ ".encode())
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k == BYTE}


class Last(dict):
    """An entry of the table: a prefix's last token. Asked for a token that may follow, it gives that one's entry, or None if the two are not compatible."""

    __slots__ = ("table", "token", "backwards", "size")

    def __init__(self, table: PrefixTable, token: str, ids: tuple[int, ...]) -> None:
        self.table, self.token, self.backwards, self.size = table, token, ids[::-1], len(token)

    def __missing__(self, right: str) -> Last | None:
        table = self.table
        found = table.last(right) if table.compatible(self.token, right) else None
        table.pairs += 1
        if table.pairs > KEPT_PAIRS:
            for row in (table.start, *table.lasts.values()):
                row.clear()
            table.pairs = 0
        self[right] = found
        return found


class PrefixTable:
    def __init__(self, raw: bytes) -> None:
        v = self.vocabulary = Vocabulary(raw)
        normal = [i for i, k in enumerate(v.kind) if k == NORMAL]
        self.id = {v.piece[i]: i for i in normal}
        self.score = {v.piece[i]: v.score[i] for i in normal}
        single = self.single = {c for p in self.id for c in p}
        self.ends = ahocorasick.Automaton()
        for p in {*self.id, *single}:
            self.ends.add_word(p, p)
        self.ends.make_automaton()
        together = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.cuts_at_marks = not any(x[1] == MARK != x[0] for x in together)
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in single)
        self.stretch = re.compile(f"[{lone}]|{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" if lone else f"{MARK}+[^{MARK}]*")
        self.merges: dict[str, tuple[list, list] | None] = {}
        self.lasts: dict[str, Last] = {}
        self.start, self.pairs = Last(self, "", ()), 0
        self.control = {i for i, k in enumerate(v.kind) if k == CONTROL}
        self.label = [self._label(i) for i in range(len(v.piece))]

    def _label(self, i: int) -> bytes:
        v = self.vocabulary
        if v.kind[i] == BYTE:
            return bytes([int(v.piece[i][1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: v.surface}.get(v.kind[i], v.piece[i].replace(MARK, " ").encode())

    def history(self, token: str) -> tuple[list, list] | None:
        """The first and the last token of a token as its merging goes on, each with the score of the merges until it changes; None if it is never made."""
        if token not in self.merges:
            parts, first, last, low = list(token), [], [], [float("inf")] * 2
            while len(parts) > 1:
                best, at = max(((self.score.get(a + b, -float("inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(0.0, 0))
                if best == -float("inf"):
                    break
                at = -at
                low = [min(x, best) for x in low]
                if at == 0:
                    first.append((parts[0], low[0]))
                    low[0] = float("inf")
                if at == len(parts) - 2:
                    last.append((parts[-1], low[1]))
                    low[1] = float("inf")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.merges[token] = ([*first, (token, -float("inf"))], [*last, (token, -float("inf"))]) if len(parts) == 1 else None
        return self.merges[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging left + right alone leaves exactly these two. Of equal scores the leftmost merge comes first."""
        a, b = self.history(left), self.history(right)
        if not left or a is None or b is None:
            return not left and b is not None
        i = j = 0
        a, b = a[1], b[0]
        while True:
            (u, until), (t, to) = a[i], b[j]
            across = self.score.get(u + t)
            if across is not None and across > until and across >= to:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if until >= to and i < len(a) - 1:
                i += 1
            else:
                j += 1

    def last(self, token: str) -> Last:
        found = self.lasts.get(token)
        if found is None:
            if token in self.id:
                ids = (self.id[token],)
            else:
                ids = tuple([self.vocabulary.bytes[b] for b in token.encode()]) if self.vocabulary.bytes else (self.vocabulary.unknown,)
            found = Last(self, token, ids)
            if token in self.score or token in self.single:
                self.lasts[token] = found
        return found

    def ids(self, stretch: str) -> tuple[int, ...]:
        """The ids of a stretch: a table of last tokens, one for each prefix, read backwards."""
        table: list[Last | None] = [None] * (len(stretch) + 1)
        table[0] = self.start
        for at, token in self.ends.iter(stretch):
            at += 1
            if table[at] is None:
                row = table[at - len(token)]
                if row is None:
                    row = self.filled(table, stretch, at - len(token))
                table[at] = row[token]
        at, out = len(stretch), []
        while at:
            row = table[at]
            if row is None:
                row = self.filled(table, stretch, at)
            out += row.backwards
            at -= row.size
        out.reverse()
        if not self.vocabulary.bytes:  # unknown characters in a row are one
            out = [i for i, before in zip(out, [None, *out], strict=False) if not i == before == self.vocabulary.unknown]
        return tuple(out)

    def filled(self, table: list, stretch: str, at: int) -> Last:
        """The entry of a prefix at whose end no piece is found: a character that no piece has, alone."""
        table[at] = self.last(stretch[at - 1])
        return table[at]

    def encode(self, text: str, kept: Kept) -> list[int]:
        if not text:
            return [self.vocabulary.end]
        marked = MARK + text.replace(" ", MARK)
        found = self.stretch.findall(marked) if self.cuts_at_marks and self.vocabulary.bytes else [marked]
        return [*chain.from_iterable(map(kept.__getitem__, found)), self.vocabulary.end]

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, without the mark put first; bytes that make no character give a replacement each, and none spans a control id."""
        runs, run = [], []
        if self.control.isdisjoint(ids[:-1]):
            run = ids[:-1] if ids and ids[-1] in self.control else ids
        else:
            for i in ids:
                if i in self.control:
                    runs.append(run)
                    run = []
                else:
                    run.append(i)
        runs = [b"".join(map(self.label.__getitem__, run)) for run in (*runs, run) if run]
        first = next((i for i in ids if i not in self.control), None)
        if first is not None and self.vocabulary.piece[first].startswith(MARK):
            runs[0] = runs[0][1:]
        return "".join([run.decode("utf-8", "one-mark-a-byte") for run in runs])


codecs.register_error("one-mark-a-byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(1)
def table_of(raw: bytes) -> PrefixTable:
    """One table of the vocabulary for all tasks of a worker; stretches met before are kept within a task only."""
    return PrefixTable(raw)


def encode_decode(docs: DataFrame, path: str, texts: bool = True) -> DataFrame:
    """doc_id, ids array<long>, decoded; without texts, doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256.

    The model file at `path` is read by the driver and broadcast: its size does not depend on the data.
    """
    with open(path, "rb") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    names, kinds = ("doc_id", "ids", "decoded"), [pa.list_(pa.int64()), pa.string()]
    if not texts:
        names, kinds = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), [pa.int64(), pa.string(), pa.string()]

    def put(batches):
        table = table_of(held.value)
        kept, decimal = Kept(table.ids), list(map(str, range(len(table.label))))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for text in part.column("text").to_pylist():
                    ids = table.encode(text or "", kept)
                    decoded = table.decode(ids)
                    if texts:
                        out.append((ids, decoded))
                    else:
                        written = " ".join(map(decimal.__getitem__, ids))
                        out.append((len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=list(names))

    schema = "doc_id long, ids array<long>, decoded string" if texts else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(put, schema)
