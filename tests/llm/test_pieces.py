"""SentencePiece against the library: whole tables, made-up strings, any ids; merging by a plain loop for the test of a pair."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from spectraline.llm import pieces
from spectraline.llm import queries as Q
from spectraline.llm.bpe import Kept

SF = "/root/testdata/sf0.001"
PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def table():
    with open(PATH, "rb") as file:
        return pieces.PrefixTable(file.read())


def test_whole_table(spark, theirs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = Q.op13_sentencepiece(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = theirs.encode(texts[r.doc_id], add_eos=True)
        want = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


def test_made_up_texts(table, theirs):
    rng, kept = random.Random(3), Kept(table.ids)
    words = [p for p, k in zip(table.vocabulary.piece, table.vocabulary.kind, strict=True) if k == pieces.NORMAL]
    for n in range(3000):
        text = "".join(rng.choice(words) for _ in range(9)) if n % 2 else "".join(rng.choice(" ▁ab\n\tthe ingé中\U0001f389\x00\x85　‍ß") for _ in range(50))
        text = text if n % 3 else text.replace(pieces.MARK, " ")
        ids = table.encode(text, kept)
        assert ids == theirs.encode(text, add_eos=True) and table.decode(ids) == theirs.decode(ids)
        some = [rng.randrange(rng.choice((260, 32000))) for _ in range(n % 7)]
        assert table.decode(some) == theirs.decode(some)


def test_pairs_by_a_plain_loop(table):
    def merged(text):
        parts = list(text)
        while True:
            tries = [(table.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table.score]
            if not tries:
                return parts
            i = -max(tries)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng, words = random.Random(4), [p for p in table.id if len(p) > 1]
    near = [p for p in words if set(p) <= set("▁abcnoest")]
    for _ in range(3000):
        u, t = rng.choice(near), rng.choice(near)
        assert table.compatible(u, t) == (merged(u + t) == [u, t])


def test_odd_rows(spark, theirs):
    schema = "doc_id long, text string, ids string, decoded string, n_tokens string"
    texts = ["", None, " ", "one two", "one two", "x" * 50000, "a " * 50000, "\n \t"]
    odd = spark.createDataFrame([*((i, t, "a", "b", "c") for i, t in enumerate(texts)), (None, "é", None, None, None)], schema)
    for r in pieces.encode_decode(odd, PATH).collect():
        text = "é" if r.doc_id is None else texts[r.doc_id] or ""
        ids = theirs.encode(text, add_eos=True)
        assert list(r.ids) == ids and r.decoded == theirs.decode(ids)
    assert pieces.encode_decode(odd.limit(0), PATH).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merge type"):
        pieces.Vocabulary(b"")
