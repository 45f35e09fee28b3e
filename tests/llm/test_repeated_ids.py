"""Rows that share a doc_id, rows without one, and clashing columns, against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from spectraline.llm import bpe, fingerprint, linefreq, minhash, mixing, substring

L = " ".join(f"w{i}" for i in range(14))
SCHEMA = "doc_id long, text string, source string, key string, spans string, row string, host string, toxicity string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "a", "b", "c", "d", "e", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Texts of few words in which windows repeat, dealt to few doc_ids."""
    rng, out = random.Random(5), []
    passages = [" ".join(f"p{k}x{j}" for j in range(rng.randint(10, 30))) for k in range(6)]
    for _ in range(60):
        own = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 20)))
        out.append((rng.choice([1, 2, 3, 4, 5, 9, 9, 9, None]), " ".join([own, *rng.sample(passages, rng.randint(0, 2))])))
    return [*out, (7, None), (7, ""), (9, L), (1, L), (9, L), (1, L + " more"), (2, "one other text of a few words only")]


def test_substring(spark, rows):
    least = {}
    for doc, text in rows:
        w = (text or "").split()
        for j in range(len(w) - 12):
            if doc is not None:
                least[tuple(w[j : j + 13])] = min(doc, least.get(tuple(w[j : j + 13]), doc))
    want = []
    for doc, text in rows:
        w = (text or "").split()
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if doc is not None and least[tuple(w[j : j + 13])] < doc:
                keep[j : j + 13] = [False] * 13
        want.append((str(doc), len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    docs = frame(spark, rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()) == sorted(want)
    cut = substring.cut_repeats(docs, length=13)
    assert cut.columns == docs.columns and sorted(" ".join((r.text or "").split()) for r in cut.collect() if r.text) == sorted(x for *_, x in want if x)


def test_minhash(spark, rows):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) or frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    least = defaultdict(lambda: 1 << 60)
    for (doc, _), g in zip(rows, group, strict=True):
        least[g] = min(least[g], doc if doc is not None else 1 << 60)
    want = [(str(d), len(s), str(least[g] if d is not None else None), d is None or d == least[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)]
    docs = frame(spark, rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs).collect()) == sorted(want)
    left = minhash.drop_near_duplicates(frame(spark, [(1, L), (2, L + " more"), (2, "an unrelated text of that id"), (None, L)]), k=3)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted([L, "an unrelated text of that id", L])


def test_line_frequency(spark):
    line, own = L + " x y z", lambda j: " ".join(f"o{j}x{i}" for i in range(31))
    docs = frame(spark, [(1, line)] * 40 + [(None if j % 2 else j, f"{line}\n{own(j)}") for j in range(2, 34)] + [(2, own(0)), (2, f"{own(1)}\n{line}\n{line.upper()}")])
    got = sorted((r.n_words, r.n_frequent_words) for r in linefreq.quality(docs, 30).collect())
    # documents 1, 2 to 33, of which 16 have no id and stand for themselves: 33 in all, more than 30
    assert got == sorted([(17, 17)] * 40 + [(48, 17)] * 32 + [(31, 0), (65, 34)])
    few = docs.filter("doc_id is not null")  # 17 documents in 58 rows
    assert all(r.n_frequent_words == 0 for r in linefreq.quality(few, 30).collect())
    clean = linefreq.clean_texts(docs, 30)
    assert clean.columns == docs.columns and clean.count() == 74 and not any(line in (r.text or "") for r in clean.collect())
    assert linefreq.quality(docs.limit(0)).count() == 0 and linefreq.clean_texts(docs.limit(0)).count() == 0


def test_mixing_and_fingerprints(spark, rows):
    import public_tokenizers as P

    docs = frame(spark, rows)
    out = mixing.mixture(docs).collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r["size"] for r in out)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in out)
    assert fingerprint.edited_likeness(docs).count() == len(rows) == bpe.encode_decode(docs, P.path("byte_bpe_50k.json")).count()


def test_winnowed_likeness(spark):
    """near_edited, near_next and the fingerprints by brute force over all grams of the texts."""
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("ab c") for _ in range(rng.choice([0, 1, 9, 60, 300]))) for i in range(12)}
    texts |= {20: texts[3], 21: texts[3][:150] + texts[5]}

    def chosen(text, k=16, w=32):
        k = min(k, len(text))
        hashes = [fingerprint.winnow(text[i : i + k], k, 1)[0][0] for i in range(len(text) - k + 1)] if text else []
        w, picks = min(w, len(hashes)), []
        for i in range(len(hashes) - w + 1):
            part = hashes[i : i + w]
            at = i + max(j for j in range(w) if part[j] == min(part)) if part else None
            if at is not None and (not picks or picks[-1] != at):
                picks.append(at)
        return [hashes[i] for i in picks]

    def like(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a or b else 1.0

    out = {r.doc_id: r for r in fingerprint.edited_likeness(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(texts[a]) // 2
        edited = texts[a][: len(texts[a]) - half] + texts[b][:half]
        assert out[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[a].near_edited == pytest.approx(like(chosen(texts[a]), chosen(edited))) and out[a].near_next == pytest.approx(like(chosen(texts[a]), chosen(texts[b])))
    assert out[20].fingerprint == out[3].fingerprint and len({r.fingerprint for r in out.values()}) >= len(set(texts.values()))
