"""Operators against brute force, round trips and held-out accuracy; nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import pytest

from spectraline.llm import bpe, fingerprint, hmm, langid, linefreq, minhash, mixing, substring, toxicity
from spectraline.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string, bucket string, score string, host string"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def rows(*texts):
    out = [(i, t, "en", "s", None, "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return [*out, (None, LINE, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(LINE, None, "", "a", LINE + " more", LINE, "x " * 30000, "  \n\t "), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_substring(spark, docs, odd, none):
    words = {i: WORD.findall(r.text or "") for i, r in docs.items()}
    owner = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            owner.setdefault(tuple(words[i][j : j + 13]), i)
    for r in Q.op1_substring_dedup(spark, SF).collect():
        w = words[r.doc_id]
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if owner[tuple(w[j : j + 13])] < r.doc_id:
                keep[j : j + 13] = [False] * 13
        left = [x for x, k in zip(w, keep, strict=True) if k]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest())
    found = {r.doc_id: r for r in substring.remove_repeats(odd).collect()}
    assert found[4].kept == "more" and found[5].n_removed == 14 and found[0].n_removed == 0 and found[None].n_removed == 0 and found[6].n_removed == 0
    cut = {r.doc_id: r for r in substring.cut_repeats(odd).collect()}
    assert 5 not in cut and cut[4].text.strip() == "more" and cut[0].text == LINE and cut[1].text is None
    assert substring.remove_repeats(none).count() == 0


def test_bpe(spark, odd, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    texts = ["Hello  world's <|endoftext|> x", "aaaa bbbb é中\U0001f389 \x85\x1c y z", "", None, "\n\n  a   "]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(table, path).collect():
        ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(odd, path).count() == odd.count() and bpe.encode_decode(none, path).count() == 0


def test_language_model(spark, odd, none):
    out = Q.op3_hmm(spark, SF).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in out)
    got = {r.doc_id: r for r in hmm.language_model_scores(odd, Q.fold(7) == 2).collect()}
    assert got[1].n_tokens == 1 and got[1].score == pytest.approx(got[2].score) and len(got) == 9
    assert hmm.language_model_scores(none, Q.fold(7) == 2).count() == 0


def test_sketch_fills_every_coordinate():
    import numpy as np

    values = np.arange(1, 8, dtype=np.uint64)
    out = minhash.sketch(values, np.array([0, 1, 1, 7]), 144)
    top = np.iinfo(np.uint64).max
    assert (out[0] != top).all() and (out[1] == top).all() and (out[2] != top).all()


def test_minhash(spark, docs, odd, none):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, r in docs.items():
        w = WORD.findall(low(r.text))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    for r in Q.op4_minhash(spark, SF).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    got = {r.doc_id: r for r in minhash.near_duplicates(odd).collect()}
    assert got[5].component_id == 0 and got[4].component_id == 0 and got[1].n_shingles == 0 and got[3].n_shingles == 1 and got[None].kept
    assert minhash.near_duplicates(none).count() == 0


def test_langid(spark, docs, odd, none):
    out = [r for r in Q.op5_langid(spark, SF).collect() if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in out) >= 0.9 * len(out)
    got = {r.doc_id: r for r in langid.identify(odd, langid.training_rows(odd, Q.fold(5) >= 0)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[0].lang_pred == "en"
    assert langid.identify(none, langid.training_rows(none, Q.fold(5) >= 0)).count() == 0


def test_line_frequency(spark, docs, odd, none):
    for r in Q.op6_line_frequency(spark, SF).collect():
        t = docs[r.doc_id].text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = {}
        for j in range(len(w) - 4):
            at.setdefault(tuple(w[j : j + 5]), []).append(j)
        covered = {q for v in at.values() if len(v) > 1 for p in v for q in range(p, p + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert linefreq.quality(odd).count() == odd.count() and linefreq.quality(none).count() == 0
    many = spark.createDataFrame([(i, f"Cookie  NOTICE {'x ' * 20}\nown {'abcdefghij'[i % 10] * (i + 1)} words here", "s") for i in range(40)], "doc_id long, text string, source string")
    assert not any(r.kept for r in linefreq.quality(many).collect())
    assert all("Cookie" not in r.text for r in linefreq.clean_texts(many).collect())


def test_line_frequency_over_a_whole_table(spark):
    """n_frequent_words and kept of every row by a plain loop and by DuckDB; some rows lose lines."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    rows, held = spark.read.parquet(f"{sf}/documents.parquet").collect(), {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if WORD.search(x):
                held.setdefault((r.source, norm(x)), set()).add(r.doc_id)
    out = Q.op6_line_frequency(spark, sf)
    got = {r.doc_id: r for r in out.collect()}
    for r in rows:
        lost = sum(len(WORD.findall(x)) for x in (r.text or "").split("\n") if WORD.search(x) and len(held[r.source, norm(x)]) > 5)
        g = got[r.doc_id]
        assert g.n_frequent_words == lost and g.kept == (not g.base_failed and g.n_words - lost >= 0.3 * g.n_words)
    assert any(g.n_frequent_words and not g.base_failed for g in got.values())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(linefreq.ORACLE).select(*[duckdb.ColumnExpression(c) for c in out.columns]).fetchall()
    assert sorted(want) == sorted(map(tuple, got.values()))


def test_line_frequency_of_a_big_host(spark):
    schema, line = "doc_id long, text string, source string", " ".join(f"cookie{i}" for i in range(40))
    big = spark.createDataFrame([(i, (line + "\n" if i < 40 else "") + " ".join(f"own{i}x{j}" for j in range(12)), "s") for i in range(1000)], schema)
    got = linefreq.quality(big).collect()
    assert not any(r.base_failed for r in got) and all(r.kept == (r.doc_id >= 40) for r in got)
    assert not any("cookie" in r.text for r in linefreq.clean_texts(big).collect())
    again = spark.createDataFrame([(i % 5, f"{line}\nown{i}", "s") for i in range(40)], schema)
    assert all(r.kept and r.n_frequent_words == 0 for r in linefreq.quality(again).collect())


def test_toxicity(spark):
    bad = [f"the plain text of it and that vermin{x} is here again today" for x in "abcdefghij"] * 4
    good = [f"the plain text of it and that {x}{x} is here again today" for x in "abcdefghij"] * 40
    model = toxicity.fit(bad, good).start()
    assert model.score("and the vermina is here") > 0.3 > model.score("and the plain text is here") and model.score(None) == model.score("")


def test_toxicity_long_texts():
    bad = [f"the plain text of it and that vermin{x} is here again today" for x in "abcdefghij"] * 4
    good = [f"the plain text of it and that {x}{x} is here again today" for x in "abcdefghij"] * 40
    clean = "the plain text of it is here again today "
    model = toxicity.fit(bad, good).start()
    assert model.score(clean * 2000 + "vermina " + clean * 2000) < 0.3 < model.score(clean * 2000 + "vermina of it " * 9 + clean * 2000)


def test_toxicity_learns_from_long_texts(spark):
    long = "the plain text of it is here again today " * 600
    docs = spark.createDataFrame([(i, long + "verminous of it " * 9000 if i % 4 == 0 else long) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels, Q.fold(4) >= 0).start()
    assert model.score("verminous of it is verminous") > 0.3 > model.score("the plain text of it")


def test_mixing(spark, docs, odd, none):
    out = Q.op8_mixing(spark, SF).collect()
    assert all(r.taken <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        s = by.setdefault(docs[r.doc_id].source, [0, r.target])
        s[0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in by.values())
    assert abs(sum(b for _, b in by.values()) - 1.5 * sum(r["size"] for r in out)) < 1
    assert mixing.mixture(odd).count() == odd.count() and mixing.mixture(none).count() == 0 and mixing.mixed_rows(odd).columns == odd.columns


def test_winnowing(spark, docs, odd, none):
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 5, 17, 60, 400):
        text = "".join("ab"[i] for i in rng.integers(0, 2, n))
        h, at = fingerprint.winnow(text, 5, 4)
        k = min(5, n)
        grams = [fingerprint.winnow(text[i : i + k], 5, 4)[0][0] for i in range(n - k + 1)]
        w = min(4, len(grams))
        want = sorted({max(j for j in range(i, i + w) if grams[j] == min(grams[i : i + w])) for i in range(len(grams) - w + 1)})
        assert at.tolist() == want and all(h[i] == grams[j] for i, j in enumerate(want))
    ids, out = sorted(docs, reverse=True), {r.doc_id: r for r in Q.op10_winnowing(spark, SF).collect()}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        x, y = docs[a].text or "", docs[b].text or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        assert out[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        # likeness follows from the strings, and so do the places of grams that two texts share
        assert out[a].near_next == fingerprint.written_likeness(out[a].fingerprint, out[b].fingerprint)
        assert out[a].near_edited == fingerprint.written_likeness(out[a].fingerprint, out[a].edited_fingerprint)
        h, at = fingerprint.read(out[a].fingerprint)
        want = fingerprint.winnow(x)
        assert at.tolist() == want[1].tolist() and h.tolist() == [int(v) & 0xFFFFFFFF for v in want[0]]
        g, to = fingerprint.read(out[a].edited_fingerprint)
        shared = {int(v): int(p) for v, p in zip(g, to, strict=True)}
        assert all(edited[shared[v] : shared[v] + 16] == x[p : p + 16] for v, p in zip(h.tolist(), at.tolist(), strict=True) if v in shared)
    assert fingerprint.edited_likeness(odd).count() == odd.count() and fingerprint.edited_likeness(none).count() == 0
    assert fingerprint.fingerprints(odd).count() == odd.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, SF).count() > 0
