"""Every stage of the pipeline on odd rows: nulls, empty and long texts, repeated rows and ids, further columns with clashing names, no rows."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, toxicity string, kept string, size string, row string, ids string"
LINE = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, LINE), (2, LINE), (2, LINE), (3, None), (4, ""), (None, "x y z"), (None, LINE + " tail of it"), (5, "long text here " * 20000), (6, LINE + " and an end"), (7, " \t\n")]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s" if i != 3 else None, None, "a", "b", "c", "d", "e", "f") for i, t in ROWS], SCHEMA)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_rows_keep_their_columns(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert out.columns == odd.columns and {r.row for r in out.collect()} <= {"e"}
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0


def test_what_each_stage_keeps(spark, odd):
    texts = lambda name: Counter((r.doc_id, r.text) for r in STAGES[name](spark, odd, SF).collect())
    assert texts("toxicity") == Counter(ROWS)
    near = texts("near duplicates")
    assert near[1, LINE] == 1 and not near[2, LINE] and near[3, None] == near[4, ""] == 1 and near[None, "x y z"] == 1
    cut = texts("substring dedup")
    assert cut[1, LINE] == 1 and (6, "and an end") in {(i, (t or "").strip()) for i, t in cut} and cut[3, None] == 1 and not cut[2, LINE]
    assert all(t and t.strip() for _, t in texts("mixing"))


def test_encoding(spark, odd):
    out = STAGES["encoding"](spark, odd, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ROWS) and {r.n_tokens for r in out if r.doc_id in (3, 4)} == {0}
    assert STAGES["encoding"](spark, odd.limit(0), SF).count() == 0
