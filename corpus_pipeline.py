"""A training corpus from the table documents, in five stages; see STAGES.

Each stage is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents; the last returns for each row its tokens and digests.

Every stage takes nulls in any column, empty and very long texts, rows that repeat an id or are equal, tables without rows and further
columns of any name, and carries further columns along; what it makes of them, its operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraline.llm import bpe, minhash, mixing, substring, toxicity
from spectraline.llm.queries import fold, table
from spectraline.llm.shared import cut, free_name

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold; learnt from labels on the whole table of documents."""
    classifier = toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) != 2)
    rest = [c for c in docs.columns if c != "doc_id"]
    score = free_name(docs.columns, "toxicity")
    return toxicity.scores(docs, classifier, *rest, name=score).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group linked by word shingles."""
    return minhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that also stand in a document of smaller doc_id in a window of 50 words; untouched texts stay as they are."""
    return substring.cut_repeats(docs, length=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole repetition that a text's source takes, and one with the first words of a part; texts without words are taken by no source."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, repeated ones too; a null text is the empty one."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), texts=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
