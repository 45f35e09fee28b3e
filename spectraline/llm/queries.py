"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraline.llm import bpe, fingerprint, hmm, html, langid, linefreq, merkle, minhash, mixing, pieces, search, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(0))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("kept", "kept_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, texts=False)


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(table(spark, sf_dir, "documents"), fold(7) == 2)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.training_rows(docs, fold(5) != 0))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        linefreq.quality(table(spark, sf_dir, "documents"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words", "base_failed", "kept")
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.scores(docs, toxicity.trained(docs, labels, fold(4) != 2))
    return (
        found
        .select("doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.trained(pages))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), *merkle.lower_cased())


def op13_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_decode(table(spark, sf_dir, "documents"), path, texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_hmm, op4_minhash, op5_langid, op6_line_frequency, op7_toxicity, op8_mixing, op9_html, op10_winnowing, op11_search, op12_merkle, op13_sentencepiece)
}
ORACLE_SQL = {"op6_line_frequency": linefreq.ORACLE, "op8_mixing": mixing.ORACLE, "op11_search": search.ORACLE, "op12_merkle": merkle.ORACLE}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
