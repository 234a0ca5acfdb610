"""A training-corpus pipeline over documents: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import decontam, langid, neardup, piecefst, quality
from jobloom.llm.common import drop_written, read_table, tokenizer_path, without_ids, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws."""
    return quality.keep_drawn(docs, read_table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is found."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies (five-word shingles, similarity 0.8)."""
    groups = neardup.near_duplicates(docs)
    dropped = written(groups.where("not kept").select("doc_id"), "dropped")
    drop_written(groups)
    return without_ids(docs, "doc_id", dropped)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no test item."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_crc32, decoded_equal."""
    return piecefst.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Models are trained along the way, which SQL cannot express; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's result is written as Parquet and read again, and dropped after the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        if k:
            drop_written(last)
    return STAGES[-1][1](spark, docs, sf_dir)
