"""A training corpus from raw documents: the stages, in order, each over all rows that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm.common import Scratch, read_table
from quiverlake.llm.decontamination import decontaminate
from quiverlake.llm.language import fit_languages, held_out, identify_languages
from quiverlake.llm.packing import pack_documents
from quiverlake.llm.similar import drop_similar_documents
from quiverlake.llm.substrings import dedup_substrings

#: SQL has no compression, tokenizer or suffix array: tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Those without a letter and those of narrow margin go."""
    model = fit_languages(docs.where(~held_out()))
    return identify_languages(docs, model).where(~F.col("lang_rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles: that of the smallest doc_id.
    Op6's fingerprints name candidates, and MinHash those that are further apart."""
    return drop_similar_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that also start in an earlier one."""
    cut = dedup_substrings(docs, share=0.9)  # what earlier stages have written takes disk too
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ten words."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each power-of-two piece, with its ids."""
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
