"""The training-corpus pipeline: five stages over `documents`, each an operator of photarium.llm.

A stage takes all that its predecessor kept, and all but the last return the columns of documents, whatever further columns there are.

Null, empty and letterless texts go in the first stage, which takes them for no language. The others take them too: the near-dedup keeps
one text without words, as copies of each other; the substring dedup keeps them as they are; the mixing takes none; the encoding gives
them no ids. Of equal rows the near-dedup keeps one, of equal ids any number. Texts of any length are read whole. An empty table stays
empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photarium.llm import byte_bpe, langid, mixing, recompression, simhash
from photarium.llm.common import drop, small_batches, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; lang becomes the prediction."""
    return langid.language_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays."""
    return simhash.dedup(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 35 words that is found again go; documents of which nothing is left go."""
    return recompression.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of their sources, some repeatedly, one a source in part."""
    return mixing.materialize(docs)


def byte_bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, and whether they decode to the text."""
    coded = small_batches(docs).select("doc_id", "source", byte_bpe.checked_of(F.col("text")).alias("c"))
    return coded.select("doc_id", "source", "c.ids", F.size("c.ids").cast("long").alias("n_tokens"), "c.round_trip")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe_encoding),
]

#: Stages of models, fingerprints and recompression are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table is deleted when the next one's is written, the last but one's with the driver."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{name}")
            if before is not None:
                drop(before)
            before = docs
    return docs
