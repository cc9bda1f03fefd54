"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but
the last return the columns of ``documents``.

Defined results, from the operators: null, empty and letterless texts are rejected by language ID, as are
all texts where nothing is labelled; repeated rows become one at exact dedup, and rows that share an
identifier one component at near dedup; null identifiers are kept last by exact dedup, linked with nothing
and mixed after the others; null sources are one source; very long texts are treated whole; an empty table
gives an empty result; further columns of any name are carried up to the last stage. Near dedup takes
five words here, as near-duplicate stages do unless told otherwise; the query of the operator takes four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protean.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from protean.llm.common import stored, table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; those without a letter or with a narrow margin go."""
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, up to white space: the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, similarity 0.8): the smallest doc_id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken from twice has two rows."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by count and hash, and the hash of what they decode to."""
    return bpe.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Compression, MinHash and permutations by hash are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
