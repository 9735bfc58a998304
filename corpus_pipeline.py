"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that the one before it kept, and is written as
Parquet and read again before the next, so a lost executor never costs more than
one stage. All stages but the last return the columns of ``documents``.

Defined cases, for all stages: further columns, whatever their names, stay as they
are; a null doc_id is a document; an empty table gives an empty result; texts of
any length are handled whole. Null, empty and blank texts have no letter, so the
first stage drops them. Repeated rows: language ID decides alike for each, exact
dedup keeps one, so the stages after it see none. Ties: exact and near dedup keep
the smallest doc_id, mixing orders by hashes of the doc_id, packing by the pieces'
numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact, langid, minhash, mixing, packing
from tessella.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language with a posterior of one half, go."""
    return langid.known_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in shuffled order."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Languages, sketches, mixing and packing can't be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
