"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: documents, with the columns of docs, from all but the
last, and one row per packed piece from the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import mixing, ngram_join, packing, pii, quality
from fieldloom.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that base rules and adaptive thresholds keep. Null and empty texts fail; repeated rows are judged
    each; a tie with a threshold is kept; very long texts are judged whole; an empty table stays empty; other columns
    stay, whatever their names (see quality.keep_good)."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % of the five-word shingles make, that with the smallest doc_id,
    nulls last, then the first by text. Texts without words all stay; of repeated rows one stays; very long texts are
    compared whole; an empty table stays empty; other columns stay, whatever their names (see ngram_join.keep_first)."""
    return ngram_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data, credentials, and terms that disclose them, replaced by their kind. A null text
    stays null; repeated rows are treated alike; very long texts are scrubbed whole; an empty table stays empty; other
    columns stay, whatever their names (see pii.scrub)."""
    return pii.scrub(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks for, ties by a seeded hash. Texts without words are left
    out; repeated rows share what is taken of them; a null source is one of its own; a very long text is taken whole or
    not at all; an empty table stays empty; other columns stay, whatever their names (see mixing.repeated)."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 2,048 tokens. A null or empty text is one piece
    of the end token; repeated rows are packed each; pieces of one length are interchangeable; a very long text is cut
    into pieces; an empty table gives an empty result; other columns are not read (see packing.pack)."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:  # the last stage reads its input before it returns
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL expresses the join's components and the packing; tests hold each stage against a plain version.
ORACLE_SQL = None
