"""A corpus from raw documents to a weighted mix, in five stages. Each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, mixing, simhash, substrings, toxicity
from sievework.llm.common import materialise, read, release, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, learned from the labels, rejects.

    A null, empty or blank text has nothing toxic and stays; repeated rows are judged alike; without usable labels all stay.
    Columns of any name are kept; an empty table gives no rows.
    """
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document, the one with the smallest doc_id, of each group of near-duplicates (five words, similarity 0.8 or more).

    Texts without words make one group; a null doc_id comes after all others; rows that agree in doc_id and text count as one.
    Columns of any name are kept; an empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def drop_repeated_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the words cut that windows of 35 words cover which also start elsewhere.

    No row goes: a text of which nothing is left comes back empty, a null one null. Columns of any name are kept; an empty table
    gives no rows.
    """
    return substrings.drop_repeated_words(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark items.

    A null or empty text holds none and stays; repeated rows go or stay together; an empty benchmark drops nothing. Columns of
    any name are kept; an empty table gives no rows.
    """
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, how many times each, and their words counted that often.

    Null and empty texts have no words and aren't taken; a null source is a source; rows that agree in all that is told of them
    are taken as separate documents. Columns of any name are kept, and the two new ones get names that none of them has; an
    empty table gives no rows.
    """
    out = mixing.mix_sources(docs, carry=tuple(docs.columns)).where("times > 0")
    times, taken = unused(docs.columns, "times", "taken")
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.col("times").alias(times), F.col("taken").alias(taken))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_words),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL can express neither the learned model nor the fingerprints; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, before, sf_dir), name)
        release(before)  # the documents themselves aren't ours and stay
        before = docs
    return docs
