"""A corpus pipeline: each stage reads what its predecessor kept, decides, and is written out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import linechunks, pieces, simhash, suffix, toxicity
from ledgerloom.llm.common import ship, staged, table
from ledgerloom.llm.queries import PIECE_BPE, vocabulary


# Units held by a worker, which has the memory of the stages before as well.
HELD_UNITS = 150_000
# A whole window of a benchmark item.
SPAN_WORDS = 13


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars``, if they have it, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not take for toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks and passages of lines that an earlier document, or place, has."""
    return _counted(linechunks.repeat_dedup(docs)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of 3-word shingles, 3 bits."""
    return simhash.simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth lies in windows of benchmark items, without those passages.

    A passage is a span of hit words of ``SPAN_WORDS`` or more. Texts without any stay as they are.
    """
    kept = suffix.decontaminate(docs, table(spark, sf_dir, "benchmark"), longest=SPAN_WORDS)
    return _counted(kept).select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's ids and of the text decoded from them."""
    return pieces.piece_digests(docs, vocabulary(PIECE_BPE), room=HELD_UNITS)


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece_ids),
]

# A trained network decides the first stage, so SQL cannot state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
