"""A corpus pipeline of five stages, each over all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of
``documents``, but for the last, which returns packed pieces.  Stages are
written as Parquet and read again between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import packing, pii, quality, sentence_dedup, simhash
from ridgeline.llm.common import keyed, materialize
from ridgeline.llm.queries import vocab_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # SimHash, the field and the packing have no SQL form


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps; a null text has no words and goes."""
    return quality.passing(docs, COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of at least 0.8 in five-word shingles): the one with the least id.

    Rows with null or repeated ids are told apart by row keys, so one of each
    group stays whatever the ids are.
    """
    rows = keyed(docs, *COLUMNS)
    groups = simhash.similar_documents(rows.select("rk", "text"), id_col="rk", size=5, similarity=0.8)
    first = groups.filter("rk = component_id").select("rk")
    return rows.join(first, "rk", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans; a text of which nothing is left goes, as does a null one.

    Of equal spans the first one stays, so one of repeated rows does.
    """
    cut = sentence_dedup.remove_repeated_spans(docs, carry=("lang", "source"))
    rest = cut.filter(F.col("kept").isNotNull() & (F.trim("kept") != ""))
    return rest.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; a row for a row, null texts stay null."""
    got = pii.detect(docs, carry=("lang", "source"))
    return got.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; a null text is packed as an empty one."""
    return packing.pack(docs, vocab_path())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("pii", redact),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table, or one of which nothing is kept, gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["STAGES", "ORACLE_SQL", "run"]
