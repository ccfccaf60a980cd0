"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, packing, pii, quality, sentence_dedup, simhash, suffix_dedup, toxicity, warc

VOCABULARY = "word_bpe_49k.json"


def vocab_path(name: str = VOCABULARY) -> str:
    """The public vocabulary file's place; ``RIDGELINE_VOCAB`` overrides it."""
    if at := os.environ.get("RIDGELINE_VOCAB"):
        return at
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PASSAGE_BYTES = 256  # nearly every 51 words of the table's languages are longer


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: how many bytes another document has too, in strings of ``PASSAGE_BYTES`` or more."""
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, least=PASSAGE_BYTES)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    removed = total("spans")
    return got.select(
        "doc_id", (F.octet_length("kept").cast("long") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("shared").alias("n_shared"),
    )


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocab_path())


def op3_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentence_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_sentences_removed", F.size("removed").cast("long").alias("n_spans"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed_chars"), F.col("kept").alias("text"),
    )


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents"), vocab_path())
    return got.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.detect(table(spark, sf_dir, "documents"))
    spell = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return got.select(
        "doc_id", *counts, F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_pattern_packing, op3_sentence_dedup, op4_prefix_bpe, op5_quality_rules, op6_simhash, op7_pii, op8_toxicity, op9_ann, op10_warc,
    )}


_OP10 = """
WITH p AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages
), s AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS d FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM s
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": _OP10, "op5_quality_rules": quality.oracle_sql()}
