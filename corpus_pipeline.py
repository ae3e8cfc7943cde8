"""From raw documents to tokens: language, near duplicates, personal data, source mix, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopledger.llm import byte_bpe, disclosure, language, minmax_dedup, mixing
from hopledger.llm.common import kept, table
from hopledger.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near copies have a five-word Jaccard similarity of at least this much; op2 has a contract of its own.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their predicted language; those without a text or a letter are rejected."""
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.fit(docs), COLUMNS)
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates at ``NEAR_PERCENT``; documents without an id all stay.

    A doc_id that comes with different texts is as many documents; the same text under one doc_id stays once.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    # Numbers in the order of doc_id, so that the smallest doc_id of a group is the one that stays.
    number = kept(keyed.filter("doc_id IS NOT NULL").select("doc_id", "text_key").distinct().orderBy("doc_id", "text_key").withColumn(
        "number", F.monotonically_increasing_id()))
    numbered = kept(keyed.join(number, ["doc_id", "text_key"]).select("number", *COLUMNS))
    found = minmax_dedup.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), NEAR_PERCENT)
    chosen = found.filter("kept").select(F.col("doc_id").alias("number")).distinct()
    one = numbered.join(chosen, "number", "left_semi").dropDuplicates(["number"]).select(*COLUMNS)
    return one.unionByName(keyed.filter("doc_id IS NULL").select(*COLUMNS))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced."""
    clean = disclosure.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.draw(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return byte_bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
# The stages are models, links and merges that SQL does not express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
