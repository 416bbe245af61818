"""The corpus pipeline: toxicity filter, exact dedup, SimHash near dedup, mixing to target weights, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import dedup, mixing, packing, simhash, toxicity
from footfall.llm.common import bound_batches, held_out, stored, table

TOKENIZER = "byte_bpe_50k.json"
#: Shares of the tokens after mixing, with about twice the natural share (0.10) of the rarer domain. No document is dropped for
#: them: the mix grows until no domain shrinks.
TARGETS = {"high": 0.80, "low": 0.20}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; empty and null texts are scored as empty ones."""
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.score(scored, toxicity.train(docs, labels)).filter("predicted = 0").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return dedup.without_duplicates(docs, dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.without_near_duplicates(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at rates of one or more that bring the domains' expected tokens to the target weights."""
    labelled = mixing.labelled_rows(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    rated, _ = mixing.mix(whole, labelled, TARGETS, least=1.0, grow=True)
    times = mixing.copies(F.col("rate"), F.col("doc_id"))
    return rated.select("doc", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
          ("mixing", mix_domains), ("packing", pack_sequences)]
#: Classifiers, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
