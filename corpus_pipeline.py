"""A corpus pipeline of five stages over `documents`: each is written as Parquet and read again as the next one's input.

Nulls and edge cases, in every stage: extra columns, whatever their names, pass through to the last stage; an empty table stays empty; very long texts are read whole.
A document with a null, empty or wordless text is scored as having no terms, has no near copies, holds no secrets, has size 0 (so the mix takes it as often as others of
its source) and no tokens; a null doc_id is never an example and no near copy, and draws its copies as the text "null"; rows that repeat a doc_id are scored and masked each, fall together
as near copies (all go if the group is represented by another doc_id) and draw the same number of copies; near copies that tie keep the smallest doc_id; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op5_bpe_lexicon, op7_order_minhash, op8_toxicity, op9_mixing, op10_secret_crf
from tessera.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return op8_toxicity.reject_toxic(docs, op8_toxicity.learnable(table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return op7_order_minhash.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return op10_secret_crf.mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return op9_mixing.mix(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256."""
    coded = op5_bpe_lexicon.encode(docs, op5_bpe_lexicon.default_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", minhash_near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe_encoding", bpe_encoding)]

#: SQL cannot express nearest examples, alignment, tagging and merging; tests hold masking, mixing and encoding against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
