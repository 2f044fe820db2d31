"""The queries over this package's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op1_chat_format as op

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(op.CHECK_ROWS, "conv_id long, turn long, role string, text string"))
    return op.conversations(op.read_back(op.render(rows)))


def op2_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op2_embedding_lsh as op

    return op.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op3_warc_merge as op

    return op.capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op4_url_filters as op

    return op.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op5_bpe_lexicon as op

    coded = op.encode(table(spark, sf_dir, "documents"), op.default_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op6_avi as op

    return op.clips(op.media(table(spark, sf_dir, "documents"))).drop("clips")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.op7_order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op8_toxicity as op

    scored = op.toxicity(table(spark, sf_dir, "documents"), op.learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.array_join("evidence", ",").alias("evidence"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op9_mixing as op

    return op.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op10_secret_crf as op

    return op.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op11_line_frequency as op

    return op.judge(table(spark, sf_dir, "documents"))


def op12_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op12_radix_negatives as op

    return op.mine(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import op13_vector_codes as op

    return op.compress(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_chat_format, op2_embedding_lsh, op3_warc_merge, op4_url_filters, op5_bpe_lexicon, op6_avi, op7_order_minhash, op8_toxicity, op9_mixing, op10_secret_crf, op11_line_frequency, op12_radix_negatives, op13_vector_codes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import op1_chat_format, op2_embedding_lsh, op3_warc_merge, op4_url_filters, op9_mixing, op11_line_frequency, op12_radix_negatives, op13_vector_codes

    return {m.__name__.rpartition(".")[2]: m.SQL for m in (op1_chat_format, op2_embedding_lsh, op3_warc_merge, op4_url_filters, op9_mixing, op11_line_frequency, op12_radix_negatives, op13_vector_codes)}
