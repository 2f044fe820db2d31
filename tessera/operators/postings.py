"""An inverted index as a table: one row for each word of a text, in buckets of words.

`bucket` is the hash of a word's first letters, as many as a prefix has at least, so a word and all prefixes of it that may be asked for stand in
one bucket. Within the buckets rows are in ranges of (word, key): a word that stands in every text is many files, not one, and a
file's statistics skip the words that nobody asks for. A question reads the buckets of its terms only. Block maxima are left out: the weight of a prefix is the number of texts that
have any of its words, so all of their rows are read anyway.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.lanes import Counts, wanted_term
from tessera.operators.storage import kept, shared_dir

BUCKETS = 32
FILES = 32
ENTRY = ("key", "term", "tf", "dl")


def word_list(body: Column) -> Column:
    """The words of a text as keyword search sees them: lower case, without diacritics."""
    return F.filter(F.split(text.unaccented(F.lower(F.coalesce(body, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(text.PREFIX_LEAST))), F.lit(BUCKETS)).cast("int")


def entries(texts: DataFrame, key: str, body: str, *carried: str) -> DataFrame:
    """(carried, key, term, tf, dl): how often each word stands in each text, and how many words the text has."""
    listed = texts.select(*carried, F.col(key).alias("key"), word_list(F.col(body)).alias("w"))
    each = listed.select(*carried, "key", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return each.groupBy(*carried, "key", "dl", "term").agg(F.count("*").cast("int").alias("tf")).select(*carried, *ENTRY)


@dataclass(frozen=True)
class Postings:
    """`rows(bucket, key, term, tf, dl)`, wherever they lie, and the numbers over all texts."""

    rows: DataFrame
    n: int
    words: int

    def counted(self, tiers: list[tuple[list[str], bool]], key: str = "chunk_id") -> Counts:
        """As `lanes.counted`, from the buckets of the terms alone; only texts that have one of them have a row."""
        wanted = list(dict.fromkeys(wanted_term(t, as_prefix) for terms, as_prefix in tiers for t in terms))
        spark = self.rows.sparkSession
        leads = spark.range(1).select(*(bucket_of(F.lit(t)) for t, _ in wanted)).first()  # a number for each term
        term = F.col("term")
        hit = [F.startswith(term, F.lit(t)) if prefix else term == t for t, prefix in wanted]
        asked = hit[0]
        for h in hit[1:]:
            asked = asked | h
        found = self.rows.where(F.col("bucket").isin(sorted(set(leads)))).where(asked)
        tf = [F.sum(F.when(h, F.col("tf")).otherwise(0)) for h in hit]
        rows = kept(found.groupBy("key", "dl").agg(F.array(*tf).alias("tf")).select(F.col("key").alias(key), F.col("dl").cast("long").alias("dl"), "tf"))
        seen = rows.agg(*(F.count_if(F.col("tf")[i] > 0) for i in range(len(wanted)))).first()
        return Counts(rows, key, {w: i for i, w in enumerate(wanted)}, self.n, self.words / self.n if self.n else 0.0, list(seen))


def written(texts: DataFrame, key: str, body: str, folder: str) -> None:
    """The index of `texts` as a table in `folder`."""
    made = entries(texts, key, body).withColumn("bucket", bucket_of(F.col("term")))
    made.repartitionByRange(FILES, "bucket", "term", "key").sortWithinPartitions("bucket", "term", "key").write.partitionBy("bucket").parquet(f"{folder}/entries")
    # texts without words have no entries, so they are counted where they stand; words are those of the entries
    words = texts.sparkSession.read.schema("tf int").parquet(f"{folder}/entries").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).first()[0]
    texts.agg(F.count("*").alias("n")).withColumn("words", F.lit(words).cast("long")).write.parquet(f"{folder}/sizes")


def opened(spark: SparkSession, folder: str, key_type: str) -> Postings:
    rows = spark.read.schema(f"key {key_type}, term string, tf int, dl int, bucket int").parquet(f"{folder}/entries")
    n, words = spark.read.schema("n long, words long").parquet(f"{folder}/sizes").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return Postings(rows, n, words)


_MADE: dict[tuple[str, str, str], Postings] = {}


def of(texts: DataFrame, source: DataFrame, name: str, key: str = "chunk_id", body: str = "raw_text") -> Postings:
    """The index of `texts`, made from `source`: made once in an application for the files that the source has, and kept in the shared folder."""
    spark = texts.sparkSession
    files = source.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct().agg(F.bit_xor("f")).first()[0]
    at = spark.sparkContext.applicationId, name, f"{files}"
    if at not in _MADE:
        folder = f"{shared_dir(spark)}/postings-{name}-{uuid.uuid4().hex}"
        written(texts, key, body, folder)
        _MADE[at] = opened(spark, folder, dict(texts.dtypes)[key])
    return _MADE[at]
