"""Incremental indexing as a file stream (Q01-Q07): a landed change feed, applied per batch, with its offsets.

The feed holds rows `(repo, sha, path, op, body)`; `op` is put or delete. A batch is applied idempotently: the files it
touches are cleared and written anew in all tables, in the groups of its repositories only, then the offsets (see `mirrors`), so
a replay after a failure between two tables gives the same. A repository whose rows are unsound is recorded as failed and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.streaming.mirrors import FILES, STATE, Mirrors, derived, group_of

FEED = "seq long, repo string, sha string, path string, op string, body string"
__all__ = ["FEED", "FILES", "STATE", "apply", "run"]


def last_changes(batch: DataFrame) -> DataFrame:
    """The last change of each path in a batch."""
    nth = F.row_number().over(Window.partitionBy("repo", "path").orderBy(F.desc("seq")))
    return batch.withColumn("nth", nth).where("nth = 1").drop("nth")


def _fresh(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows beyond their repository's offset (Q03), repositories with an unsound one, the last sound change of each path), persisted for every table reads them."""
    fresh = batch.join(state.select("repo", "last_seq"), "repo", "left").where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))).drop("last_seq").persist()
    bad = fresh.where("path IS NULL OR op NOT IN ('put', 'delete')").select("repo").distinct().persist()
    return fresh, bad, last_changes(fresh.join(bad, "repo", "left_anti")).persist()


def _offsets(state: DataFrame, fresh: DataFrame, bad: DataFrame) -> DataFrame:
    done = fresh.join(bad, "repo", "left_anti").groupBy("repo").agg(F.max_by("sha", "seq").alias("last_sha"), F.max("seq").alias("last_seq")).withColumn("error", F.lit(None).cast("string"))
    failed = bad.join(state.select("repo", "last_sha", "last_seq"), "repo", "left").withColumn("error", F.lit("unsound change"))
    touched = done.unionByName(failed)
    return state.join(touched.select("repo"), "repo", "left_anti").unionByName(touched)


def apply(tables: dict[str, DataFrame], state: DataFrame, batch: DataFrame, cache: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables and offsets after a batch: what is stored of a touched path goes from every table, what is put comes in."""
    return _applied(tables, state, *_fresh(state, batch), cache)


def _applied(tables: dict[str, DataFrame], state: DataFrame, fresh: DataFrame, bad: DataFrame, sound: DataFrame, cache: DataFrame | None) -> tuple[dict[str, DataFrame], DataFrame]:
    new, paths_ = derived(sound.where("op = 'put'"), tables, cache), sound.select("repo", "path")
    return {name: old.join(paths_, ["repo", "path"], "left_anti").unionByName(new[name]) for name, old in tables.items()}, _offsets(state, fresh, bad)


def run(spark: SparkSession, feed_dir: str, mirrors: Mirrors, checkpoint: str, files_per_batch: int | None = None, cache: DataFrame | None = None, before: Callable[[int], None] | None = None) -> None:
    """Everything that has landed, batch by batch, then stop (`availableNow`); a long-running service sets a processing time instead.

    Changes of a batch take effect in the order of `seq`, in whatever files they stand; files of later batches must hold later changes.
    """

    def step(batch: DataFrame, n: int) -> None:
        if before:
            before(n)
        groups = {r[0] for r in batch.select(group_of("repo")).distinct().collect()}
        versions = mirrors.versions()
        held = {name: mirrors.visible(name, groups, versions) for name in mirrors.tables}
        offsets = mirrors.offsets(groups, versions)
        read = _fresh(offsets, batch)
        try:
            mirrors.commit(*_applied(held, offsets, *read, cache), groups, max(versions.values(), default=0) + 1)
        finally:
            for rows in read:
                rows.unpersist()

    stream = spark.readStream.schema(FEED)
    stream = stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream
    stream.parquet(feed_dir).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def request_reindex(requests: DataFrame, repo: str) -> DataFrame:
    """Q06: one more request for a repository."""
    return requests.withColumn("generation", F.when(F.col("repo") == repo, F.col("generation") + 1).otherwise(F.col("generation")))


def clear_request(requests: DataFrame, repo: str, seen: int) -> DataFrame:
    """Q06: cleared only if nobody asked again meanwhile."""
    return requests.withColumn("generation", F.when((F.col("repo") == repo) & (F.col("generation") == seen), 0).otherwise(F.col("generation")))


def vectors_wanted(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached vector, distinct hashes to embed once)."""
    held = chunks.join(cache, "content_hash")
    missing = chunks.join(cache.select("content_hash"), "content_hash", "left_anti").select("content_hash").distinct()
    return held, missing
