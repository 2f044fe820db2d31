"""Commits and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.lanes import bm25, counted
from tessera.operators.storage import kept

DEFAULT_DAYS, MOST_DAYS, ROWS = 14, 365, 40


def clamp_days(days: Column) -> Column:
    """The default for nothing or less than a day, the maximum at most."""
    return F.when(days.isNull() | (days <= 0), DEFAULT_DAYS).otherwise(F.least(days, F.lit(MOST_DAYS)))


def since(commits: DataFrame, now: Column, days: int) -> DataFrame:
    return commits.where(F.col("committed_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def searchable(commits: DataFrame) -> DataFrame:
    """Commits with what is searched of them and a key: `id`, `text`."""
    return commits.withColumn("text", F.concat_ws(" ", "subject", "body")).withColumn("id", F.concat_ws("\u001d", "repo", "sha"))


def search(commits: DataFrame, topic: str = "", n: int = ROWS, index=None) -> DataFrame:
    """With a topic the widest tier by bm25, then newest, repository; without one newest, repository, sha. `index`: postings of `searchable(commits)`, else they are counted here."""
    if not topic:
        by = [F.desc("committed_at"), F.col("repo"), F.col("sha")]
        return commits.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)) - 1)
    _, terms, all_match, prefix = text.tiers(topic)[-1]
    body = searchable(commits)
    asked = [(terms, prefix)]
    scored = body.join(bm25(index.counted(asked, "id") if index else counted(body.select("id", "text"), asked, "id", "text"), terms, all_match, prefix), "id")
    by = [F.desc("score"), F.desc("committed_at"), F.col("repo"), F.col("sha")]
    return scored.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)) - 1).drop("text", "id")


def image_census(uses: DataFrame) -> DataFrame:
    """`(stage, image, version, origin)` -> one row per stage and image: kustomize beats inline; several versions are ambiguous."""
    rank = F.when(F.col("origin") == "kustomize", 0).otherwise(1)
    best = uses.withColumn("rank", rank).withColumn("least", F.min("rank").over(Window.partitionBy("stage", "image"))).where("rank = least")
    g = best.groupBy("stage", "image").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return g.select("stage", "image", F.array_join("versions", ",").alias("versions"), (F.size("versions") > 1).alias("ambiguous"))


def stage_diff(census: DataFrame, left: str, right: str, repos: DataFrame) -> DataFrame:
    """The images of two stages side by side, each with its repository and a note, in the order of the rules."""
    a = census.where(F.col("stage") == left).select("image", F.col("versions").alias("from"), F.col("ambiguous").alias("from_ambiguous"))
    b = census.where(F.col("stage") == right).select("image", F.col("versions").alias("to"), F.col("ambiguous").alias("to_ambiguous"))
    both = a.join(b, "image", "full_outer").join(repos, "image", "left")
    digest = F.startswith(F.coalesce("from", F.lit("")), F.lit("sha256:")) | F.startswith(F.coalesce("to", F.lit("")), F.lit("sha256:"))
    note = (
        F.when(F.col("repo").isNull(), "undeclared")
        .when(F.coalesce("from_ambiguous", F.lit(False)) | F.coalesce("to_ambiguous", F.lit(False)), "ambiguous")
        .when(F.col("from").isNull() | F.col("to").isNull(), "missing")
        .when(F.col("from") == F.col("to"), "unchanged")
        .when(digest, "digest")
        .when(F.col("snapshot"), "snapshot")
        .when(F.col("head").isNull(), "never indexed")
    )
    return both.withColumn("note", note)


def ancestry(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """Every commit reachable from each tip with its least distance: `(tip, sha, distance)`.

    Jumps double: round k knows all commits within less than 2^k steps of a tip, and those 2^k steps above each commit, which it
    puts together; so 10,000 commits in a line take 14 rounds. There is no bound of steps. As distances are without gaps, a round that finds nothing
    new is the last, in rings too.
    """
    seen = kept(tips.select(F.col("sha").alias("tip"), "sha", F.lit(0).cast("long").alias("distance")).distinct())
    jumps = kept(parents.where("parent IS NOT NULL").select("sha", F.col("parent").alias("to")).distinct())
    step, n = 1, seen.count()
    while True:
        further = seen.join(jumps, "sha").select("tip", F.col("to").alias("sha"), (F.col("distance") + step).alias("distance"))
        seen = kept(seen.unionByName(further).groupBy("tip", "sha").agg(F.min("distance").alias("distance")))
        before, n = n, seen.count()
        if n == before:
            return seen
        jumps = kept(jumps.select("sha", F.col("to").alias("via")).join(jumps.select(F.col("sha").alias("via"), "to"), "via").select("sha", "to").distinct())
        step *= 2


def contained_in(tags: DataFrame, tips: DataFrame, parents: DataFrame) -> DataFrame:
    """`tags(repo, tag, sha)` and `tips(repo, sha)` -> whether each tag's commit is an ancestor of its repository's tip (or is it), and the commits between."""
    reach = ancestry(parents, tips.select("sha")).join(tips.select("repo", F.col("sha").alias("tip")), "tip").select("repo", "sha", "distance")
    return tags.join(reach, ["repo", "sha"], "left").select("repo", "tag", "sha", F.col("distance").isNotNull().alias("contained"), F.col("distance").alias("behind"))
