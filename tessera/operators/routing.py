"""From hits to candidates and to the decision whether to ask back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR, MOST, MOST_REPOS, MARGIN, MOST_PROJECTS = 0.4, 5, 4, 0.25, 4


def candidates(hits: DataFrame) -> DataFrame:
    """`hits(pos, repo, module, score, chunk_id, supporting)` by (repo, module): best score, hits in order; ties by first appearance."""
    g = hits.groupBy("repo", "module").agg(F.max("score").alias("score"), F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"].cast("string")), ",").alias("hits"), F.every("supporting").alias("supporting"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first")) - 1)


def by_repo(found: DataFrame) -> DataFrame:
    """A16."""
    g = found.groupBy("repo").agg(F.max("score").alias("score"), F.min("first").alias("first"), F.every("supporting").alias("supporting"), F.count("*").alias("modules"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first")) - 1)


def by_project(repos: DataFrame, known: DataFrame, closure: DataFrame) -> DataFrame:
    """Repositories by project; a library joins every present project that uses it (`closure(project, library)`), else it stands alone."""
    named = repos.join(known.select(F.col("name").alias("repo"), "project", "library"), "repo")
    own = named.where("NOT library").select("project", "repo", "score", "first")
    present = own.select("project").distinct()
    users = named.where("library").join(closure.select("project", F.col("library").alias("repo")).withColumnRenamed("project", "user"), "repo").join(present.withColumnRenamed("project", "user"), "user")
    shared = users.select(F.col("user").alias("project"), "repo", "score", "first")
    alone = named.where("library").join(shared.select("repo").distinct(), "repo", "left_anti").select(F.col("repo").alias("project"), "repo", "score", "first")
    g = own.union(shared).union(alone).groupBy("project").agg(F.max("score").alias("score"), F.min("first").alias("first"), F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("repos"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "first", "project")) - 1)


def dominates(found: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Whether the first is ahead of the second by more than the margin; alone it is, at or below 0 it is not."""
    two = found.agg(F.max(F.when(F.col("place") == 0, F.col("score"))).alias("s0"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("s1"))
    return two.select("s0", "s1", F.when(F.col("s0").isNull() | (F.col("s0") <= 0), False).when(F.col("s1").isNull(), True).otherwise((F.col("s0") - F.col("s1")) / F.col("s0") > margin).alias("dominates"))


def floored(found: DataFrame, floor: float = FLOOR, most: int = MOST) -> DataFrame:
    """Candidates near the leader; those of supporting files only if nothing else is left; the first few."""
    lead = found.agg(F.max("score").alias("lead"))
    near = found.crossJoin(F.broadcast(lead)).where(F.col("score") >= floor * F.col("lead"))
    some = near.agg(F.coalesce(F.bool_or(~F.col("supporting")), F.lit(False)).alias("some"))
    kept = near.crossJoin(F.broadcast(some)).where(~F.col("supporting") | ~F.col("some"))
    return kept.withColumn("place", F.row_number().over(Window.orderBy("place")) - 1).where(F.col("place") < most).drop("lead", "some")


def ladder(facts: DataFrame) -> DataFrame:
    """One row of facts per question -> (rung, ask): the first rung that holds decides."""
    f = F.col
    rung = (
        F.when(f("named") > 0, "named")
        .when(f("all_asked"), "all")
        .when(f("projects") > MOST_PROJECTS, "too broad")
        .when(f("repos") <= 1, "single")
        .when(f("related"), "related")
        .when(f("spans"), "spans")
        .when(f("dominates"), "dominates")
        .when(f("judge").isNotNull(), "judge")
        .otherwise("role")
    )
    ask = F.when(rung == "too broad", True).when(rung == "judge", f("judge")).when(rung == "role", f("role") == "analyst").otherwise(False)
    return facts.select("*", rung.alias("rung"), ask.alias("ask"))
