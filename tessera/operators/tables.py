"""Changes to tables as new versions of them (D01-D14, J18-J23, J30, Q06-Q08, X09): upserts, replacements, merges, sets.

Tables are immutable DataFrames: each function returns the table after the change, to be written beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths


def latest(rows: DataFrame, keys: list[str], by: list) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key. The shuffle is on the keys alone."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_or_ignore(held: DataFrame, new: DataFrame, keys: list[str], by: list) -> DataFrame:
    """What is held stays as it is; of new rows the first of each key in the given order comes in, if nothing is held under it. A null key is never the same as another."""
    unlike = latest(new.join(held.select(*keys).distinct(), keys, "left_anti").where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, by)
    return held.unionByName(unlike).unionByName(new.where(" OR ".join(f"{k} IS NULL" for k in keys)))


def replace_files(rows: DataFrame, fresh: DataFrame, key: str = "file_id") -> DataFrame:
    """A file's rows are cleared and written anew."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def keep_listed(rows: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """What is no longer in the tree goes."""
    return rows.join(tree.select(*keys).distinct(), keys, "left_semi")


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, change) between two trees of (repo, path, sha): added, changed, deleted."""
    b = before.select("repo", "path", F.col("sha").alias("old"))
    both = after.select("repo", "path", F.col("sha").alias("new")).join(b, ["repo", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("repo", "path", change.alias("change")).where("change IS NOT NULL")


def tree_after(stored: DataFrame, changes: DataFrame, live: DataFrame) -> DataFrame:
    """Stored rows but for touched paths, and the live versions of those."""
    return stored.join(changes.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(live.join(changes.where("change <> 'deleted'").select("repo", "path"), ["repo", "path"], "left_semi"))


def rules_drift(held: DataFrame, repos: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """Of each enabled repository, how many `held(repo, path, skip_reason)` files the rules skip now that were indexed, and how many excluded ones they include again; no row where nothing moved."""
    excluded = paths.skip_by_path(F.col("path"), exclude)
    rows = held.join(repos.where("enabled").select(F.col("name").alias("repo")), "repo", "left_semi")
    counts = rows.groupBy("repo").agg(F.count_if((F.col("skip_reason") == "") & excluded.isNotNull()).alias("retired"), F.count_if((F.col("skip_reason") == "excluded") & ~excluded.eqNullSafe("excluded")).alias("reincluded"))
    return counts.where("retired > 0 OR reincluded > 0")


def sync_sets(held: DataFrame, fresh: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """The rows of touched keys are replaced whole by `fresh`, repeated rows count once; a touched key without rows ends up empty."""
    return held.join(touched, key, "left_anti").unionByName(fresh.join(touched, key, "left_semi").distinct())


def history_sync(held: DataFrame, log: DataFrame) -> DataFrame:
    """Commits that the log lost are dropped, held ones stay as they are, new ones come in."""
    repos = log.select("repo").distinct()
    kept = held.join(repos, "repo", "left_anti").unionByName(held.join(repos, "repo", "left_semi").join(log.select("repo", "sha"), ["repo", "sha"], "left_semi"))
    return kept.unionByName(log.join(held.select("repo", "sha"), ["repo", "sha"], "left_anti"))


def sync_specs(state: DataFrame, specs: DataFrame) -> DataFrame:
    """Unlisted repositories go, a changed address resets progress, a changed branch only the sha."""
    s = specs.select("name", F.col("url").alias("new_url"), F.col("branch").alias("new_branch"))
    both = s.join(state, "name", "left")
    moved = ~F.col("url").eqNullSafe(F.col("new_url"))
    other = ~F.col("branch").eqNullSafe(F.col("new_branch"))
    return both.select("name", F.col("new_url").alias("url"), F.col("new_branch").alias("branch"), F.when(~moved & ~other, F.col("last_sha")).alias("last_sha"), F.when(~moved, F.col("file_count")).otherwise(0).alias("file_count"))


def compare_and_set(rows: DataFrame, key: Column, column: str, expected: Column, value: Column) -> DataFrame:
    """The column changes where the row is meant and still has the expected value."""
    return rows.withColumn(column, F.when(key & F.col(column).eqNullSafe(expected), value).otherwise(F.col(column)))


def backfill(rows: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Missing values from another table."""
    other = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(other, keys, "left")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def violations(specs: DataFrame, uses: DataFrame) -> DataFrame:
    """What a repository list may not hold, as (rule, name) rows; a sound list gives none."""
    twice = specs.groupBy("name").count().where("count > 1").select(F.lit("name twice").alias("rule"), "name")
    clash = specs.join(specs.select(F.col("project").alias("name")).distinct(), "name", "left_semi").select(F.lit("repository and project share a name").alias("rule"), "name")
    itself = uses.where("repo = uses").select(F.lit("uses itself").alias("rule"), F.col("repo").alias("name"))
    unknown = uses.join(specs.select(F.col("name").alias("uses")), "uses", "left_anti").select(F.lit("uses an unknown one").alias("rule"), F.col("repo").alias("name"))
    known = specs.select("name", "project", "library")
    a = known.select(F.col("name").alias("repo"), F.col("project").alias("p1"), F.col("library").alias("l1"))
    b = known.select(F.col("name").alias("uses"), F.col("project").alias("p2"), F.col("library").alias("l2"))
    reach = uses.join(a, "repo").join(b, "uses")
    outside = reach.where("NOT l2 AND (l1 OR p1 <> p2)").select(F.lit("uses outside its project").alias("rule"), F.col("repo").alias("name"))
    return twice.union(clash).union(itself).union(unknown).union(outside)


def memory_add(held: DataFrame, new: DataFrame, most: int = 40) -> DataFrame:
    """`(user, text)` added without case-insensitive repeats; more than `most` of one user is an error."""
    fold = F.lower(F.trim("text"))
    out = held.withColumn("fold", fold).join(new.withColumn("fold", fold).select("user", "fold"), ["user", "fold"], "left_anti").drop("fold")
    merged = out.unionByName(latest(new.withColumn("fold", fold), ["user", "fold"], [F.desc("text")]).drop("fold"))
    n = F.count("*").over(Window.partitionBy("user"))
    sound = F.when(F.col("n") <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("too many memories of "), F.col("user"))).cast("boolean"))
    return merged.withColumn("n", n).where(sound).drop("n")
