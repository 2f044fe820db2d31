"""What a citation opens (S04, S07, S15, S16): a file at a commit, a commit with its files, the process models of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import extract, paths, redaction

MOST_BYTES = 1 << 20
SHA = r"^[0-9a-f]{7,64}$"


def sound_path(path: Column) -> Column:
    """Below the root, not a switch, without NUL and without steps upwards."""
    up = F.array_contains(F.split(path, "/"), "..")
    return path.isNotNull() & (path != "") & ~F.startswith(path, F.lit("/")) & ~F.startswith(path, F.lit("-")) & ~F.contains(path, F.lit("\u0000")) & ~up


def source_view(wanted: DataFrame, repos: DataFrame, files: DataFrame, blobs: DataFrame, recorded: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`wanted(id, repo, path, sha)` -> id, status, branch, sha, body (of `ok` rows, redacted).

    An empty sha means the commit that the file was indexed at; for a thread's record it must be given, and a path that the index no
    longer has is served as well. What the index skips is never served. `blobs(repo, sha, path, kind, size, body)`: bodies are read for
    rows that passed everything else (S04). The first reason counts.
    """
    w = wanted.select("id", "repo", "path", F.coalesce("sha", F.lit("")).alias("sha"))
    known = w.join(repos.select(F.col("name").alias("repo"), "branch", F.lit(True).alias("known")), "repo", "left")
    held = known.join(files.select("repo", "path", F.col("sha").alias("indexed_sha"), "skip_reason"), ["repo", "path"], "left")
    at = F.when(F.col("sha") == "", F.coalesce("indexed_sha", F.lit(""))).otherwise(F.col("sha"))
    bad = ~sound_path(F.col("path")) | ((F.col("sha") != "") & ~F.regexp_like("sha", F.lit(SHA))) | (F.lit(recorded) & (F.col("sha") == ""))
    reason = F.when(bad, "invalid").when(F.col("known").isNull(), "unknown repository").when(F.col("skip_reason").isNull() & ~F.lit(recorded), "not indexed").when(F.coalesce("skip_reason", F.lit("")) != "", "skipped")
    judged = held.select("id", "repo", "path", "branch", at.alias("sha"), reason.alias("reason"))
    shapes = blobs.select("repo", "sha", "path", "kind", "size")
    seen = judged.join(shapes, ["repo", "sha", "path"], "left")
    reason = F.coalesce("reason", F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "blob", "not a file").when(F.col("size") > most_bytes, "too large"))
    seen = seen.select("id", "repo", "path", "branch", "sha", reason.alias("reason"))
    read = seen.where("reason IS NULL").join(blobs.select("repo", "sha", "path", "body"), ["repo", "sha", "path"])
    plain = read.where(~paths.is_config(F.col("path"))).select("id", "path", "branch", "sha", "body")
    config = read.where(paths.is_config(F.col("path"))).select(F.struct("id", "path", "branch", "sha").alias("key"), "path", "body")
    kinds = dict(read.dtypes)
    schema = f"key struct<id:{kinds['id']},path:string,branch:{kinds['branch']},sha:string>, body string"
    clean = extract.over(config, "key", ("path", "body"), schema, lambda p, b: [(redaction.redact(p, b),)]).select("key.id", "key.path", "key.branch", "key.sha", "body")
    bodies = plain.union(clean)
    status = F.when(F.contains("body", F.lit("\u0000")), "binary").when(paths.secret_manifest(F.col("path"), F.col("body")) | paths.secret_shape(F.col("body")).isNotNull(), "secret").otherwise("ok")
    served = bodies.select("id", status.alias("status"), "branch", "sha", F.when(status == "ok", F.col("body")).alias("body"))
    refused = seen.where("reason IS NOT NULL").select("id", F.col("reason").alias("status"), "branch", "sha", F.lit(None).cast("string").alias("body"))
    return served.union(refused)


def commit_view(wanted: DataFrame, commits: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """`wanted(id, repo, sha)` -> the commit's time in UTC, subject and changed files `(path, added, deleted, indexed)` by path; unsound shas give nothing."""
    listed = files.where("skip_reason = ''").select("repo", "path", F.lit(True).alias("indexed"))
    rows = changes.join(listed, ["repo", "path"], "left").select("repo", "sha", F.struct("path", "added", "deleted", F.coalesce("indexed", F.lit(False)).alias("indexed")).alias("file"))
    per = rows.groupBy("repo", "sha").agg(F.array_sort(F.collect_list("file")).alias("files"))
    found = wanted.where(F.regexp_like("sha", F.lit(SHA))).join(commits, ["repo", "sha"]).join(per, ["repo", "sha"], "left")
    none = F.array().cast(dict(per.dtypes)["files"])
    return found.select("id", "repo", "sha", F.date_format(F.to_utc_timestamp("committed_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committed_at"), "subject", F.coalesce("files", none).alias("files"))


def models(files: DataFrame) -> DataFrame:
    """Process models that the index carries, by path."""
    return files.where("lang = 'bpmn' AND skip_reason = ''").select("repo", "path", "sha")
