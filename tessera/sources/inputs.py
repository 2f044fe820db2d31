"""Sources (S01-S09, S14-S18): landed trees and logs, repository lists, manifests, BPMN; read by Spark, parsed per row."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import extract

TREE = "repo string, sha string, path string, mode string, size long, content binary"
SKIPPED_MODES = ("120000", "160000")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """A landed tree listing without links and submodules; `content` is read only where it is selected."""
    return spark.read.schema(TREE).parquet(path).where(~F.col("mode").isin(*SKIPPED_MODES))


def snapshot(spark: SparkSession, directory: str, repo: str) -> DataFrame:
    """A directory as a tree: paths below it, sizes and contents."""
    root = F.lit(re.sub(r"^file:/*", "/", directory).rstrip("/") + "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    name = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.lit(repo).alias("repo"), F.sha2("content", 256).alias("sha"), F.replace(name, root, F.lit("")).alias("path"), F.lit("100644").alias("mode"), F.col("length").alias("size"), "content")


def git_log(lines: DataFrame) -> DataFrame:
    """`(repo, value)` records of sha, date, author, subject, body split by NUL -> commits; `*-by:` trailers are left out."""
    p = F.split("value", "\u0000")
    body = F.trim(F.regexp_replace(F.element_at(p, 5), r"(?im)^[\w-]+-by:.*(?:\n|$)", ""))
    return lines.where(F.size(p) >= 5).select("repo", F.regexp_replace(F.element_at(p, 1), r"^\s+|\s+$", "").alias("sha"), F.to_timestamp(F.element_at(p, 2)).alias("committed_at"), F.element_at(p, 3).alias("author"), F.element_at(p, 4).alias("subject"), body.alias("body"))


RECORD, UNIT = "\u001e", "\u0000"


def history_log(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Landed logs, in folders `repo=<name>` below `path`, as commits (see `git_log`), with what is wrong with a record in `error`: then nothing else of it is there.

    Records end with RS, so bodies may hold any lines, and fields with NUL. RS is the reader's separator, so files are split and read in parallel. `newest`: so
    many of each repository, by date and sha; a broken record counts among none.
    """
    lines = spark.read.schema("value string, repo string").option("lineSep", RECORD).text(path)
    p, at = F.split("value", UNIT), lambda n: F.try_element_at(F.split("value", UNIT), F.lit(n))
    when = F.try_to_timestamp(F.trim(at(2)))
    error = F.when(F.size(p) != 5, F.concat(F.size(p).cast("string"), F.lit(" fields"))).when(~F.regexp_like(at(1), F.lit(r"^\s*[0-9a-fA-F]{7,64}\s*$")), "no commit id").when(when.isNull(), "no date").otherwise("")
    marked = lines.where(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "").withColumn("error", error)
    sound = git_log(marked.where("error = ''")).withColumn("error", F.lit(""))
    if newest is not None:
        nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("committed_at"), "sha"))
        sound = sound.withColumn("nth", nth).where(F.col("nth") <= newest).drop("nth")
    return sound.unionByName(marked.where("error <> ''").select("repo", "error"), allowMissingColumns=True)


MOST_BYTES = 1 << 20


def blobs(files: DataFrame, most_bytes: int = MOST_BYTES, size: str = "size") -> DataFrame:
    """`files(repo, path, <size>, content)` -> repo, path, size, status, body: `ok` with its text, `too_large`, `missing` (no content) or `binary` (NUL, or no UTF-8).

    Sizes are judged first: contents are a column of the scan for rows under the limit only, and the limit reaches the reader (also that of `binaryFile`, with `size="length"`: larger files are not
    opened). A row that cannot be decoded is a row of its own and spoils no other.
    """
    small = files.where(F.col(size) <= most_bytes)
    text = F.col("content").cast("string")
    status = F.when(F.col("content").isNull(), "missing").when(~F.is_valid_utf8(text) | F.contains(text, F.lit("\u0000")), "binary").otherwise("ok")
    read = small.select("repo", "path", F.col(size).alias("size"), status.alias("status"), F.when(status == "ok", text).alias("body"))
    large = files.where(F.col(size).isNull() | (F.col(size) > most_bytes)).select("repo", "path", F.col(size).alias("size"), F.when(F.col(size).isNull(), "missing").otherwise("too_large").alias("status"), F.lit(None).cast("string").alias("body"))
    return read.unionByName(large)


def repository_list(spark: SparkSession, text: str) -> DataFrame:
    """A YAML or JSON list of projects and libraries -> one row per repository; unsound names raise ValueError."""
    try:
        said = json.loads(text)
    except ValueError:
        import yaml

        said = yaml.safe_load(text)
    rows = []
    for project in [*said.get("projects", []), *({"name": None, "repositories": [r], "library": True} for r in said.get("libraries", []))]:
        for r in project.get("repositories", []):
            if not re.fullmatch(r"[\w.\-]+", r.get("name", "")):
                raise ValueError(f"a repository needs a plain name: {r.get('name')!r}")
            rows.append((r["name"], r.get("clone_url", ""), r.get("branch", ""), project.get("name") or r["name"], bool(project.get("library")), bool(r.get("enabled", project.get("enabled", True))), r.get("uses", []), [(s["name"], s["path"], s.get("aliases", [])) for s in r.get("stages", [])]))
    return spark.createDataFrame(rows, "name string, clone_url string, branch string, project string, library boolean, enabled boolean, uses array<string>, stages array<struct<name:string,path:string,aliases:array<string>>>")


def processes(models: DataFrame) -> DataFrame:
    """`(file_id, body)` of BPMN models -> their elements."""
    return extract.over(models, "file_id", ("body",), "file_id bigint, process string, kind string, id string, a string, b string", extract.process_model)


def go_modules(files: DataFrame) -> DataFrame:
    """What go.mod files publish and require: `(repo, coordinate, direction)`."""
    mods = files.where(F.regexp_like("path", F.lit(r"(^|/)go\.mod$")))
    publishes = mods.select("repo", F.regexp_extract("body", r"(?m)^module\s+(\S+)", 1).alias("coordinate"), F.lit("publishes").alias("direction"))
    requires = mods.select("repo", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+v\S+"), F.lit(1))).alias("coordinate"), F.lit("requires").alias("direction"))
    return publishes.union(requires).where("coordinate <> ''").distinct()


def npm_packages(files: DataFrame) -> DataFrame:
    """Names and dependencies of package.json files."""
    p = files.where(F.regexp_like("path", F.lit(r"(^|/)package\.json$"))).select("repo", F.from_json("body", "name string, dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    deps = F.array_union(F.coalesce(F.map_keys("j.dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("j.devDependencies"), F.array().cast("array<string>")))
    return p.select("repo", F.col("j.name").alias("coordinate"), F.lit("publishes").alias("direction")).where("coordinate IS NOT NULL").union(p.select("repo", F.explode(deps).alias("coordinate"), F.lit("requires").alias("direction"))).distinct()


def maven_units(files: DataFrame) -> DataFrame:
    """Units of pom.xml files: key (directory), artifact, group (the parent's if it has none), kind; a packaging pom is none."""
    p = files.where(F.regexp_like("path", F.lit(r"(^|/)pom\.xml$")))
    own = F.regexp_replace("body", r"(?s)<(build|parent|dependencies|dependencyManagement|profiles)>.*?</\1>", "")
    one = lambda text, tag: F.regexp_extract(text, rf"<{tag}>\s*([^<\s]*)\s*</{tag}>", 1)
    parent = F.regexp_extract("body", r"(?s)<parent>(.*?)</parent>", 1)
    kind = F.when(F.contains("body", F.lit("spring-boot-maven-plugin")), "service").otherwise("library")
    units = p.select("repo", F.regexp_replace(F.regexp_replace("path", r"/?pom\.xml$", ""), "^$", ".").alias("key"), one(own, "artifactId").alias("artifact"), F.coalesce(F.nullif(one(own, "groupId"), F.lit("")), one(parent, "groupId")).alias("group"), kind.alias("kind"), one(own, "packaging").alias("packaging"))
    return units.where("artifact <> '' AND packaging <> 'pom'").drop("packaging")


def nx_units(files: DataFrame) -> DataFrame:
    """Units of project.json files below the root, with the names of what they depend on."""
    p = files.where(F.regexp_like("path", F.lit(r"/project\.json$")))
    j = F.from_json("body", "name string, projectType string, tags array<string>, implicitDependencies array<string>")
    return p.select("repo", F.regexp_replace("path", r"/project\.json$", "").alias("key"), j.alias("j")).select("repo", "key", F.coalesce("j.name", F.regexp_extract("key", r"([^/]*)$", 1)).alias("name"), F.coalesce("j.projectType", F.lit("")).alias("kind"), F.array_join(F.coalesce("j.tags", F.array().cast("array<string>")), " ").alias("tags"), F.coalesce("j.implicitDependencies", F.array().cast("array<string>")).alias("needs"))


def gradle_includes(files: DataFrame) -> DataFrame:
    """Directories that settings files include: `:a:b` is a/b."""
    s = files.where(F.regexp_like("path", F.lit(r"(^|/)settings\.gradle(\.kts)?$")))
    names = F.regexp_extract_all(F.array_join(F.regexp_extract_all("body", F.lit(r"(?m)^\s*include\b([^\n]*(?:,\s*\n[^\n]*)*)"), F.lit(1)), "\n"), F.lit(r"[\"']:?([\w:.\-]+)[\"']"), F.lit(1))
    return s.select("repo", F.explode(names).alias("n")).select("repo", F.replace("n", F.lit(":"), F.lit("/")).alias("key")).distinct()
