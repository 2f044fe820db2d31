"""One file's content in several tables that are seen as a whole or not at all.

Files, chunks, keywords, symbols, tokens and vectors are Parquet tables partitioned by `group` (of repositories) and `version`. A commit writes the
groups that it touches, table by table, by dynamic partition overwrite, and last the offsets of their repositories, in one partition of its version, which are the
marker: readers take of each group the newest version that has its offsets. So what a failed commit left behind in some tables is not seen, and as its version number was
not used up, running it again writes the same partitions anew. A row without a repository stands in each written partition, so that one that is
empty now is overwritten too.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import extract, paths
from tessera.operators import postings

GROUPS = 16
FILES = "repo string, path string, sha string, size long, skip_reason string"
STATE = "repo string, last_sha string, last_seq long, error string"
#: what one file is written to; `key` of a keyword is (repo, path, ordinal) in one string
TABLES = {
    "files": FILES,
    "chunks": "repo string, path string, ordinal int, first int, last int, body string",
    "keywords": "repo string, path string, key string, term string, tf int, dl int",
    "symbols": "repo string, path string, name string, kind string, line int",
    "tokens": "repo string, path string, kind string, value string, line int",
    "vectors": "repo string, path string, ordinal int, embedding array<float>",
}
APART = "\u001d"


def group_of(repo: Column | str) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(GROUPS)).cast("int")


@dataclass
class Mirrors:
    """Tables in a folder that driver and executors share; one writer at a time."""

    spark: SparkSession
    root: str
    tables: dict[str, str]

    def _all(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{schema}, group int, version long").parquet(f"{self.root}/{name}")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def versions(self) -> dict[int, int]:
        """The version of each group that counts: a number for each of GROUPS."""
        said = self._all("offsets", STATE)
        return {r[0]: r[1] for r in said.groupBy("group").agg(F.max("version")).collect()} if said is not None else {}

    def _seen(self, name: str, schema: str, groups: Collection[int] | None, versions: dict[int, int] | None) -> DataFrame:
        pairs = sorted((g, v) for g, v in (self.versions() if versions is None else versions).items() if groups is None or g in groups)
        rows = self._all(name, schema) if pairs else None
        if rows is None:
            return self.spark.createDataFrame([], schema)
        counts = reduce(lambda a, b: a | b, ((F.col("group") == g) & (F.col("version") == v) for g, v in pairs))
        return rows.where(counts).where("repo IS NOT NULL").drop("group", "version")

    def visible(self, name: str, groups: Collection[int] | None = None, versions: dict[int, int] | None = None) -> DataFrame:
        """A table as of the last commit, of some groups or of all; only their partitions are read."""
        return self._seen(name, self.tables[name], groups, versions)

    def offsets(self, groups: Collection[int] | None = None, versions: dict[int, int] | None = None) -> DataFrame:
        return self._seen("offsets", STATE, groups, versions)

    def _write(self, name: str, rows: DataFrame, groups: Collection[int], version: int) -> None:
        blank = self.spark.createDataFrame([(g,) for g in sorted(groups)], "group int")
        whole = rows.withColumn("group", group_of("repo")).unionByName(blank, allowMissingColumns=True).withColumn("version", F.lit(version).cast("long"))
        if name == "offsets":  # few rows: a file
            whole, by = whole.repartition(1), ["version"]
        else:
            whole, by = whole.repartition("group"), ["group", "version"]
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")

    def commit(self, contents: dict[str, DataFrame], offsets: DataFrame, groups: Collection[int], version: int) -> None:
        """All rows of the groups in every table, then their offsets."""
        for name in self.tables:
            self._write(name, contents[name], groups, version)
        self._write("offsets", offsets, groups, version)

    def postings(self) -> postings.Postings:
        """The keyword table as an inverted index; a chunk counts once, whatever its words."""
        rows = self.visible("keywords").select("key", "term", "tf", "dl", postings.bucket_of(F.col("term")).alias("bucket"))
        n = self.visible("chunks").count()
        words = rows.select("key", "dl").distinct().agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        return postings.Postings(rows, n, words)


def derived(puts: DataFrame, tables: Collection[str] = tuple(TABLES), cache: DataFrame | None = None) -> dict[str, DataFrame]:
    """`puts(repo, path, body)` -> the rows of the given tables. A file that is skipped has a row in `files` and none elsewhere; `cache(content_hash, embedding)`: a chunk has the vector of its content, or none."""
    body = F.coalesce("body", F.lit(""))
    files = puts.select("repo", "path", F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("size"), paths.skip_by_body(F.col("path"), body).alias("skip_reason"))
    live = puts.withColumn("body", body).where(paths.skip_by_body(F.col("path"), F.col("body")) == "").withColumn("at", F.concat_ws(APART, "repo", "path")).withColumn("lang", F.coalesce(paths.language(F.col("path")), F.lit("")))

    def each(columns: tuple[str, ...], schema: str, fn) -> DataFrame:
        made, place = extract.over(live, "at", columns, f"at string, {schema}", fn), F.split("at", APART)
        return made.select(place[0].alias("repo"), place[1].alias("path"), *(c for c in made.columns if c != "at"))

    def chunks() -> DataFrame:
        return each(("body",), "ordinal int, first int, last int, body string", extract.chunks)

    def keywords() -> DataFrame:
        said = each(("body",), "ordinal int, said string", extract.chunk_words)
        return postings.entries(said.withColumn("key", F.concat_ws(APART, "repo", "path", "ordinal")), "key", "said", "repo", "path")

    def vectors() -> DataFrame:
        if cache is None:
            return chunks().limit(0).select("repo", "path", "ordinal", F.lit(None).cast("array<float>").alias("embedding"))
        return chunks().withColumn("content_hash", F.sha2("body", 256)).join(cache, "content_hash").select("repo", "path", "ordinal", "embedding")

    made = {
        "files": lambda: files,
        "chunks": chunks,
        "keywords": keywords,
        "symbols": lambda: each(("lang", "body"), "name string, kind string, line int", extract.symbols),
        "tokens": lambda: each(("path", "body"), "kind string, value string, line int", extract.tokens),
        "vectors": vectors,
    }
    return {name: made[name]() for name in tables}
