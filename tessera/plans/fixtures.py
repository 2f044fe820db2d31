"""Corpus-shaped views over the provided tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import postings


class Corpus:
    """The views of one data folder. Nothing is read before it is used, and only the columns that are."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def repos(self) -> DataFrame:
        """name, enabled, project, library: a source is a repository; src3 is parked, src4 and src14 are libraries."""
        names = self.table("documents").select(F.col("source").alias("name")).distinct()
        number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
        return names.select("name", (F.col("name") != "src3").alias("enabled"), F.concat(F.lit("p"), (number % 4).cast("string")).alias("project"), F.col("name").isin("src4", "src14").alias("library"))

    def uses(self) -> DataFrame:
        """repo -> repo: each uses the next library, src4 uses src14."""
        names = self.table("documents").select("source").distinct()
        number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
        return names.where(~F.col("source").isin("src4", "src14")).where(number % 3 != 2).select(F.col("source").alias("repo"), F.when(number % 3 == 0, "src4").otherwise("src14").alias("uses")).union(self.spark.createDataFrame([("src4", "src14")], "repo string, uses string"))

    def files(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), _path().alias("path"), F.sha2("text", 256).alias("sha"), "lang", F.octet_length("text").cast("long").alias("size"))

    def chunks(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.lit(0).alias("ordinal"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("raw_text"), F.col("source").alias("repo"), _path().alias("path"), "lang")

    def hits(self) -> DataFrame:
        """Chunks of enabled repositories with their address."""
        return self.chunks().where("repo <> 'src3'")

    def postings(self) -> postings.Postings:
        """The inverted index of all chunks."""
        return postings.of(self.chunks(), self.table("documents"), "chunks")

    def vectors(self) -> DataFrame:
        """Chunks of enabled repositories that have a vector."""
        return self.hits().drop("raw_text").join(self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")

    def queries(self) -> DataFrame:
        """Every vector whose id is divisible by 50 asks."""
        return self.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def question(self) -> DataFrame:
        """The question's vector: the query of the highest id."""
        return self.queries().orderBy(F.desc("query_id")).limit(1)

    def lines(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), _path().alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1).drop("pos")

    def symbols(self) -> DataFrame:
        """The capitalised word that opens a line."""
        s = self.lines().withColumn("name", F.regexp_extract("text", r"^([A-Z][a-z]+)", 1))
        return s.where("name <> ''").select("file_id", "repo", "path", "name", "line")

    def tokens(self) -> DataFrame:
        """repo, path, file_id, kind, value, line: the links of pages."""
        host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
        links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
        p = self.table("pages").select("page_id", host.alias("repo"), F.posexplode(links).alias("pos", "href"))
        return p.select("repo", F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("page_id").alias("file_id"), F.lit("route").alias("kind"), F.concat("href", F.lit("/"), F.floor(F.col("page_id") / 40).cast("string")).alias("value"), (F.col("pos") + 1).alias("line"))

    def commits(self) -> DataFrame:
        e = self.table("events")
        return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo"), F.lpad(F.hex("event_id"), 12, "0").alias("sha"), F.col("ts").cast("timestamp").alias("committed_at"), F.col("event_type").alias("subject"), F.col("props").alias("body"))

    def messages(self) -> DataFrame:
        """thread_id, message_id, ordinal, question, answer: a user turn and the assistant turn after it (null: unfinished)."""
        c = self.table("conversations").where("role <> 'system'")
        w = Window.partitionBy("conv_id").orderBy("turn")
        paired = c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).where("role = 'user'")
        return paired.select(F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), (F.row_number().over(w) - 1).alias("ordinal"), F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))

    def usage(self) -> DataFrame:
        """message_id, step, model, prompt, completion, cached (null for some models), cost_nano (null for some)."""
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("long")
        return e.select((F.col("event_id") % 97).alias("message_id"), F.col("event_type").alias("step"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), (k * 10).alias("prompt"), k.alias("completion"), F.when(F.col("event_id") % 3 != 0, F.floor(k / 2)).alias("cached"), F.when(F.col("event_id") % 3 == 1, k * 1000).alias("cost_nano"))


def _path():
    suffix = F.when(F.col("doc_id") % 7 == 0, "_test.go").when(F.col("doc_id") % 5 == 0, ".md").otherwise(".go")
    return F.concat("lang", F.lit("/d"), (F.floor(F.col("doc_id") / 10) % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), suffix)


_PATH = "lang || '/d' || CAST((doc_id // 10) % 10 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 7 = 0 THEN '_test.go' WHEN doc_id % 5 = 0 THEN '.md' ELSE '.go' END"
_NUMBER = r"CAST(regexp_extract({0}, '(\d+)$', 1) AS INT)"

#: name -> SQL; a view may use those before it.
VIEWS = {
    "repos": f"SELECT DISTINCT source AS name, source <> 'src3' AS enabled, 'p' || CAST({_NUMBER.format('source')} % 4 AS VARCHAR) AS project, source IN ('src4', 'src14') AS library FROM documents",
    "uses": f"SELECT DISTINCT source AS repo, CASE WHEN {_NUMBER.format('source')} % 3 = 0 THEN 'src4' ELSE 'src14' END AS uses FROM documents WHERE source NOT IN ('src4', 'src14') AND {_NUMBER.format('source')} % 3 <> 2 UNION ALL SELECT 'src4', 'src14'",
    "files": f"SELECT doc_id AS file_id, source AS repo, {_PATH} AS path, sha256(text) AS sha, lang, CAST(strlen(text) AS BIGINT) AS size FROM documents",
    "chunks": f"SELECT doc_id AS chunk_id, doc_id AS file_id, 0 AS ordinal, 1 AS start_line, len(string_split(text, chr(10))) AS end_line, text AS raw_text, source AS repo, {_PATH} AS path, lang FROM documents",
    "hits": "SELECT * FROM chunks WHERE repo <> 'src3'",
    "vectors": "SELECT hits.* EXCLUDE (raw_text), embedding FROM hits JOIN embeddings ON vec_id = chunk_id",
    "qvec": "SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0",
    "lines": f"SELECT doc_id AS file_id, source AS repo, {_PATH} AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents",
    "symbols": "SELECT file_id, repo, path, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS name, CAST(line AS INT) AS line FROM lines WHERE regexp_extract(text, '^([A-Z][a-z]+)', 1) <> ''",
    "links": "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repo, page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, unnest(range(1, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) + 1)) AS line FROM pages",
    "tokens": "SELECT repo, 'page/' || CAST(page_id AS VARCHAR) AS path, page_id AS file_id, 'route' AS kind, href || '/' || CAST(page_id // 40 AS VARCHAR) AS value, CAST(line AS INT) AS line FROM links",
    "commits": "SELECT 'u' || CAST(user_id AS VARCHAR) AS repo, lpad(upper(to_hex(event_id)), 12, '0') AS sha, ts AS committed_at, event_type AS subject, props AS body FROM events",
    "paired": "SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "messages": "SELECT conv_id AS thread_id, conv_id * 1000 + turn AS message_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ordinal, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM paired WHERE role = 'user'",
    "usage": "SELECT event_id % 97 AS message_id, event_type AS step, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, k * 10 AS prompt, k AS completion, CASE WHEN event_id % 3 <> 0 THEN k // 2 END AS cached, CASE WHEN event_id % 3 = 1 THEN k * 1000 END AS cost_nano FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
}
_NEEDS = {"hits": ["chunks"], "vectors": ["hits"], "symbols": ["lines"], "tokens": ["links"], "messages": ["paired"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """`body` (which may open with its own `name AS (...)` list and a SELECT) under the views it uses."""
    wanted: list[str] = []

    def need(v: str) -> None:
        for x in _NEEDS.get(v, []):
            need(x)
        if v not in wanted:
            wanted.append(v)

    for v in views:
        need(v)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    body = body.strip()
    joiner = "" if body[:6].upper() == "SELECT" else ", " if head else ""
    start = "WITH RECURSIVE " if recursive else "WITH "
    return f"{start if head or joiner or not body[:6].upper() == 'SELECT' else ''}{head}{joiner} {body}"
