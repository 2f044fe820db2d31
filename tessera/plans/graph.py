"""Queries over joins, edges and walks, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import budget, edges
from tessera.plans.fixtures import Corpus, sql
from tessera.plans.search import _out

# J14/J16/J17 fixtures: units are directory keys, dependencies come from lineitem.
_FEW = "SELECT kind, value FROM tokens GROUP BY kind, value HAVING count(DISTINCT repo) <= 3"
_DEFINERS = "SELECT name FROM symbols WHERE length(name) > 2 GROUP BY name HAVING count(DISTINCT file_id) <= 4"


def j04_neighbours(spark, sf_dir):
    return _out(edges.neighbours(Corpus(spark, sf_dir).tokens()), "kind", "value", "repo", "path", "line", "far_repo", "far_path", "far_line")


def j04_repo_links(spark, sf_dir):
    """The same edges between repositories, with the number of places on either side."""
    return _out(edges.repo_links(Corpus(spark, sf_dir).tokens()), "kind", "value", "repo", "places", "path", "line", "far_repo", "far_places", "far_path", "far_line")


def j05_spread(spark, sf_dir):
    return _out(edges.spread(Corpus(spark, sf_dir).tokens()), "kind", "value", "spread")


def j06_suffix_routes(spark, sf_dir):
    return _out(edges.suffix_routes(Corpus(spark, sf_dir).tokens().withColumn("value", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("/api"), "value")).otherwise(F.col("value")))), "repo", "path", "value", "far_repo", "far_path", "far_value")


def j12_holders(spark, sf_dir):
    return _out(edges.holders(Corpus(spark, sf_dir).tokens(), "/Enierier/1"), "repo", "path", "value", "line")


def j13_in_repo(spark, sf_dir):
    t = Corpus(spark, sf_dir).tokens().where("repo = 'ads-track.example.org' AND kind = 'route'")
    return _out(t.groupBy("value").agg(F.min("path").alias("path"), F.count("*").alias("n")), "value", "path", "n")


def j07_symbol_in_chunk(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(edges.symbol_chunks(c.symbols(), c.chunks()), "file_id", "name", "line", "chunk_id", "ordinal")


def j08_chunk_at(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    places = c.files().select("file_id", (F.col("file_id") % 5 + 1).cast("int").alias("line"))
    return _out(edges.chunk_at(places, c.chunks()), "file_id", "line", "chunk_id")


def j09_lines(spark, sf_dir):
    return _out(edges.lines_between(Corpus(spark, sf_dir).chunks(), 7, 2, 4), "file_id", "line", "text")


def j11_definers(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    names = c.symbols().where("path LIKE 'fr/%'").select("name").distinct()
    return _out(edges.definers(c.symbols().where("repo <> 'src3'"), names, "src1"), "name", "repo", "path", "line")


def a01_few_definers(spark, sf_dir):
    return _out(edges.few_definers(Corpus(spark, sf_dir).symbols()), "name", "files")


def j14_dependency_exists(spark, sf_dir):
    """Suppliers publish `s/<key>`, orders of customers require parts below it: which pairs exist."""
    line = Corpus(spark, sf_dir).table("lineitem")
    publishes = line.select(F.concat(F.lit("r"), (F.col("l_suppkey") % 10).cast("string")).alias("repo"), F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("coordinate")).distinct()
    requires = line.select(F.concat(F.lit("r"), (F.col("l_orderkey") % 10).cast("string")).alias("repo"), F.concat(F.lit("s/"), F.col("l_suppkey").cast("string"), F.lit("/p"), (F.col("l_partkey") % 10).cast("string")).alias("coordinate")).distinct()
    return _out(edges.prefix_dependencies(publishes, requires), "repo", "publisher", "coordinate")


def j16_longest_prefix(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    units = c.spark.createDataFrame([("src1", "en"), ("src1", "en/d1"), ("src2", "de"), ("src2", "."), ("src5", "fr/d2")], "repo string, key string")
    return _out(edges.longest_prefix(c.files().select("repo", "path"), units), "repo", "path", "unit")


def j17_alias(spark, sf_dir):
    t = Corpus(spark, sf_dir).tokens().select("repo", "path", F.col("value").alias("literal"))
    aliases = t.where("path < 'page/2'").select("repo", F.regexp_extract("literal", "^(/[^/]*)", 1).alias("alias")).distinct().withColumn("unit", F.concat(F.lit("u"), "alias"))
    return _out(edges.alias_imports(t, aliases), "repo", "path", "literal", "alias", "unit")


def j10_includes(spark, sf_dir):
    """Files include files by stem: half of the sites with a language placeholder."""
    c = Corpus(spark, sf_dir)
    sites = c.symbols().where("line > 1").select("file_id", "repo", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("{lang}_"), (F.col("file_id") % 40).cast("string"))).otherwise((F.col("file_id") % 40).cast("string")).alias("value"), "line")
    files = c.files().withColumn("stem", F.when(F.col("file_id") % 2 == 0, F.concat("lang", F.lit("_"), (F.col("file_id") % 40).cast("string"))).otherwise((F.col("file_id") % 40).cast("string")))
    libraries = c.repos().where("library").select(F.col("name").alias("repo"), "library")
    return _out(edges.includes(sites, files, c.chunks(), libraries), "file_id", "value", "line", "rank", "far_id", "far_repo", "chunk_id")


def g01_reach(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    chunks = c.chunks().where("repo <> 'src3'")
    start = chunks.where("file_id IN (5, 11, 40)").select("file_id", "repo")
    crossing = _crossing(c)
    return _out(edges.reach(start, c.symbols().where("repo <> 'src3'"), edges.mentions(chunks), crossing).withColumn("from_id", F.coalesce("from_id", F.lit(-1))), "file_id", "repo", "hop", "from_id")


def _crossing(c: Corpus):
    """Files of other repositories with the same rare opening word: the shared token."""
    few = edges.few_definers(c.symbols().where("repo <> 'src3'")).select("name")
    s = c.symbols().where("repo <> 'src3'").join(few, "name", "left_semi").select("name", "file_id", "repo", "path").distinct()
    far = s.select("name", F.col("file_id").alias("from_id"), F.col("repo").alias("from_repo"))
    return s.join(far, "name").where("repo <> from_repo").select("from_id", "file_id", "repo", "path").distinct()


def g02_gather(spark, sf_dir):
    """Hits always in and counted, then references in order until the first that does not fit, then crossings under the larger budget."""
    from tessera.operators.gather import gather

    c = Corpus(spark, sf_dir)
    chunks = c.chunks().where("repo <> 'src3'")
    hits = chunks.where("file_id IN (5, 11, 40)").select("chunk_id", "file_id", "repo", "path", F.row_number().over(_order("chunk_id")).alias("pos"))
    return _out(gather(hits, chunks, c.symbols().where("repo <> 'src3'"), _crossing(c), 6000), "chunk_id", "file_id", "hop", "reason", "place", "spent")


def g06_census(spark, sf_dir):
    """Links of each repository: values in order of path and line, each with its first three places, under a budget that skips what does not fit."""
    t = Corpus(spark, sf_dir).tokens()
    places = t.select("repo", "value", "path", "line").distinct()
    nth = places.withColumn("nth", F.row_number().over(_part("repo", "value").orderBy("path", "line")))
    per = nth.groupBy("repo", "value").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", F.concat_ws(":", "path", F.col("line").cast("string")).alias("at"))))), lambda s: s["at"]), " ").alias("places"))
    text = per.withColumn("listing", F.when(F.col("n") > 3, F.concat("places", F.lit(" +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise(F.col("places"))).withColumn("cost", F.floor((F.char_length("listing") + 3) / 4).cast("long")).withColumn("id", F.row_number().over(_part("repo").orderBy("value")))
    kept = budget.skipping_budget(text.select("repo", "value", "id", "cost"), "cost", 60, ["value"], "id", "repo")
    return _out(text.join(kept, ["repo", "id"]), "repo", "value", "listing", "n", "cost")


def g07_gap(spark, sf_dir):
    """Names that an answer lacks, resolved to at most four files each; the home repository first."""
    c = Corpus(spark, sf_dir)
    names = c.symbols().where("file_id IN (3, 30, 300)").select("name").distinct()
    found = c.symbols().where("repo <> 'src3'").join(names, "name").groupBy("name", "repo", "path").agg(F.min("line").alias("line"))
    nth = found.withColumn("nth", F.row_number().over(_part("name").orderBy(F.when(F.col("repo") == "src1", 0).otherwise(1), "repo", "path")))
    return _out(nth.where("nth <= 4"), "name", "repo", "path", "line", "nth")


def g05_whole_file(spark, sf_dir):
    """A file's chunks are taken whole while they fit a budget: running tokens by file."""
    c = Corpus(spark, sf_dir)
    lines = c.lines().select("file_id", "line", F.floor((F.char_length("text") + 3) / 4).cast("long").alias("cost"))
    return _out(budget.prefix_budget(lines, "cost", 300, ["line"], ["file_id"]), "file_id", "line", "spent")


def _order(*cols):
    from pyspark.sql.window import Window

    return Window.orderBy(*cols)


def _part(*cols):
    from pyspark.sql.window import Window

    return Window.partitionBy(*cols)


_INLAND = """SELECT from_id, repo, file_id, path FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY path, file_id) AS nth FROM (
    SELECT s.file_id AS from_id, d.repo, d.file_id, d.path FROM {0} s JOIN said m ON m.file_id = s.file_id JOIN defs d ON d.name = m.name AND d.repo = m.repo WHERE d.file_id <> s.file_id
    UNION SELECT s.file_id, m.repo, m.file_id, m.path FROM {0} s JOIN defs d ON d.file_id = s.file_id JOIN said m ON m.name = d.name AND d.repo = m.repo WHERE m.file_id <> s.file_id)) WHERE nth <= 24"""
_WALK = f"""sy AS (SELECT * FROM symbols WHERE repo <> 'src3'), few AS MATERIALIZED (SELECT name FROM sy WHERE length(name) > 2 GROUP BY name HAVING count(DISTINCT file_id) <= 4),
    defs AS MATERIALIZED (SELECT DISTINCT repo, name, file_id, path FROM sy WHERE name IN (SELECT name FROM few)),
    said AS MATERIALIZED (SELECT DISTINCT repo, path, file_id, name FROM (SELECT repo, path, file_id, unnest(regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM hits) WHERE name IN (SELECT name FROM few)),
    cross_ AS MATERIALIZED (SELECT DISTINCT b.file_id AS from_id, a.file_id, a.repo, a.path FROM defs a JOIN defs b USING (name) WHERE a.repo <> b.repo)"""


def _hop(n: int, step: str) -> str:
    return f"n{n} AS MATERIALIZED (SELECT file_id, arg_min(repo, from_id) AS repo, {n} AS hop, min(from_id) AS from_id FROM ({step}) WHERE file_id NOT IN (SELECT file_id FROM s{n - 1}) GROUP BY file_id), s{n} AS (SELECT * FROM s{n - 1} UNION ALL SELECT * FROM n{n})"


QUERIES = [j04_neighbours, j04_repo_links, j05_spread, j06_suffix_routes, j12_holders, j13_in_repo, j07_symbol_in_chunk, j08_chunk_at, j09_lines, j11_definers, a01_few_definers, j14_dependency_exists, j16_longest_prefix, j17_alias, j10_includes, g01_reach, g02_gather, g05_whole_file, g06_census, g07_gap]

SQL = {
    "j04_neighbours": sql(f"few AS ({_FEW}) SELECT a.kind, a.value, a.repo, a.path, a.line, b.repo AS far_repo, b.path AS far_path, b.line AS far_line FROM tokens a JOIN few USING (kind, value) JOIN tokens b ON a.kind = b.kind AND a.value = b.value WHERE a.repo <> b.repo", "tokens"),
    "j04_repo_links": sql(f"few AS ({_FEW}), per AS (SELECT kind, value, repo, count(*) AS places, min((path, line)) AS f FROM tokens JOIN few USING (kind, value) GROUP BY ALL) SELECT a.kind, a.value, a.repo, a.places, a.f[1] AS path, a.f[2] AS line, b.repo AS far_repo, b.places AS far_places, b.f[1] AS far_path, b.f[2] AS far_line FROM per a JOIN per b ON a.kind = b.kind AND a.value = b.value WHERE a.repo <> b.repo", "tokens"),
    "j05_spread": sql("SELECT kind, value, count(DISTINCT repo) AS spread FROM tokens GROUP BY kind, value", "tokens"),
    "j06_suffix_routes": sql("r AS (SELECT DISTINCT repo, path, CASE WHEN file_id % 2 = 0 THEN '/api' || value ELSE value END AS value FROM tokens) SELECT a.repo, a.path, a.value, b.repo AS far_repo, b.path AS far_path, b.value AS far_value FROM r a JOIN r b ON a.repo <> b.repo AND length(a.value) > length(b.value) AND ends_with(a.value, b.value)", "tokens"),
    "j12_holders": sql(f"few AS ({_FEW}) SELECT repo, path, value, line FROM tokens JOIN few USING (kind, value) WHERE value = '/Enierier/1'", "tokens"),
    "j13_in_repo": sql("SELECT value, min(path) AS path, count(*) AS n FROM tokens WHERE repo = 'ads-track.example.org' GROUP BY value", "tokens"),
    "j07_symbol_in_chunk": sql("SELECT s.file_id, name, line, chunk_id, ordinal FROM symbols s JOIN chunks c ON s.file_id = c.file_id AND line BETWEEN start_line AND end_line", "symbols", "chunks"),
    "j08_chunk_at": sql("SELECT file_id, line, chunk_id FROM (SELECT file_id, file_id % 5 + 1 AS line FROM files) JOIN chunks USING (file_id) WHERE line BETWEEN start_line AND end_line", "files", "chunks"),
    "j09_lines": sql("SELECT file_id, line, text FROM lines WHERE file_id = 7 AND line BETWEEN 2 AND 4", "lines"),
    "j11_definers": sql(f"n AS (SELECT DISTINCT name FROM symbols WHERE path LIKE 'fr/%'), s AS (SELECT * FROM symbols WHERE repo <> 'src3'), few AS (SELECT name FROM s WHERE length(name) > 2 GROUP BY name HAVING count(DISTINCT file_id) <= 4) SELECT name, repo, path, line FROM s WHERE name IN (SELECT name FROM n) AND name IN (SELECT name FROM few) AND (repo = 'src1' OR name NOT IN (SELECT name FROM s WHERE repo = 'src1'))", "symbols"),
    "a01_few_definers": sql("SELECT name, count(DISTINCT file_id) AS files FROM symbols WHERE length(name) > 2 GROUP BY name HAVING count(DISTINCT file_id) <= 4", "symbols"),
    "j14_dependency_exists": "WITH p AS (SELECT DISTINCT 'r' || CAST(l_suppkey % 10 AS VARCHAR) AS repo, 's/' || CAST(l_suppkey AS VARCHAR) AS coordinate FROM lineitem), r AS (SELECT DISTINCT 'r' || CAST(l_orderkey % 10 AS VARCHAR) AS repo, 's/' || CAST(l_suppkey AS VARCHAR) || '/p' || CAST(l_partkey % 10 AS VARCHAR) AS coordinate FROM lineitem) SELECT DISTINCT r.repo, p.repo AS publisher, r.coordinate FROM r JOIN p ON r.repo <> p.repo AND (r.coordinate = p.coordinate OR starts_with(r.coordinate, p.coordinate || '/'))",
    "j16_longest_prefix": sql("u AS (SELECT * FROM (VALUES ('src1', 'en'), ('src1', 'en/d1'), ('src2', 'de'), ('src2', '.'), ('src5', 'fr/d2')) v(repo, key) WHERE key <> '.') SELECT f.repo, f.path, arg_max(key, length(key)) AS unit FROM files f LEFT JOIN u ON u.repo = f.repo AND starts_with(f.path, key || '/') GROUP BY ALL", "files"),
    "j17_alias": sql("a AS (SELECT DISTINCT repo, regexp_extract(value, '^(/[^/]*)', 1) AS alias FROM tokens WHERE path < 'page/2') SELECT DISTINCT t.repo, t.path, t.value AS literal, a.alias, 'u' || a.alias AS unit FROM tokens t JOIN a ON a.repo = t.repo AND (t.value = a.alias OR starts_with(t.value, a.alias || '/'))", "tokens"),
    "j10_includes": sql("""sites AS (SELECT file_id, repo, value, min(line) AS line FROM (SELECT file_id, repo, CASE WHEN file_id % 2 = 0 THEN '{lang}_' || CAST(file_id % 40 AS VARCHAR) ELSE CAST(file_id % 40 AS VARCHAR) END AS value, line FROM symbols WHERE line > 1) GROUP BY ALL),
        f AS (SELECT file_id AS far_id, repo AS far_repo, path AS far_path, CASE WHEN file_id % 2 = 0 THEN lang || '_' || CAST(file_id % 40 AS VARCHAR) ELSE CAST(file_id % 40 AS VARCHAR) END AS stem FROM files),
        l AS (SELECT * FROM (VALUES (0, 'de'), (1, 'fr'), (2, 'it'), (3, 'en')) v(rank, lang)),
        st AS (SELECT s.*, rank, replace(value, '{lang}', lang) AS stem FROM sites s JOIN l ON contains(value, '{lang}') UNION ALL SELECT s.*, 0, value FROM sites s WHERE NOT contains(value, '{lang}')),
        m AS (SELECT st.*, far_id, far_repo FROM st JOIN f USING (stem) WHERE far_id <> file_id AND (far_repo = repo OR far_repo IN ('src4', 'src14'))),
        h AS (SELECT * FROM m QUALIFY (far_repo <> repo)::INT = min((far_repo <> repo)::INT) OVER (PARTITION BY file_id, value)),
        k AS (SELECT * FROM h QUALIFY rank = min(rank) OVER (PARTITION BY file_id, value))
        SELECT file_id, value, line, rank, far_id, far_repo, far_id AS chunk_id FROM k QUALIFY row_number() OVER (PARTITION BY file_id, far_id ORDER BY line, value, rank) = 1""", "symbols", "files"),
    "g01_reach": sql(f"{_WALK}, s0 AS (SELECT file_id, repo, 0 AS hop, NULL::BIGINT AS from_id FROM hits WHERE file_id IN (5, 11, 40)), {_hop(1, _INLAND.format('s0'))}, {_hop(2, 'SELECT c.* FROM cross_ c JOIN s1 ON s1.file_id = c.from_id')}, {_hop(3, _INLAND.format('s2'))} SELECT file_id, repo, hop, coalesce(from_id, -1) AS from_id FROM s3", "hits", "symbols"),
    "g05_whole_file": sql("SELECT file_id, line, spent FROM (SELECT file_id, line, CAST(sum(ceil(length(text) / 4.0)::BIGINT) OVER (PARTITION BY file_id ORDER BY line) AS BIGINT) AS spent FROM lines) WHERE spent <= 300", "lines"),
    "g07_gap": sql("n AS (SELECT DISTINCT name FROM symbols WHERE file_id IN (3, 30, 300)), f AS (SELECT name, repo, path, min(line) AS line FROM symbols WHERE repo <> 'src3' AND name IN (SELECT name FROM n) GROUP BY ALL) SELECT name, repo, path, line, row_number() OVER (PARTITION BY name ORDER BY repo <> 'src1', repo, path) AS nth FROM f QUALIFY nth <= 4", "symbols"),
}
