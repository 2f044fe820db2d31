"""Queries over scope, rendering and the remaining table changes, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths, text
from tessera.operators import edges, rendering, scope, tables
from tessera.plans.fixtures import Corpus, sql
from tessera.plans.search import _out
from tessera.streaming import feed


def p15_definitions(spark, sf_dir):
    s = Corpus(spark, sf_dir).symbols()
    kinds = F.array(*map(F.lit, ("func", "import", "property", "class")))
    langs = F.array(*map(F.lit, ("go", "ts", "json", "py", "java")))
    rows = s.select("file_id", "name", "line", F.element_at(kinds, (F.col("line") % 4 + 1).cast("int")).alias("kind"), F.element_at(langs, (F.col("file_id") % 5 + 1).cast("int")).alias("lang"))
    return _out(scope.definitions(rows), "file_id", "name", "line", "kind", "lang")


def p21_list_algebra(spark, sf_dir):
    d = Corpus(spark, sf_dir).table("documents")
    words = text.tokens(F.col("text"))
    few = F.array(*map(F.lit, ("the", "la", "der", "and", "in")))
    return _out(d.select("doc_id", F.array_join(scope.keep(words, few), " ").alias("kept"), F.array_join(F.array_distinct(scope.drop(words, few)), " ").alias("dropped")), "doc_id", "kept", "dropped")


def p24_memories(spark, sf_dir):
    c = Corpus(spark, sf_dir).table("customer")
    member = F.concat(F.lit("src"), (F.col("c_custkey") % 25).cast("string"))
    own = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(member))
    live = F.array(*[F.lit(f"src{i}") for i in range(20)])
    return _out(c.select("c_custkey", scope.applies(own, F.array(F.lit("src1"), F.lit("src2")), live).alias("applies")), "c_custkey", "applies")


def p25_docs_only(spark, sf_dir):
    return _out(scope.docs_only(Corpus(spark, sf_dir).files().withColumn("set", F.floor(F.col("file_id") / 2)), "set"), "set", "docs_only")


def p26_range_scan(spark, sf_dir):
    return _out(scope.below(Corpus(spark, sf_dir).files(), "en/d1"), "file_id", "path")


def r11_resolve(spark, sf_dir):
    wanted = spark.createDataFrame([(0, "src1"), (1, "Owner/SRC2's"), (2, "p3"), (3, "srx5"), (4, "nothing"), (5, "src3")], "pos int, name string")
    return _out(scope.resolve(wanted, Corpus(spark, sf_dir).repos()), "pos", "name", "repo", "enabled", "how")


def f40_stages(spark, sf_dir):
    d = Corpus(spark, sf_dir).table("documents").select(F.col("doc_id").alias("id"), "text")
    stages = spark.createDataFrame([("test", ["the", "der"]), ("prod", ["la"]), ("dev", ["thon"])], "stage string, aliases array<string>")
    return _out(scope.stages_in(d, stages), "id", "stage", "pos")


def f45_place(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    said = c.files().select(F.col("file_id").alias("id"), F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("see "), "path")).otherwise(F.concat(F.lit("in "), paths.base(F.col("path")), F.lit(" or 10.go"))).alias("text"))
    return _out(scope.place(said, c.files()).withColumn("file_id", F.coalesce("file_id", F.lit(-1))), "id", "candidates", "file_id")


def r17_located(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    places = c.files().select(F.col("file_id").alias("id"), F.when(F.col("file_id") % 5 == 0, -1).otherwise(F.col("file_id")).alias("file_id"), (F.col("file_id") % 12).alias("line"))
    return _out(scope.located(places, c.chunks()).withColumn("chunk_id", F.coalesce("chunk_id", F.lit(-1))), "id", "outcome", "chunk_id")


def g14_related(spark, sf_dir):
    line = Corpus(spark, sf_dir).table("lineitem")
    deps = line.where("l_quantity > 49").select(F.concat(F.lit("r"), (F.col("l_orderkey") % 10).cast("string")).alias("repo"), F.concat(F.lit("r"), (F.col("l_suppkey") % 10).cast("string")).alias("publisher")).distinct()
    return _out(scope.related("r1", "r4", deps, deps), "related")


def g14_relations(spark, sf_dir):
    """All pairs of ten repositories, each with itself too; units are linked where a part is ordered from the supplier of its own number."""
    line = Corpus(spark, sf_dir).table("lineitem")
    r = lambda c: F.concat(F.lit("r"), (F.col(c) % 25).cast("string"))
    deps = line.where("l_quantity > 49").select(r("l_orderkey").alias("repo"), r("l_suppkey").alias("publisher")).distinct()
    links = line.where("l_quantity > 48 AND l_partkey % 25 = l_suppkey % 25").select(r("l_partkey").alias("repo")).distinct()
    names = line.select(r("l_orderkey").alias("name")).distinct()
    pairs = names.select(F.col("name").alias("left"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat(F.lit("r"), i.cast("string")))).alias("right"))
    return _out(scope.relations(pairs, deps, links), "left", "right", "related", "how")


def x07_insert_or_ignore(spark, sf_dir):
    """Names of customers' first orders, into a table that holds every third customer already; an order may name its customer again."""
    c = Corpus(spark, sf_dir)
    held = c.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("held").alias("said"))
    new = c.table("orders").select(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")).alias("id"), F.col("o_orderkey").cast("string").alias("said"))
    return _out(tables.insert_or_ignore(held, new, ["id"], [F.col("said")]), "id", "said")


def g04_crossings(spark, sf_dir):
    """Crossings of each page: routes first, then destinations, in path order, each with its reason; the first five."""
    near = edges.neighbours(Corpus(spark, sf_dir).tokens())
    rank = F.when(F.col("kind") == "route", 0).when(F.col("kind") == "destination", 1).otherwise(2)
    nth = near.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(rank, "far_repo", "far_path", "far_line", "value"))).where("nth <= 5")
    reason = rendering.edge_reason(F.col("kind"), F.col("value"), F.col("path"))
    return _out(nth.withColumn("reason", reason).withColumn("p", rendering.edge_parts(F.col("reason"))).select("path", "far_path", "nth", "reason", F.col("p.value").alias("value")), "path", "far_path", "nth", "reason", "value")


def g13_called(spark, sf_dir):
    d = Corpus(spark, sf_dir).table("documents")
    p = d.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("process"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") + 20).cast("string")).otherwise("").alias("calls"), F.col("text").alias("body"))
    return _out(rendering.called(p), "repo", "process", "calls", "spent")


def g17_unit_text(spark, sf_dir):
    n = Corpus(spark, sf_dir).table("nation")
    units = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("repo"), F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "service").otherwise("library").alias("kind"))
    a, b = n.select("n_regionkey", F.col("n_name").alias("from")), n.select("n_regionkey", F.col("n_name").alias("to"))
    deps = a.join(b, "n_regionkey").where("from < to").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("repo"), "from", "to")
    return _out(rendering.unit_text(units, deps), "repo", "key", "text")


def e12_source_list(spark, sf_dir):
    f = Corpus(spark, sf_dir).chunks().select(F.floor(F.col("chunk_id") / 7).alias("id"), (F.col("chunk_id") % 3).alias("hop"), "repo", "path", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    return _out(rendering.source_list(f), "id", "text")


def e13_structure(spark, sf_dir):
    return _out(rendering.structure(Corpus(spark, sf_dir).repos()), "project", "text")


def f22_routes(spark, sf_dir):
    p = Corpus(spark, sf_dir).table("pages")
    return _out(p.select("page_id", rendering.route_of(F.concat("url", F.lit("/${id}/x?y"))).alias("route")), "page_id", "route")


def f27_cost(spark, sf_dir):
    u = Corpus(spark, sf_dir).usage()
    return _out(u.groupBy("model").agg(F.coalesce(F.round(text.usd(F.sum("cost_nano")), 9), F.lit(-1.0)).alias("usd"), F.sum("prompt").alias("prompt")), "model", "usd", "prompt")


def f37_diagram(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(m.select("message_id", rendering.diagram_kind(F.concat("question", F.when(F.col("ordinal") % 2 == 0, F.lit("\n```Flow\nx\n```")).otherwise(F.lit(" ```no")))).alias("kind")), "message_id", "kind")


def f39_days(spark, sf_dir):
    e = Corpus(spark, sf_dir).table("events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("last "), F.get_json_object("props", "$.k"), F.lit(" days"))).otherwise("recently")
    return _out(e.select("event_id", F.coalesce(rendering.day_count(said), F.lit(-1)).alias("days")), "event_id", "days")


def t07_source_order(spark, sf_dir):
    """Sources in listing order: commits last and newest first, others by hop and id."""
    e = Corpus(spark, sf_dir).table("events")
    commit = F.col("event_type") == "error"
    by = Window.partitionBy(F.col("user_id") % 10).orderBy(commit, F.when(commit, -F.unix_micros(F.col("ts").cast("timestamp"))), F.when(~commit, F.col("event_id") % 3), "event_id")
    return _out(e.select((F.col("user_id") % 10).alias("turn"), "event_id", F.row_number().over(by).alias("place")), "turn", "event_id", "place")


def t10_mechanism_first(spark, sf_dir):
    """Tests after the mechanism, both in their order; what was pointed at comes first."""
    f = Corpus(spark, sf_dir).files()
    by = Window.partitionBy("repo").orderBy(F.col("file_id") % 23 != 0, paths.is_test(F.col("path")), "path")
    return _out(f.select("repo", "path", F.row_number().over(by).alias("place")), "repo", "path", "place")


def x06_json_relation(spark, sf_dir):
    one = spark.createDataFrame([('["u1", "u5", "u9", "u1"]',)], "j string").select(F.explode(F.array_distinct(F.from_json("j", "array<string>"))).alias("repo"))
    return _out(Corpus(spark, sf_dir).commits().join(F.broadcast(one), "repo").groupBy("repo").agg(F.count("*").alias("n")), "repo", "n")


def d02_replace(spark, sf_dir):
    s = Corpus(spark, sf_dir).symbols().select("file_id", "name", "line")
    fresh = s.where("file_id % 6 = 0 AND line = 1").withColumn("name", F.upper("name"))
    return _out(tables.replace_files(s, fresh), "file_id", "name", "line")


def d08_shares(spark, sf_dir):
    """A share is raised, never lowered; a revoked one comes back with its token."""
    m = Corpus(spark, sf_dir).messages()
    held = m.groupBy("thread_id").agg(F.min("message_id").alias("ceiling")).where("thread_id % 2 = 0").select("thread_id", "ceiling", F.concat(F.lit("t"), F.col("thread_id").cast("string")).alias("token"), (F.col("thread_id") % 4 == 0).alias("revoked"))
    new = m.groupBy("thread_id").agg(F.max("message_id").alias("to")).where("thread_id % 3 = 0").select("thread_id", F.col("to").alias("new_ceiling"))
    both = held.join(new, "thread_id", "full_outer")
    out = both.select("thread_id", F.greatest("ceiling", "new_ceiling").alias("ceiling"), F.coalesce("token", F.concat(F.lit("n"), F.col("thread_id").cast("string"))).alias("token"), F.when(F.col("new_ceiling").isNotNull(), False).otherwise(F.col("revoked")).alias("revoked"))
    return _out(out, "thread_id", "ceiling", "token", "revoked")


def d09_memory(spark, sf_dir):
    c = Corpus(spark, sf_dir).table("customer")
    user = F.concat(F.lit("u"), (F.col("c_custkey") % 60).cast("string")).alias("user")
    held = c.select(user, F.col("c_mktsegment").alias("text")).distinct()
    new = c.where("c_acctbal > 5000").select(user, F.lower("c_mktsegment").alias("text")).distinct().union(spark.createDataFrame([("u1", "else")], "user string, text string"))
    return _out(tables.memory_add(held, new), "user", "text")


def q06_generations(spark, sf_dir):
    c = Corpus(spark, sf_dir).repos().select(F.col("name").alias("repo"), F.lit(1).alias("generation"))
    asked = feed.request_reindex(c, "src5")
    return _out(feed.clear_request(feed.clear_request(asked, "src5", 1), "src6", 1), "repo", "generation")


def q07_vectors(spark, sf_dir):
    c = Corpus(spark, sf_dir).files().select("file_id", F.col("sha").alias("content_hash"))
    cache = c.where("file_id % 2 = 0").select("content_hash").distinct().withColumn("held", F.lit(True))
    _, missing = feed.vectors_wanted(c, cache)
    return _out(missing, "content_hash")


QUERIES = [f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[1:3].isdigit()]

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
SQL = {
    "p15_definitions": sql("s AS (SELECT file_id, name, line, (['func', 'import', 'property', 'class'])[line % 4 + 1] AS kind, (['go', 'ts', 'json', 'py', 'java'])[file_id % 5 + 1] AS lang FROM symbols) SELECT * FROM s WHERE lang <> 'json' AND NOT (lang = 'go' AND kind = 'import') AND NOT (lang = 'ts' AND kind = 'property')", "symbols"),
    "p21_list_algebra": f"WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents), k AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w), d AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM k WHERE t IN ('the', 'la', 'der', 'and', 'in') GROUP BY 1), o AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS dropped FROM (SELECT doc_id, t, min(i) AS i FROM k WHERE t NOT IN ('the', 'la', 'der', 'and', 'in') GROUP BY 1, 2) GROUP BY 1) SELECT doc_id, coalesce(kept, '') AS kept, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN o USING (doc_id)",
    "p24_memories": "SELECT c_custkey, c_custkey % 4 = 0 OR c_custkey % 25 >= 20 OR c_custkey % 25 IN (1, 2) AS applies FROM customer",
    "p25_docs_only": sql(f"SELECT file_id // 2 AS set, bool_and(regexp_matches(path, '{paths.DOC_PATTERN}')) AS docs_only FROM files GROUP BY 1", "files"),
    "p26_range_scan": sql("SELECT file_id, path FROM files WHERE starts_with(path, 'en/d1/')", "files"),
    "r11_resolve": sql("""w AS (SELECT * FROM (VALUES (0, 'src1', 'src1'), (1, 'Owner/SRC2''s', 'src2'), (2, 'p3', 'p3'), (3, 'srx5', 'srx5'), (4, 'nothing', 'nothing'), (5, 'src3', 'src3')) v(pos, name, wf)),
        f AS (SELECT pos, w.name, r.name AS repo, enabled, CASE WHEN w.name = r.name THEN 0 WHEN w.name = project THEN 1 WHEN wf = r.name THEN 2 ELSE 3 END AS how FROM w JOIN repos r ON w.name = r.name OR w.name = project OR wf = r.name OR (length(wf) >= 4 AND length(r.name) >= 4 AND levenshtein(wf, r.name) <= 1)),
        b AS (SELECT * FROM f QUALIFY how = min(how) OVER (PARTITION BY pos)) SELECT * FROM b UNION ALL SELECT pos, name, NULL, false, 9 FROM w WHERE pos NOT IN (SELECT pos FROM b)""", "repos"),
    "f40_stages": f"WITH t AS (SELECT doc_id AS id, unnest({_TOK}) AS w, unnest(range(0, len({_TOK}))) AS pos FROM documents), s AS (SELECT * FROM (VALUES ('the', 'test'), ('der', 'test'), ('test', 'test'), ('la', 'prod'), ('prod', 'prod'), ('thon', 'dev'), ('dev', 'dev')) v(w, stage)) SELECT id, stage, min(pos) AS pos FROM t JOIN s USING (w) GROUP BY ALL",
    "f45_place": sql("SELECT file_id AS id, CASE WHEN file_id % 2 = 0 THEN 1 ELSE 1 + (SELECT count(*) FROM files WHERE regexp_extract(path, '([^/]*)$', 1) = '10.go') END AS candidates, CASE WHEN file_id % 2 = 0 OR (SELECT count(*) FROM files WHERE regexp_extract(path, '([^/]*)$', 1) = '10.go') = 0 THEN file_id ELSE -1 END AS file_id FROM files", "files"),
    "r17_located": sql("SELECT file_id AS id, CASE WHEN file_id % 5 = 0 THEN 'not found' WHEN file_id % 12 BETWEEN start_line AND end_line THEN 'pointed' ELSE 'unpinned' END AS outcome, CASE WHEN file_id % 5 <> 0 AND file_id % 12 BETWEEN start_line AND end_line THEN chunk_id ELSE -1 END AS chunk_id FROM chunks", "chunks"),
    "g14_relations": """WITH d AS (SELECT DISTINCT l_orderkey % 25 AS a, l_suppkey % 25 AS b FROM lineitem WHERE l_quantity > 49), u AS (SELECT DISTINCT l_partkey % 25 AS a FROM lineitem WHERE l_quantity > 48 AND l_partkey % 25 = l_suppkey % 25),
        p AS (SELECT a, b FROM (SELECT DISTINCT l_orderkey % 25 AS a FROM lineitem), (SELECT unnest(range(0, 25)) AS b)),
        h AS (SELECT p.a, p.b, CASE WHEN p.a = p.b AND EXISTS (SELECT 1 FROM u WHERE u.a = p.a) THEN 'units' WHEN p.a <> p.b AND EXISTS (SELECT 1 FROM d WHERE (d.a = p.a AND d.b = p.b) OR (d.a = p.b AND d.b = p.a)) THEN 'dependency' ELSE '' END AS how FROM p)
        SELECT 'r' || CAST(a AS VARCHAR) AS "left", 'r' || CAST(b AS VARCHAR) AS "right", how <> '' AS related, how FROM h""",
    "x07_insert_or_ignore": """WITH o AS (SELECT CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS id, CAST(o_orderkey AS VARCHAR) AS said FROM orders)
        SELECT c_custkey AS id, 'held' AS said FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT id, min(said) FROM o WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = id AND c_custkey % 3 = 0) GROUP BY id UNION ALL SELECT id, said FROM o WHERE id IS NULL""",
    "g14_related": "SELECT count(*) > 0 AS related FROM lineitem WHERE l_quantity > 49 AND ((l_orderkey % 10 = 1 AND l_suppkey % 10 = 4) OR (l_orderkey % 10 = 4 AND l_suppkey % 10 = 1))",
    "g04_crossings": sql("few AS (SELECT kind, value FROM tokens GROUP BY kind, value HAVING count(DISTINCT repo) <= 3), n AS (SELECT a.path, a.value, b.path AS far_path, b.repo AS far_repo, b.line AS far_line FROM tokens a JOIN few USING (kind, value) JOIN tokens b ON a.kind = b.kind AND a.value = b.value WHERE a.repo <> b.repo) SELECT path, far_path, row_number() OVER (PARTITION BY path ORDER BY far_repo, far_path, far_line, value) AS nth, 'edge:route ' || value || ' from ' || path AS reason, value FROM n QUALIFY nth <= 5", "tokens"),
    "g13_called": "SELECT repo, process, calls, spent FROM (SELECT a.source AS repo, CAST(a.doc_id AS VARCHAR) AS process, CAST(b.doc_id AS VARCHAR) AS calls, sum(length(b.text)) OVER (PARTITION BY a.source ORDER BY CAST(a.doc_id AS VARCHAR), CAST(b.doc_id AS VARCHAR))::BIGINT AS spent FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20 AND a.source = b.source WHERE a.doc_id % 3 = 0) WHERE spent <= 16000",
    "g17_unit_text": "SELECT 'r' || CAST(n.n_regionkey AS VARCHAR) AS repo, n.n_name AS key, n.n_name || ': ' || CASE WHEN n.n_nationkey % 2 = 0 THEN 'service' ELSE 'library' END || coalesce(', uses ' || (SELECT string_agg(m.n_name, ', ' ORDER BY m.n_name) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_name > n.n_name), '') AS text FROM nation n",
    "e12_source_list": sql("n AS (SELECT chunk_id // 7 AS id, row_number() OVER (PARTITION BY chunk_id // 7 ORDER BY chunk_id % 3, repo, path, start_line) AS n, repo, path, start_line, end_line FROM chunks) SELECT id, string_agg('[' || CAST(n AS VARCHAR) || '] ' || repo || '/' || path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR), chr(10) ORDER BY n) AS text FROM n GROUP BY id", "chunks"),
    "e13_structure": sql("SELECT project, string_agg('- ' || name || CASE WHEN library THEN ' (library)' ELSE '' END || CASE WHEN NOT enabled THEN ' (parked)' ELSE '' END, chr(10) ORDER BY name) AS text FROM repos GROUP BY project", "repos"),
    "f22_routes": r"SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url || '/${id}/x?y', '^[a-z]+://[^/]*', ''), '\$\{[^}]*\}', '{}', 'g'), '^([^?#]*)', 1) AS route FROM pages",
    "f27_cost": sql("SELECT model, coalesce(round(sum(cost_nano) / 1e9, 9), -1.0)::DOUBLE AS usd, sum(prompt)::BIGINT AS prompt FROM usage GROUP BY model", "usage"),
    "f37_diagram": sql("SELECT message_id, CASE WHEN ordinal % 2 = 0 THEN 'flow' ELSE '' END AS kind FROM messages", "messages"),
    "f39_days": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE -1 END AS days FROM events",
    "t07_source_order": "SELECT user_id % 10 AS turn, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_type = 'error', CASE WHEN event_type = 'error' THEN -epoch_us(ts) END NULLS FIRST, CASE WHEN event_type <> 'error' THEN event_id % 3 END NULLS FIRST, event_id) AS place FROM events",
    "t10_mechanism_first": sql(f"SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY file_id % 23 <> 0, regexp_matches(path, '{paths.TEST_PATTERN}'), path) AS place FROM files", "files"),
    "x06_json_relation": sql("SELECT repo, count(*) AS n FROM commits WHERE repo IN ('u1', 'u5', 'u9') GROUP BY repo", "commits"),
    "d02_replace": sql("SELECT file_id, name, line FROM symbols WHERE file_id NOT IN (SELECT file_id FROM symbols WHERE file_id % 6 = 0 AND line = 1) UNION ALL SELECT file_id, upper(name), line FROM symbols WHERE file_id % 6 = 0 AND line = 1", "symbols"),
    "d08_shares": sql("g AS (SELECT thread_id, min(message_id) AS lo, max(message_id) AS hi FROM messages GROUP BY 1) SELECT thread_id, CASE WHEN thread_id % 3 = 0 THEN hi ELSE lo END AS ceiling, CASE WHEN thread_id % 2 = 0 THEN 't' ELSE 'n' END || CAST(thread_id AS VARCHAR) AS token, CASE WHEN thread_id % 3 = 0 THEN false ELSE thread_id % 4 = 0 END AS revoked FROM g WHERE thread_id % 2 = 0 OR thread_id % 3 = 0", "messages"),
    "d09_memory": "WITH h AS (SELECT DISTINCT 'u' || CAST(c_custkey % 60 AS VARCHAR) AS \"user\", c_mktsegment AS text FROM customer), n AS (SELECT DISTINCT 'u' || CAST(c_custkey % 60 AS VARCHAR) AS \"user\", lower(c_mktsegment) AS text FROM customer WHERE c_acctbal > 5000 UNION SELECT 'u1', 'else') SELECT * FROM n UNION ALL SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.\"user\" = h.\"user\" AND n.text = lower(h.text))",
    "q06_generations": sql("SELECT name AS repo, CASE name WHEN 'src5' THEN 2 WHEN 'src6' THEN 0 ELSE 1 END AS generation FROM repos", "repos"),
    "q07_vectors": sql("SELECT DISTINCT sha AS content_hash FROM files WHERE sha NOT IN (SELECT sha FROM files WHERE file_id % 2 = 0)", "files"),
}
