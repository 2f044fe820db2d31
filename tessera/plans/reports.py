"""Queries over aggregates, windows, routing, conversations, history and tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths, text
from tessera.operators import budget, history, lanes, postings, routing, tables, threads, walks
from tessera.plans.fixtures import Corpus, sql
from tessera.plans.search import _out, bm25_sql, keyword_sql

_TERMS = ["thint", "theae"]


def _ranked_hits(c: Corpus):
    rows = lanes.keyword(c.chunks(), c.hits(), _TERMS, False, True, counts=c.postings().counted([(_TERMS, True)]))
    return rows.select(F.col("rank").alias("pos"), "repo", paths.directory(F.col("path")).alias("module"), "score", "chunk_id", (paths.is_test(F.col("path")) | paths.is_doc(F.col("path"))).alias("supporting"))


_RANKED = f"""h AS (SELECT rank AS pos, repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS module, score, chunk_id, regexp_matches(path, '{paths.TEST_PATTERN}') OR regexp_matches(path, '{paths.DOC_PATTERN}') AS supporting FROM ({keyword_sql(_TERMS, False, True)})),
    cand AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) - 1 AS place FROM (SELECT repo, module, max(score) AS score, min(pos) AS first, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY pos) AS hits, bool_and(supporting) AS supporting FROM h GROUP BY repo, module)),
    rep AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) - 1 AS place FROM (SELECT repo, max(score) AS score, min(first) AS first, bool_and(supporting) AS supporting, count(*) AS modules FROM cand GROUP BY repo))"""
_CLOSURE = """hop AS (SELECT DISTINCT r.project, u.uses AS library, 1 AS depth FROM uses u JOIN repos r ON r.name = u.repo AND NOT r.library JOIN repos l ON l.name = u.uses AND l.library
    UNION SELECT h.project, u.uses, h.depth + 1 FROM hop h JOIN uses u ON u.repo = h.library JOIN repos l ON l.name = u.uses AND l.library),
    clo AS (SELECT project, library, min(depth) AS depth FROM hop GROUP BY ALL)"""


def a15_candidates(spark, sf_dir):
    return _out(routing.candidates(_ranked_hits(Corpus(spark, sf_dir))), "repo", "module", "score", "first", "hits", "supporting", "place")


def a16_repos(spark, sf_dir):
    return _out(routing.by_repo(routing.candidates(_ranked_hits(Corpus(spark, sf_dir)))), "repo", "score", "first", "supporting", "modules", "place")


def a17_projects(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    closure = walks.library_closure(c.uses(), c.repos())
    return _out(routing.by_project(routing.by_repo(routing.candidates(_ranked_hits(c))), c.repos(), closure), "project", "score", "first", "repos", "place")


def a18_distinct(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    named = c.hits().select("repo").join(c.repos(), F.col("repo") == F.col("name"))
    return _out(named.agg(F.countDistinct("repo").alias("repos"), F.countDistinct("project").alias("projects")), "repos", "projects")


def w14_margin(spark, sf_dir):
    return _out(routing.dominates(routing.by_repo(routing.candidates(_ranked_hits(Corpus(spark, sf_dir))))), "s0", "s1", "dominates")


def w15_floor(spark, sf_dir):
    return _out(routing.floored(routing.candidates(_ranked_hits(Corpus(spark, sf_dir)))), "repo", "module", "score", "place")


def g15_ladder(spark, sf_dir):
    """One row of facts per user, drawn from events."""
    e = Corpus(spark, sf_dir).table("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    facts = e.select("user_id", (F.col("n") % 2).alias("named"), (F.col("m") % 11 == 0).alias("all_asked"), (F.col("n") % 7).alias("projects"), (F.col("m") % 5).alias("repos"), (F.col("m") % 13 == 0).alias("related"), (F.col("m") % 17 == 0).alias("spans"), (F.col("m") % 3 == 0).alias("dominates"), F.when(F.col("m") % 2 == 0, F.col("n") % 4 == 0).alias("judge"), F.when(F.col("m") % 4 == 1, "analyst").otherwise("developer").alias("role"))
    return _out(routing.ladder(facts), "user_id", "rung", "ask")


def a03_group_concat(spark, sf_dir):
    lines = Corpus(spark, sf_dir).lines()
    return _out(lines.groupBy("file_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n"), 256).alias("digest"), F.count("*").alias("n")), "file_id", "digest", "n")


def a04_min_line(spark, sf_dir):
    return _out(Corpus(spark, sf_dir).tokens().groupBy("file_id", "value").agg(F.min("line").alias("line")), "file_id", "value", "line")


def a05_count_with_zero(spark, sf_dir):
    """Symbols per file; files without one count 0, skipped ones are left out."""
    c = Corpus(spark, sf_dir)
    files = c.files().where(~F.endswith("path", F.lit(".md")))
    n = c.symbols().groupBy("file_id").agg(F.count("*").alias("n"))
    return _out(files.join(n, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("n")), "file_id", "n")


def a07_scope_counts(spark, sf_dir):
    return _out(Corpus(spark, sf_dir).files().groupBy("repo").agg(F.count("*").alias("total"), F.count_if(F.col("size") > 2000).alias("matched")), "repo", "total", "matched")


def a08_count_max(spark, sf_dir):
    return _out(Corpus(spark, sf_dir).commits().where("repo IN ('u1', 'u2', 'u999999')").agg(F.count("*").alias("n"), F.max("committed_at").alias("newest")), "n", "newest")


def a09_totals(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    f, s = c.files().groupBy("repo").agg(F.count("*").alias("files")), c.symbols().groupBy("repo").agg(F.count("*").alias("symbols"))
    return _out(f.join(s, "repo", "left").select("repo", "files", F.coalesce("symbols", F.lit(0)).alias("symbols")), "repo", "files", "symbols")


def a10_share_counts(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(threads.share_counts(m, threads.share_ceiling(m)), "thread_id", "shared", "beyond")


def a11_share_ceiling(spark, sf_dir):
    return _out(threads.share_ceiling(Corpus(spark, sf_dir).messages()).withColumn("ceiling", F.coalesce("ceiling", F.lit(-1))), "thread_id", "ceiling")


def a12_feedback_anchor(spark, sf_dir):
    return _out(threads.feedback_anchor(Corpus(spark, sf_dir).messages()), "thread_id", "anchor")


def a13_usage_report(spark, sf_dir):
    return _out(threads.usage_report(Corpus(spark, sf_dir).usage()).withColumn("usd", F.round("usd", 9)), "step", "calls", "prompt", "completion", "cached", "usd")


def a14_inventory(spark, sf_dir):
    r = Corpus(spark, sf_dir).repos()
    return _out(r.agg(F.countDistinct(F.when(F.col("project") == "p0", F.col("name")).otherwise(F.col("project"))).alias("projects"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("parked"), F.count_if("library").alias("libraries")), "projects", "enabled", "parked", "libraries")


def a21_histogram(spark, sf_dir):
    return _out(Corpus(spark, sf_dir).commits().groupBy("repo", "subject").agg(F.count("*").alias("n")), "repo", "subject", "n")


def _images(c: Corpus):
    o = c.table("orders")
    return o.select(F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string")).alias("stage"), F.concat(F.lit("img"), F.col("o_custkey").cast("string")).alias("image"), F.when(F.col("o_orderkey") % 31 == 0, F.lit("sha256:ab")).otherwise(F.concat(F.lit("v"), (F.col("o_custkey") % 4 + F.when(F.col("o_orderkey") % 50 == 1, 1).otherwise(0)).cast("string"))).alias("version"), F.when(F.col("o_orderkey") % 5 == 0, "kustomize").otherwise("inline").alias("origin"))


_IMAGES = "im AS (SELECT 's' || CAST(o_orderkey % 3 AS VARCHAR) AS stage, 'img' || CAST(o_custkey AS VARCHAR) AS image, CASE WHEN o_orderkey % 31 = 0 THEN 'sha256:ab' ELSE 'v' || CAST(o_custkey % 4 + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'kustomize' ELSE 'inline' END AS origin FROM orders), ce AS (SELECT stage, image, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, count(DISTINCT version) > 1 AS ambiguous FROM (SELECT * FROM im QUALIFY (origin <> 'kustomize')::INT = min((origin <> 'kustomize')::INT) OVER (PARTITION BY stage, image)) GROUP BY ALL)"


def a22_census(spark, sf_dir):
    return _out(history.image_census(_images(Corpus(spark, sf_dir))), "stage", "image", "versions", "ambiguous")


def g16_release(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    repos = c.table("customer").where("c_acctbal > 0").select(F.concat(F.lit("img"), F.col("c_custkey").cast("string")).alias("image"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("repo"), (F.col("c_custkey") % 6 == 0).alias("snapshot"), F.when(F.col("c_custkey") % 4 != 0, F.lit("h")).alias("head"))
    d = history.stage_diff(history.image_census(_images(c)), "s0", "s1", repos)
    return _out(d.withColumn("note", F.coalesce("note", F.lit("compare"))), "image", "from", "to", "repo", "note")


def j29_full_outer(spark, sf_dir):
    ce = history.image_census(_images(Corpus(spark, sf_dir)))
    a, b = (ce.where(F.col("stage") == s).select("image", F.col("versions").alias(s)) for s in ("s1", "s2"))
    return _out(a.join(b, "image", "full_outer"), "image", "s1", "s2")


def a24_covered(spark, sf_dir):
    """Projects all of whose repositories that are no libraries are present."""
    c = Corpus(spark, sf_dir)
    present = c.files().where("lang = 'fr' AND size > 4000").select(F.col("repo").alias("name")).distinct().withColumn("here", F.lit(True))
    r = c.repos().where("NOT library").join(present, "name", "left")
    return _out(r.groupBy("project").agg(F.every(F.coalesce("here", F.lit(False))).alias("covered"), F.count("*").alias("repos")), "project", "covered", "repos")


def a25_recall_mrr(spark, sf_dir):
    """Each benchmark passage asks; the documents that hold it are gold; recall at 5 and 20, and the mean reciprocal rank, of an overlap ranking."""
    c = Corpus(spark, sf_dir)
    b = c.table("benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) >= 7)).alias("words"), "text")
    asked = b.select("item_id", F.explode("words").alias("w"))
    d = c.table("documents").select("doc_id", "text", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) >= 7))).alias("w"))
    overlap = d.select("doc_id", "w").join(asked, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    ranked = overlap.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "doc_id"))).where("rank <= 20")
    gold = ranked.join(b.select("item_id", "text"), "item_id").join(c.table("documents").select("doc_id", F.col("text").alias("body")), "doc_id").where(F.contains("body", F.col("text")))
    best = b.select("item_id").join(gold.groupBy("item_id").agg(F.min("rank").alias("rank")), "item_id", "left")
    r = F.col("rank")
    return _out(best.agg(F.count("*").alias("n"), F.round(F.avg(F.when(r <= 5, 1.0).otherwise(0.0)), 6).alias("recall5"), F.round(F.avg(F.when(r <= 20, 1.0).otherwise(0.0)), 6).alias("recall20"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr")), "n", "recall5", "recall20", "mrr")


def a27_repo_status(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    f = c.files().groupBy("repo").agg(F.count("*").alias("files"), F.countDistinct(paths.directory(F.col("path"))).alias("modules"), F.sum("size").alias("bytes"))
    return _out(f.join(c.repos(), F.col("repo") == F.col("name")), "repo", "files", "modules", "bytes", "enabled")


def a28_trace(spark, sf_dir):
    h = _ranked_hits(Corpus(spark, sf_dir))
    return _out(h.groupBy("repo", "supporting").agg(F.count("*").alias("n"), F.min("pos").alias("first")), "repo", "supporting", "n", "first")


def w01_ordinals(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    w = Window.partitionBy("thread_id").orderBy("message_id")
    return _out(m.select("thread_id", "message_id", (F.row_number().over(w) - 1).alias("next"), F.first("question").over(w).alias("pinned")), "thread_id", "message_id", "next", "pinned")


def w03_budget_prefix(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    rows = c.files().withColumn("cost", F.floor((F.col("size") + 3) / 4).cast("long"))
    return _out(budget.prefix_budget(rows, "cost", 6000, ["path"], ["repo"]), "repo", "path", "cost", "spent")


def w04_budget_skip(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    rows = c.files().withColumn("cost", F.floor((F.col("size") + 3) / 4).cast("long"))
    return _out(budget.skipping_budget(rows.select("repo", "path", "file_id", "cost"), "cost", 3000, ["path"], "file_id", "repo"), "repo", "file_id", "spent")


def w05_windows(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x: F.floor((F.char_length(x) + 3) / 4).cast("int") + 1)
    d = Corpus(spark, sf_dir).table("documents").select("doc_id", F.posexplode(budget.windows(lines)).alias("ordinal", "w"))
    return _out(d.select("doc_id", "ordinal", "w.start", "w.end"), "doc_id", "ordinal", "start", "end")


def w06_regions(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    n = c.lines().groupBy("file_id").agg(F.max("line").alias("n_lines"))
    return _out(budget.regions(c.symbols().where("line % 3 = 0"), n), "file_id", "first", "last")


def w07_first(spark, sf_dir):
    t = Corpus(spark, sf_dir).tokens()
    return _out(tables.latest(t.select("repo", "value", "path", "line"), ["repo", "value"], ["path", "line"]), "repo", "value", "path", "line")


def w11_last_turn(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(threads.last_turn(m, m.groupBy("thread_id").agg(F.max("ordinal").alias("before"))), "thread_id", "message_id", "ordinal")


def w12_scope(spark, sf_dir):
    """The newest turn of each user that carries a scope."""
    e = Corpus(spark, sf_dir).table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).where("k > 60")
    return _out(e.groupBy("user_id").agg(F.max_by("k", "event_id").alias("scope"), F.max("event_id").alias("event_id")), "user_id", "scope", "event_id")


def w13_cumulative_cap(spark, sf_dir):
    n = Corpus(spark, sf_dir).commits().groupBy("repo").agg(F.count("*").alias("n"))
    return _out(budget.capped(n, "n", 60, 4000, ["repo"]), "repo", "n", "taken")


def t05_keyset_page(spark, sf_dir):
    t = Corpus(spark, sf_dir).messages().groupBy("thread_id").agg(F.count("*").alias("turns"))
    return _out(threads.page(t, 70, 30), "thread_id", "turns", "next")


def t06_history(spark, sf_dir):
    return _out(history.search(Corpus(spark, sf_dir).commits()), "rank", "repo", "sha", "subject")


def r15_commit_search(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    index = postings.of(history.searchable(c.commits()).select("id", "text"), c.table("events"), "commits", "id", "text")
    return _out(history.search(c.commits(), "purchase of the 52", index=index), "rank", "repo", "sha", "score")


def p19_window(spark, sf_dir):
    c = Corpus(spark, sf_dir).commits()
    return _out(history.since(c, F.lit("2024-01-31 00:00:00").cast("timestamp"), 14).groupBy("repo").agg(F.count("*").alias("n")), "repo", "n")


def r16_thread_search(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    m = c.messages()
    titles = m.where("ordinal = 0").select("thread_id", F.left("question", F.lit(48)).alias("title"))
    return _out(threads.thread_search(titles, m, ["thering"], n=None, titles=postings.of(titles, c.table("conversations"), "titles", "thread_id", "title"), bodies=postings.of(threads.said(m), c.table("conversations"), "messages", "message_id", "body")), "rank", "thread_id", "place", "score")


def j18_left_enrich(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    labels = c.table("labels")
    d = c.table("documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return _out(d.select("doc_id", "lang", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "doc_id", "lang", "quality", "toxic")


def j19_exists(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(c.table("customer").join(c.table("orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"), "c_custkey", "c_name")


def j20_orphans(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(threads.orphans(m, m.where("thread_id % 3 = 0").select("message_id")), "thread_id", "message_id")


def j21_prune_cache(spark, sf_dir):
    """Cached hashes that no chunk uses, but for those of queries."""
    c = Corpus(spark, sf_dir)
    cache = c.table("documents").select(F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("query:"), F.col("doc_id").cast("string"))).otherwise(F.sha2("text", 256)).alias("hash"), "doc_id")
    used = c.files().where("file_id % 3 = 0").select(F.col("sha").alias("hash"))
    return _out(cache.where("hash NOT LIKE 'query:%'").join(used, "hash", "left_anti").select("hash").distinct(), "hash")


def j22_empty_stage(spark, sf_dir):
    """Declared stages with no file under their prefix: the prefix is one of a path's leading directories."""
    c = Corpus(spark, sf_dir)
    stages = c.repos().select(F.col("name").alias("repo"), F.explode(F.array(*map(F.lit, ("en", "de/d3", "it", "fr/d99")))).alias("prefix"))
    parts = F.split("path", "/")
    dirs = c.files().select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix")).distinct()
    return _out(stages.join(dirs, ["repo", "prefix"], "left_anti"), "repo", "prefix")


def j23_absent(spark, sf_dir):
    c = Corpus(spark, sf_dir).commits()
    log = c.where("body <> '{\"k\": 52}'")
    return _out(c.join(log.select("repo", "sha"), ["repo", "sha"], "left_anti"), "repo", "sha")


def j26_ordered_lookup(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    keys = spark.createDataFrame([([40, 3, 999999, 17, 3],)], "keys array<long>").select(F.posexplode("keys").alias("pos", "event_id"))
    return _out(F.broadcast(keys).join(c.table("events"), "event_id"), "pos", "event_id", "event_type")


def j27_attach(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(m.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "message_id"))), lambda s: s["message_id"].cast("string")), ",").alias("messages")), "thread_id", "messages")


def j33_indexed_paths(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    changed = c.tokens().select("file_id", "path").distinct()
    known = c.files().where("repo <> 'src3'").select("file_id").withColumn("indexed", F.lit(True))
    return _out(changed.join(known, "file_id", "left").select("path", F.coalesce("indexed", F.lit(False)).alias("indexed")), "path", "indexed")


def x01_chain_root(spark, sf_dir):
    c = Corpus(spark, sf_dir).table("customer")
    return _out(walks.chain_roots(c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_custkey") / 2).cast("long")).alias("resumes")).withColumn("resumes", F.when(F.col("resumes") > 0, F.col("resumes")))), "id", "root", "depth")


def g10_library_closure(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(walks.library_closure(c.uses(), c.repos()), "project", "library", "depth")


def g09_cluster(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    files = c.files().select("repo", "path", F.when(F.startswith("path", F.lit("fr/d2/")), "fr/d2").alias("unit"), (F.col("size") / 2000 + 1).cast("long").alias("chunks"))
    return _out(walks.cluster(files, 20, 60), "repo", "module", "chunks", "files", "oversized", "path")


def g12_bfs(spark, sf_dir):
    """Processes of orders: their lines are nodes, each leads to the next or the one after it."""
    line = Corpus(spark, sf_dir).table("lineitem")
    n = line.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("n"))
    process = F.col("l_orderkey").cast("string").alias("process")
    nodes = n.select(process, F.col("n").cast("string").alias("node"), F.when(F.col("n") == 1, "start").otherwise("task").alias("kind"))
    flows = n.select(process, F.col("n").cast("string").alias("source"), (F.col("n") + 1 + F.col("l_partkey") % 2).cast("string").alias("target"))
    return _out(walks.process_order(flows, nodes), "process", "node", "place", "reached")


def d01_upsert(spark, sf_dir):
    f = Corpus(spark, sf_dir).files().select("repo", "path", "sha", "size")
    fresh = f.where("size % 10 = 0").withColumn("sha", F.lit("new")).withColumn("size", F.col("size") + 1)
    return _out(tables.upsert(f, fresh, ["repo", "path"]), "repo", "path", "sha", "size")


def d03_delete_missing(spark, sf_dir):
    f = Corpus(spark, sf_dir).files()
    return _out(tables.keep_listed(f, f.where("lang <> 'es'"), ["repo", "path"]), "file_id", "repo")


def d04_sync(spark, sf_dir):
    c = Corpus(spark, sf_dir).table("customer")
    name = F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("name")
    state = c.where("c_custkey % 5 <> 0").select(name, F.col("c_mktsegment").alias("url"), F.lit("main").alias("branch"), F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("last_sha"), F.col("c_nationkey").alias("file_count"))
    specs = c.where("c_custkey % 7 <> 0").select(name, F.when(F.col("c_custkey") % 11 == 0, "moved").otherwise(F.col("c_mktsegment")).alias("url"), F.when(F.col("c_custkey") % 13 == 0, "dev").otherwise("main").alias("branch"))
    return _out(tables.sync_specs(state, specs), "name", "url", "branch", "last_sha", "file_count")


def d07_cas(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages().where("ordinal = 0").select("thread_id", F.left("question", F.lit(3)).alias("title"))
    return _out(tables.compare_and_set(m, F.col("thread_id") % 2 == 0, "title", F.left("title", F.lit(3)), F.lit("named")), "thread_id", "title")


def j30_backfill(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    rows = c.files().select("file_id", F.when(F.col("file_id") % 2 == 0, F.col("lang")).alias("lang"))
    return _out(tables.backfill(rows, c.files().where("file_id % 3 <> 0").select("file_id", "lang"), ["file_id"], ["lang"]), "file_id", "lang")


def q03_changes(spark, sf_dir):
    f = Corpus(spark, sf_dir).files().select("repo", "path", "sha")
    after = f.where(~F.endswith("path", F.lit("3.go"))).withColumn("sha", F.when(F.endswith("path", F.lit(".md")), F.lit("x")).otherwise(F.col("sha"))).unionByName(f.where(F.endswith("path", F.lit("7.go"))).withColumn("path", F.concat(F.lit("new/"), "path")))
    return _out(tables.tree_changes(f, after), "repo", "path", "change")


def q08_history_sync(spark, sf_dir):
    c = Corpus(spark, sf_dir).commits().select("repo", "sha", "subject")
    held = c.where("subject <> 'error'").withColumn("subject", F.concat(F.lit("held "), "subject"))
    log = c.where("subject <> 'view' AND repo <> 'u7'")
    return _out(tables.history_sync(held, log), "repo", "sha", "subject")


def p27_violations(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    specs = c.repos().union(spark.createDataFrame([("src1", True, "p1", False), ("p2", True, "p9", False)], "name string, enabled boolean, project string, library boolean"))
    uses = c.uses().union(spark.createDataFrame([("src2", "src2"), ("src2", "nobody"), ("src4", "src5")], "repo string, uses string"))
    return _out(tables.violations(specs, uses), "rule", "name")


QUERIES = [f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] in "adgjpqrtwx" and n[1:3].isdigit()]

_COMMIT_TIER = text.tiers("purchase of the 52")[-1]
SQL = {
    "a15_candidates": sql(f"{_RANKED} SELECT repo, module, score, first, hits, supporting, place FROM cand", "hits"),
    "a16_repos": sql(f"{_RANKED} SELECT repo, score, first, supporting, modules, place FROM rep", "hits"),
    "a17_projects": sql(f"""{_CLOSURE}, {_RANKED}, nm AS (SELECT rep.*, project, library FROM rep JOIN repos ON name = repo), own AS (SELECT project, repo, score, first FROM nm WHERE NOT library),
        sh AS (SELECT clo.project, repo, score, first FROM nm JOIN clo ON clo.library = repo WHERE nm.library AND clo.project IN (SELECT project FROM own)),
        al AS (SELECT * FROM own UNION ALL SELECT * FROM sh UNION ALL SELECT repo, repo, score, first FROM nm WHERE library AND repo NOT IN (SELECT repo FROM sh))
        SELECT project, max(score) AS score, min(first) AS first, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, row_number() OVER (ORDER BY max(score) DESC, min(first), project) - 1 AS place FROM al GROUP BY project""", "repos", "uses", "hits", recursive=True),
    "a18_distinct": sql("SELECT count(DISTINCT repo) AS repos, count(DISTINCT project) AS projects FROM hits JOIN repos ON name = repo", "hits", "repos"),
    "w14_margin": sql(f"{_RANKED}, t AS (SELECT max(score) FILTER (WHERE place = 0) AS s0, max(score) FILTER (WHERE place = 1) AS s1 FROM rep) SELECT s0, s1, CASE WHEN s0 IS NULL OR s0 <= 0 THEN false WHEN s1 IS NULL THEN true ELSE (s0 - s1) / s0 > 0.25 END AS dominates FROM t", "hits"),
    "w15_floor": sql(f"{_RANKED}, near AS (SELECT * FROM cand WHERE score >= 0.4 * (SELECT max(score) FROM cand)) SELECT repo, module, score, row_number() OVER (ORDER BY place) - 1 AS place FROM near WHERE NOT supporting OR NOT (SELECT bool_or(NOT supporting) FROM near) QUALIFY row_number() OVER (ORDER BY place) <= 5", "hits"),
    "g15_ladder": """WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS m FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN n % 2 > 0 THEN 'named' WHEN m % 11 = 0 THEN 'all' WHEN n % 7 > 4 THEN 'too broad' WHEN m % 5 <= 1 THEN 'single' WHEN m % 13 = 0 THEN 'related' WHEN m % 17 = 0 THEN 'spans' WHEN m % 3 = 0 THEN 'dominates' WHEN m % 2 = 0 THEN 'judge' ELSE 'role' END AS rung FROM e)
        SELECT user_id, rung, CASE rung WHEN 'too broad' THEN true WHEN 'judge' THEN n % 4 = 0 WHEN 'role' THEN m % 4 = 1 ELSE false END AS ask FROM r""",
    "a03_group_concat": sql("SELECT file_id, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM lines GROUP BY file_id", "lines"),
    "a04_min_line": sql("SELECT file_id, value, min(line) AS line FROM tokens GROUP BY ALL", "tokens"),
    "a05_count_with_zero": sql("SELECT f.file_id, count(s.file_id) AS n FROM files f LEFT JOIN symbols s ON s.file_id = f.file_id WHERE NOT ends_with(f.path, '.md') GROUP BY 1", "files", "symbols"),
    "a07_scope_counts": sql("SELECT repo, count(*) AS total, count(*) FILTER (WHERE size > 2000) AS matched FROM files GROUP BY repo", "files"),
    "a08_count_max": sql("SELECT count(*) AS n, max(committed_at) AS newest FROM commits WHERE repo IN ('u1', 'u2', 'u999999')", "commits"),
    "a09_totals": sql("SELECT f.repo, f.n AS files, coalesce(s.n, 0) AS symbols FROM (SELECT repo, count(*) AS n FROM files GROUP BY 1) f LEFT JOIN (SELECT repo, count(*) AS n FROM symbols GROUP BY 1) s USING (repo)", "files", "symbols"),
    "a10_share_counts": sql("o AS (SELECT thread_id, min(message_id) FILTER (WHERE answer IS NULL) AS open FROM messages GROUP BY 1), c AS (SELECT m.thread_id, max(message_id) FILTER (WHERE answer IS NOT NULL AND (open IS NULL OR message_id < open)) AS ceiling FROM messages m JOIN o USING (thread_id) GROUP BY 1) SELECT thread_id, count(*) FILTER (WHERE message_id <= ceiling) AS shared, count(*) FILTER (WHERE NOT coalesce(message_id <= ceiling, false)) AS beyond FROM messages JOIN c USING (thread_id) GROUP BY 1", "messages"),
    "a11_share_ceiling": sql("o AS (SELECT thread_id, min(message_id) FILTER (WHERE answer IS NULL) AS open FROM messages GROUP BY 1) SELECT m.thread_id, coalesce(max(message_id) FILTER (WHERE answer IS NOT NULL AND (open IS NULL OR message_id < open)), -1) AS ceiling FROM messages m JOIN o USING (thread_id) GROUP BY 1", "messages"),
    "a12_feedback_anchor": sql("SELECT thread_id, max(message_id) AS anchor FROM messages WHERE answer IS NOT NULL GROUP BY 1", "messages"),
    "a13_usage_report": sql("SELECT step, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(cached)::BIGINT AS cached, round(sum(cost_nano) / 1e9, 9) AS usd FROM usage GROUP BY step", "usage"),
    "a14_inventory": sql("SELECT count(DISTINCT CASE WHEN project = 'p0' THEN name ELSE project END) AS projects, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT enabled) AS parked, count(*) FILTER (WHERE library) AS libraries FROM repos", "repos"),
    "a21_histogram": sql("SELECT repo, subject, count(*) AS n FROM commits GROUP BY ALL", "commits"),
    "a22_census": f"WITH {_IMAGES} SELECT stage, image, versions, ambiguous FROM ce",
    "g16_release": f"""WITH {_IMAGES}, r AS (SELECT 'img' || CAST(c_custkey AS VARCHAR) AS image, 'r' || CAST(c_custkey AS VARCHAR) AS repo, c_custkey % 6 = 0 AS snapshot, CASE WHEN c_custkey % 4 <> 0 THEN 'h' END AS head FROM customer WHERE c_acctbal > 0),
        b AS (SELECT image, a.versions AS "from", a.ambiguous AS fa, b.versions AS "to", b.ambiguous AS ta FROM (SELECT * FROM ce WHERE stage = 's0') a FULL JOIN (SELECT * FROM ce WHERE stage = 's1') b USING (image))
        SELECT image, "from", "to", repo, CASE WHEN repo IS NULL THEN 'undeclared' WHEN coalesce(fa, false) OR coalesce(ta, false) THEN 'ambiguous' WHEN "from" IS NULL OR "to" IS NULL THEN 'missing' WHEN "from" = "to" THEN 'unchanged' WHEN starts_with("from", 'sha256:') OR starts_with("to", 'sha256:') THEN 'digest' WHEN snapshot THEN 'snapshot' WHEN head IS NULL THEN 'never indexed' ELSE 'compare' END AS note FROM b LEFT JOIN r USING (image)""",
    "j29_full_outer": f"WITH {_IMAGES} SELECT image, a.versions AS s1, b.versions AS s2 FROM (SELECT * FROM ce WHERE stage = 's1') a FULL JOIN (SELECT * FROM ce WHERE stage = 's2') b USING (image)",
    "a24_covered": sql("SELECT project, bool_and(name IN (SELECT repo FROM files WHERE lang = 'fr' AND size > 4000)) AS covered, count(*) AS repos FROM repos WHERE NOT library GROUP BY project", "repos", "files"),
    "a25_recall_mrr": r"""WITH b AS (SELECT item_id, text, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) >= 7))) AS w FROM benchmark),
        d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) >= 7))) AS w FROM documents),
        r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, count(*) AS n FROM b JOIN d USING (w) GROUP BY ALL) QUALIFY rank <= 20),
        g AS (SELECT item_id, min(rank) AS rank FROM r JOIN benchmark USING (item_id) JOIN documents USING (doc_id) WHERE contains(documents.text, benchmark.text) GROUP BY 1)
        SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall5, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall20, round(avg(coalesce(1.0 / rank, 0.0)), 6)::DOUBLE AS mrr FROM benchmark LEFT JOIN g USING (item_id)""",
    "a27_repo_status": sql("SELECT repo, count(*) AS files, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS modules, sum(size)::BIGINT AS bytes, any_value(enabled) AS enabled FROM files JOIN repos ON name = repo GROUP BY repo", "files", "repos"),
    "a28_trace": sql(f"{_RANKED} SELECT repo, supporting, count(*) AS n, min(pos) AS first FROM h GROUP BY ALL", "hits"),
    "w01_ordinals": sql("SELECT thread_id, message_id, row_number() OVER w - 1 AS next, first(question) OVER w AS pinned FROM messages WINDOW w AS (PARTITION BY thread_id ORDER BY message_id)", "messages"),
    "w03_budget_prefix": sql("SELECT repo, path, cost, spent FROM (SELECT repo, path, (size + 3) // 4 AS cost, sum((size + 3) // 4) OVER (PARTITION BY repo ORDER BY path)::BIGINT AS spent FROM files) WHERE spent <= 6000", "files"),
    "w04_budget_skip": sql("f AS (SELECT repo, file_id, (size + 3) // 4 AS cost, row_number() OVER (PARTITION BY repo ORDER BY path) AS nth FROM files), w(repo, nth, spent, file_id) AS (SELECT repo, 0::BIGINT, 0::BIGINT, NULL::BIGINT FROM f GROUP BY repo UNION ALL SELECT w.repo, f.nth, CASE WHEN w.spent + f.cost <= 3000 THEN w.spent + f.cost ELSE w.spent END, CASE WHEN w.spent + f.cost <= 3000 THEN f.file_id END FROM w JOIN f ON f.repo = w.repo AND f.nth = w.nth + 1), t AS (SELECT repo, max(spent) AS spent FROM w GROUP BY repo) SELECT repo, file_id, t.spent FROM w JOIN t USING (repo) WHERE file_id IS NOT NULL", "files", recursive=True),
    "g12_bfs": """WITH RECURSIVE n AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, l_partkey % 2 AS odd FROM lineitem),
        c(k, n, place) AS (SELECT k, n, 0::BIGINT FROM n WHERE n = 1 UNION ALL SELECT b.k, b.n, c.place + 1 FROM c JOIN n a ON a.k = c.k AND a.n = c.n JOIN n b ON b.k = a.k AND b.n = a.n + 1 + a.odd)
        SELECT CAST(n.k AS VARCHAR) AS process, CAST(n.n AS VARCHAR) AS node, coalesce(place, (SELECT count(*) FROM c x WHERE x.k = n.k) + row_number() OVER (PARTITION BY n.k, place IS NULL ORDER BY CAST(n.n AS VARCHAR)) - 1) AS place, place IS NOT NULL AS reached FROM n LEFT JOIN c ON c.k = n.k AND c.n = n.n""",
    "w06_regions": sql("n AS (SELECT file_id, max(line) AS n FROM lines GROUP BY 1), a AS (SELECT DISTINCT file_id, line FROM symbols WHERE line % 3 = 0 UNION SELECT file_id, 1 FROM n) SELECT file_id, line AS first, coalesce(lead(line) OVER (PARTITION BY file_id ORDER BY line) - 1, n) AS last FROM a JOIN n USING (file_id)", "symbols"),
    "w07_first": sql("SELECT repo, value, path, line FROM tokens QUALIFY row_number() OVER (PARTITION BY repo, value ORDER BY path, line) = 1", "tokens"),
    "w11_last_turn": sql("SELECT thread_id, message_id, ordinal FROM messages m WHERE answer IS NOT NULL AND ordinal < (SELECT max(ordinal) FROM messages x WHERE x.thread_id = m.thread_id) QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY ordinal DESC) = 1", "messages"),
    "w12_scope": "SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS scope, max(event_id) AS event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 60 GROUP BY 1",
    "w13_cumulative_cap": sql("n AS (SELECT repo, count(*) AS n FROM commits GROUP BY 1), o AS (SELECT *, least(n, 60) AS own FROM n) SELECT repo, n, greatest(0, least(own, 4000 - (sum(own) OVER (ORDER BY repo) - own)))::BIGINT AS taken FROM o", "commits"),
    "t05_keyset_page": sql("t AS (SELECT thread_id, count(*) AS turns FROM messages GROUP BY 1), p AS (SELECT * FROM t WHERE thread_id < 70 AND EXISTS (SELECT 1 FROM t WHERE thread_id = 70) ORDER BY thread_id DESC LIMIT 30) SELECT thread_id, turns, CASE WHEN (SELECT count(*) FROM p) = 30 THEN (SELECT min(thread_id) FROM p) END AS next FROM p", "messages"),
    "t06_history": sql("SELECT row_number() OVER (ORDER BY committed_at DESC, repo, sha) - 1 AS rank, repo, sha, subject FROM commits QUALIFY rank < 40", "commits"),
    "r15_commit_search": sql(f"b AS (SELECT *, repo || chr(29) || sha AS id, subject || ' ' || body AS t FROM commits) SELECT row_number() OVER (ORDER BY score DESC, committed_at DESC, repo, sha) - 1 AS rank, repo, sha, score FROM b JOIN ({bm25_sql(_COMMIT_TIER[1], _COMMIT_TIER[2], _COMMIT_TIER[3], 'b', 'id', 't')}) USING (id) QUALIFY rank < 40", "commits"),
    "r16_thread_search": sql(f"""ti AS (SELECT thread_id, left(question, 48) AS title FROM messages WHERE ordinal = 0), bo AS (SELECT message_id, concat_ws(' ', question, answer) AS body FROM messages),
        f AS (SELECT thread_id, 0 AS place, 0.0::DOUBLE AS score FROM ({bm25_sql(['thering'], True, True, 'ti', 'thread_id', 'title')}) UNION ALL SELECT thread_id, 1, max(score) FROM ({bm25_sql(['thering'], True, True, 'bo', 'message_id', 'body')}) JOIN messages USING (message_id) GROUP BY thread_id),
        o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY place) = 1) SELECT row_number() OVER (ORDER BY place, score DESC, thread_id DESC) - 1 AS rank, thread_id, place, score FROM o""", "messages"),
    "p19_window": sql("SELECT repo, count(*) AS n FROM commits WHERE committed_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS GROUP BY 1", "commits"),
    "j18_left_enrich": "SELECT doc_id, lang, coalesce(quality, 0)::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "j19_exists": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "j20_orphans": sql("SELECT thread_id, message_id FROM messages WHERE answer IS NULL AND thread_id % 3 <> 0", "messages"),
    "j21_prune_cache": sql("SELECT DISTINCT hash FROM (SELECT CASE WHEN doc_id % 17 = 0 THEN 'query:' ELSE sha256(text) END AS hash FROM documents) WHERE hash <> 'query:' AND hash NOT IN (SELECT sha FROM files WHERE file_id % 3 = 0)", "files"),
    "j22_empty_stage": sql("SELECT name AS repo, prefix FROM repos, (VALUES ('en'), ('de/d3'), ('it'), ('fr/d99')) v(prefix) WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo = name AND starts_with(f.path, prefix || '/'))", "repos", "files"),
    "j23_absent": sql("SELECT repo, sha FROM commits WHERE body = '{\"k\": 52}'", "commits"),
    "j26_ordered_lookup": "SELECT pos, event_id, event_type FROM (VALUES (0, 40), (1, 3), (2, 999999), (3, 17), (4, 3)) k(pos, event_id) JOIN events USING (event_id)",
    "j27_attach": sql("SELECT thread_id, string_agg(CAST(message_id AS VARCHAR), ',' ORDER BY ordinal) AS messages FROM messages GROUP BY 1", "messages"),
    "j33_indexed_paths": sql("SELECT DISTINCT path, file_id IN (SELECT file_id FROM files WHERE repo <> 'src3') AS indexed FROM tokens", "tokens", "files"),
    "w05_windows": """WITH RECURSIVE c AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: (length(x) + 3) // 4 + 1) AS k FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, len(k) AS n, list_transform(range(0, len(k) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(k[1:i]) END) AS pre FROM c),
        w AS (SELECT doc_id, n, pre, 0 AS ordinal, 0 AS low, greatest(1, len(list_filter(pre, lambda x: x <= 600)) - 1) AS high FROM p
            UNION ALL SELECT doc_id, n, pre, ordinal, low, greatest(low + 1, len(list_filter(pre, lambda x: x <= pre[low + 1] + 600)) - 1) FROM
                (SELECT doc_id, n, pre, ordinal + 1 AS ordinal, greatest(low + 1, len(list_filter(pre, lambda x: x <= pre[high + 1] - 75)) - 1) AS low FROM w WHERE high < n))
        SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(low + 1 AS BIGINT) AS "start", CAST(high AS BIGINT) AS "end" FROM w""",
    "x01_chain_root": "WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey // 2 > 0 THEN c_custkey // 2 END AS resumes FROM customer), w AS (SELECT id, id AS node, 0 AS depth FROM c UNION ALL SELECT w.id, c.resumes, depth + 1 FROM w JOIN c ON c.id = w.node WHERE c.resumes IS NOT NULL) SELECT id, arg_max(node, depth) AS root, max(depth) AS depth FROM w GROUP BY id",
    "g10_library_closure": sql(f"{_CLOSURE} SELECT project, library, depth FROM clo", "uses", "repos", recursive=True),
    "d01_upsert": sql("SELECT repo, path, CASE WHEN size % 10 = 0 THEN 'new' ELSE sha END AS sha, CASE WHEN size % 10 = 0 THEN size + 1 ELSE size END AS size FROM files", "files"),
    "d03_delete_missing": sql("SELECT file_id, repo FROM files WHERE lang <> 'es'", "files"),
    "d04_sync": "WITH s AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, 'r' || CAST(c_custkey AS VARCHAR) AS name, CASE WHEN c_custkey % 11 = 0 THEN 'moved' ELSE c_mktsegment END AS url, CASE WHEN c_custkey % 13 = 0 THEN 'dev' ELSE 'main' END AS branch FROM customer WHERE c_custkey % 7 <> 0) SELECT name, url, branch, CASE WHEN s.c_custkey IS NOT NULL AND url = s.c_mktsegment AND branch = 'main' THEN 'h' || CAST(s.c_custkey AS VARCHAR) END AS last_sha, CASE WHEN s.c_custkey IS NOT NULL AND url = s.c_mktsegment THEN s.c_nationkey ELSE 0 END::BIGINT AS file_count FROM n LEFT JOIN s USING (c_custkey)",
    "d07_cas": sql("SELECT thread_id, CASE WHEN thread_id % 2 = 0 THEN 'named' ELSE left(question, 3) END AS title FROM messages WHERE ordinal = 0", "messages"),
    "j30_backfill": sql("SELECT file_id, CASE WHEN file_id % 2 = 0 OR file_id % 3 <> 0 THEN lang END AS lang FROM files", "files"),
    "q03_changes": sql("SELECT repo, path, CASE WHEN ends_with(path, '.md') THEN 'changed' ELSE 'deleted' END AS change FROM files WHERE ends_with(path, '.md') OR ends_with(path, '3.go') UNION ALL SELECT repo, 'new/' || path, 'added' FROM files WHERE ends_with(path, '7.go')", "files"),
    "q08_history_sync": sql("l AS (SELECT * FROM commits WHERE subject <> 'view' AND repo <> 'u7') SELECT repo, sha, 'held ' || subject AS subject FROM commits WHERE subject <> 'error' AND (repo NOT IN (SELECT repo FROM l) OR sha IN (SELECT sha FROM l)) UNION ALL SELECT repo, sha, subject FROM l WHERE subject = 'error'", "commits"),
    "p27_violations": sql("""sp AS (SELECT name, project, library FROM repos UNION ALL VALUES ('src1', 'p1', false), ('p2', 'p9', false)), us AS (SELECT * FROM uses UNION ALL VALUES ('src2', 'src2'), ('src2', 'nobody'), ('src4', 'src5'))
        SELECT 'name twice' AS rule, name FROM sp GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'repository and project share a name', name FROM sp WHERE name IN (SELECT project FROM sp) UNION ALL SELECT 'uses itself', repo FROM us WHERE repo = uses UNION ALL SELECT 'uses an unknown one', repo FROM us WHERE uses NOT IN (SELECT name FROM sp)
        UNION ALL SELECT 'uses outside its project', repo FROM us JOIN sp a ON a.name = repo JOIN sp b ON b.name = uses WHERE NOT b.library AND (a.library OR a.project <> b.project)""", "repos", "uses"),
}
