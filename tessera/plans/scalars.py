"""Queries over text and path functions and the extraction helpers, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import extract, paths, redaction, text
from tessera.operators import running
from tessera.plans.fixtures import Corpus, sql
from tessera.plans.search import _out

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _docs(spark, sf_dir):
    return Corpus(spark, sf_dir).table("documents")


def f01_tokens(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return _out(_docs(spark, sf_dir).select("doc_id", F.size(t).alias("n"), F.sha2(F.array_join(t, " "), 256).alias("digest")), "doc_id", "n", "digest")


def f02_camel_words(spark, sf_dir):
    c = Corpus(spark, sf_dir).symbols()
    return _out(c.select("file_id", "line", F.array_join(text.camel_words(F.concat("name", F.initcap("name"), F.lit("_x9Y"))), " ").alias("words")), "file_id", "line", "words")


def f03_identifiers(spark, sf_dir):
    i = text.identifiers(F.col("text"))
    return _out(_docs(spark, sf_dir).select("doc_id", F.size(i).alias("n"), F.sha2(F.array_join(F.array_sort(i), " "), 256).alias("digest")), "doc_id", "n", "digest")


def f04_fold(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", F.sha2(text.folded(F.col("text")), 256).alias("digest")), "doc_id", "digest")


def f05_content_words(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", F.size(text.content_words(F.col("text"))).alias("n")), "doc_id", "n")


def f08_contains(spark, sf_dir):
    return _out(_docs(spark, sf_dir).where(text.contains_term(F.col("text"), F.lit("THERHA")) | text.contains_term(F.col("text"), F.lit("éle"))).select("doc_id", "lang"), "doc_id", "lang")


def f09_token_estimate(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("cost")), "doc_id", "cost")


def f10_excerpt(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", text.excerpt(F.col("text"), 200).alias("excerpt")), "doc_id", "excerpt")


def f11_hash(spark, sf_dir):
    f = Corpus(spark, sf_dir).files()
    return _out(f.select("file_id", text.content_hash("repo", "path", "sha").alias("hash")), "file_id", "hash")


def f12_enriched(spark, sf_dir):
    c = Corpus(spark, sf_dir).chunks()
    return _out(c.select("chunk_id", F.sha2(text.enriched(F.col("repo"), F.col("path"), F.lit(""), F.col("raw_text")), 256).alias("digest")), "chunk_id", "digest")


def f13_repo_fold(spark, sf_dir):
    c = Corpus(spark, sf_dir).table("part")
    return _out(c.select("p_partkey", text.repo_fold(F.concat(F.lit("Owner/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "'s").otherwise("s"))).alias("name")), "p_partkey", "name")


def f14_one_edit(spark, sf_dir):
    """Names one edit apart, joined through deletion variants instead of all pairs."""
    names = Corpus(spark, sf_dir).symbols().where(F.char_length("name") >= 4).select(F.lower("name").alias("name")).distinct()
    n = F.char_length("name")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left("name", i - 1), F.right("name", n - i)))
    variants = names.select("name", F.explode(F.array_distinct(F.array_append(cut, F.col("name")))).alias("v"))
    other = variants.select(F.col("name").alias("other"), "v")
    pairs = variants.join(other, "v").where("name < other").select("name", "other").distinct()
    return _out(pairs.where(text.within_one_edit(F.col("name"), F.col("other"))), "name", "other")


def f16_whole_word(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", text.whole_word(F.col("text"), "thon").alias("found"), text.whole_word(F.col("text"), "the", hyphen=True).alias("hyphen")), "doc_id", "found", "hyphen")


def f18_paths(spark, sf_dir):
    p = F.col("path")
    return _out(Corpus(spark, sf_dir).files().select("file_id", paths.base(p).alias("base"), paths.directory(p).alias("dir"), paths.extension(p).alias("ext"), paths.depth(p).alias("depth"), paths.language(p).alias("language")), "file_id", "base", "dir", "ext", "depth", "language")


def f19_comments(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", F.sha2(text.stripped_comments(F.col("text"), ("The", "In")), 256).alias("digest")), "doc_id", "digest")


def f20_split_long(spark, sf_dir):
    pieces = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.split_long(F.col("text"))).alias("pos", "piece"))
    return _out(pieces.select("doc_id", "pos", F.char_length("piece").alias("n")), "doc_id", "pos", "n")


def f24_image(spark, sf_dir):
    o = Corpus(spark, sf_dir).table("orders")
    ref = F.concat(F.lit("reg.example.org:5000/a/img"), (F.col("o_custkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(":v"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("@sha256:"), F.col("o_orderkey").cast("string"))).otherwise(""))
    return _out(o.select("o_orderkey", text.image_name(ref).alias("image"), text.image_version(ref).alias("version")), "o_orderkey", "image", "version")


def f26_dates(spark, sf_dir):
    c = Corpus(spark, sf_dir).commits()
    return _out(c.select("sha", F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc3339"), text.short_sha(F.col("sha")).alias("short")), "sha", "rfc3339", "short")


def f28_l2(spark, sf_dir):
    e = Corpus(spark, sf_dir).table("embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return _out(e.crossJoin(F.broadcast(one)).select("vec_id", F.round(text.l2(F.col("embedding"), F.col("q")), 6).alias("distance")), "vec_id", "distance")


def f30_title(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(m.select("message_id", text.title_placeholder(F.col("question")).alias("title"), text.memory_text(F.concat(F.lit("# `"), "question")).alias("memory")), "message_id", "title", "memory")


def f42_json(spark, sf_dir):
    e = Corpus(spark, sf_dir).table("events")
    return _out(e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object(F.concat("props", F.lit("x")), "$.none").isNull().alias("absent")), "event_id", "k", "absent")


def f44_followups(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages()
    return _out(m.select("message_id", F.array_join(text.followups(F.concat(F.lit("- "), F.regexp_replace("question", r"\. ", "\n2. "))), "|").alias("questions")), "message_id", "questions")


def t08_version_sort(spark, sf_dir):
    p = Corpus(spark, sf_dir).table("orders").select(F.concat(F.lit("v"), (F.col("o_orderkey") % 40).cast("string"), F.lit("."), F.lpad((F.col("o_custkey") % 13).cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 5 == 0, "-rc").otherwise("")).alias("name")).distinct()
    return _out(running.ranked(p, [text.version_key(F.col("name")), F.col("name")]), "name", "rank")


_NAMES = ["src/app/main.go", "src/app/main_test.go", "test/x.py", "docs/guide.md", "README", "license.go", "a/node_modules/x.js", "vendors.go", "dist/a.js", "web/i18n/de.json", "web/i18n/index.ts", "a.spec.ts", "openapi.spec.yaml", "x/schema.generated.ts", "RegeneratedTokenEvent.kt", "package-lock.json", "data/rows.csv", "conf/big.json", "pom.xml", "svc.xsd", "Cargo.lock", "a/b.min.js", "src/Tests.java", "proto/x.pb.go", "docs/conf.py", ".env.prod", "config/tsconfig.base.json", "a/build/x", "notes.txt", "readme.txt"]


def _named(spark, sf_dir):
    """Paths of every kind over the documents' bodies."""
    names = F.array(*map(F.lit, _NAMES))
    return _docs(spark, sf_dir).select("doc_id", F.concat((F.floor(F.col("doc_id") / len(_NAMES))).cast("string"), F.lit("/"), F.element_at(names, (F.col("doc_id") % len(_NAMES) + 1).cast("int"))).alias("path"), "text")


def p06_path_class(spark, sf_dir):
    p = F.col("path")
    return _out(_named(spark, sf_dir).select("doc_id", "path", paths.is_test(p).alias("test"), paths.is_doc(p).alias("doc"), paths.kind_rank(p).alias("kind")), "doc_id", "path", "test", "doc", "kind")


def p09_glob(spark, sf_dir):
    return _out(_named(spark, sf_dir).where(paths.matches_glob(F.col("path"), "**/docs/**", "*/src/*/main*.go", "1?/README")).select("doc_id", "path"), "doc_id", "path")


def p10_select_files(spark, sf_dir):
    p = F.col("path")
    size = F.octet_length("text").cast("long")
    return _out(_named(spark, sf_dir).select("doc_id", "path", F.coalesce(paths.skip_by_size(p, size, ("3/**",)), F.lit("")).alias("by_size")), "doc_id", "path", "by_size")


def p12_select_bodies(spark, sf_dir):
    return _out(_named(spark, sf_dir).select("doc_id", paths.skip_by_body(F.col("path"), F.col("text"), ("3/**",)).alias("skip_reason")), "doc_id", "skip_reason")


def p13_secret_scan(spark, sf_dir):
    return _out(_docs(spark, sf_dir).select("doc_id", paths.secret_shape(F.col("text")).alias("shape")).where("shape IS NOT NULL"), "doc_id", "shape")


def p17_superseded(spark, sf_dir):
    """Version directories: only the newest of each parent stays."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("parent"), F.concat(F.lit("v"), (F.col("doc_id") % 12).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string")).alias("version"))
    newest = d.select("parent", "version").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy(text.version_key(F.col("version")).desc(), F.desc("version"))))
    return _out(d.join(newest.where("nth = 1").select("parent", "version"), ["parent", "version"], "left_anti"), "doc_id", "parent", "version")


def e01_chunk(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    anchors = c.symbols().where("line % 4 = 0").groupBy("file_id").agg(F.array_sort(F.collect_list("line")).alias("anchors"))
    rows = c.chunks().select("file_id", "raw_text").join(anchors, "file_id", "left")
    made = extract.over(rows, "file_id", ("raw_text", "anchors"), "file_id bigint, ordinal int, first int, last int, body string", extract.chunks)
    return _out(made.withColumn("cost", text.token_estimate(F.col("body"))), "file_id", "ordinal", "first", "last", "cost")


def e02_tokens(spark, sf_dir):
    p = Corpus(spark, sf_dir).table("pages").select("page_id", F.lit("x.html").alias("path"), F.regexp_replace("html", "(<li>)", "\n$1").alias("html"))
    return _out(extract.over(p, "page_id", ("path", "html"), "page_id bigint, kind string, value string, line int", extract.tokens), "page_id", "kind", "value", "line")


def e06_links(spark, sf_dir):
    p = Corpus(spark, sf_dir).table("pages")
    return _out(p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1)))).alias("value")), "page_id", "value")


def s19_symbols(spark, sf_dir):
    """Definitions in generated sources: each document's first words as names."""
    d = _docs(spark, sf_dir).select("doc_id", F.lit("py").alias("lang"), F.concat(F.lit("class "), F.regexp_extract("text", r"([A-Za-z]+)", 1), F.lit(":\n    def m_"), F.col("doc_id").cast("string"), F.lit("(self):\n        pass\n")).alias("source"))
    return _out(extract.over(d, "doc_id", ("lang", "source"), "doc_id bigint, name string, kind string, line int", extract.symbols), "doc_id", "name", "kind", "line")


def f21_redact(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.lit("app.properties").alias("path"), F.concat(F.lit("db.password="), F.col("source"), F.lit("\nserver.port=80"), F.lit("\nmaps.key = "), F.col("lang"), F.lit("\n# note\nurl=https://u:p@host/x\nname=${A_NAME}")).alias("body"))
    return _out(extract.over(d, "doc_id", ("path", "body"), "doc_id bigint, body string", lambda p, b: [(redaction.redact(p, b),)]), "doc_id", "body")


#: a file's name, and a line of it around a value, by number: as it is and as it is redacted
_SHAPED = [
    ("c.json", '{"db":{"user":"a","password":"', '"}}', True), ("v.yaml", "db: {user: a, password: ", "}", True), ("s.xml", "<password>", "</password>", True), ("b.xml", '<property name="password" value="', '"/>', True),
    ("b.xml", '<property name="url" value="', '"/>', False), ("d.yaml", "- name: DB_PASSWORD" + chr(10) + "  value: ", "", True), ("n.conf", "header X ENC(", ")", None), ("R.md", "password=", "", False), (".npmrc", "//r.example.org/:_authToken=", "", True), ("a.properties", "db.password ", "", True),
]


def f21_redact_shapes(spark, sf_dir):
    """Every document's source as a value in ten shapes of configuration files."""
    shapes = spark.createDataFrame([(i, p, a, b) for i, (p, a, b, _) in enumerate(_SHAPED)], "shape int, path string, before string, after string")
    d = _docs(spark, sf_dir).select("doc_id", "source").join(F.broadcast(shapes)).select("doc_id", "shape", "path", F.concat("before", "source", "after").alias("body"))
    made = extract.over(d.select(F.struct("doc_id", "shape").alias("key"), "path", "body"), "key", ("path", "body"), "key struct<doc_id:bigint,shape:int>, body string", lambda p, b: [(redaction.redact(p, b),)])
    return _out(made.select("key.doc_id", "key.shape", "body"), "doc_id", "shape", "body")


def f35_renumber(spark, sf_dir):
    m = Corpus(spark, sf_dir).messages().where("answer IS NOT NULL").select("message_id", F.concat("answer", F.lit(" [7] and [3, 7]\n```\n[3]\n```\n[99] [1]")).alias("answer"))
    made = extract.over(m, "message_id", ("answer",), "message_id bigint, tail string, used string", lambda a: [(extract.renumber(a, 9)[0][-34:], ",".join(map(str, extract.renumber(a, 9)[1])))])
    return _out(made, "message_id", "tail", "used")


QUERIES = [f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] in "efpst" and n[1:3].isdigit()]

_N = len(_NAMES)
_NAMED = f"n AS (SELECT doc_id, CAST(doc_id // {_N} AS VARCHAR) || '/' || ({_NAMES!r})[doc_id % {_N} + 1] AS path, text FROM documents)"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = rf"lower(regexp_extract({_BASE}, '\.([^.]*)$', 1))"
_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_MANIFEST = rf"({_BASE} IN ({_IN(paths.MANIFESTS)}) OR regexp_matches({_BASE}, '(?i)^(?:tsconfig|appsettings\.).*\.json$|\.bpmn20\.xml$|\.bpmn\.xml$'))"
_BY_PATH = f"CASE WHEN starts_with(path, '3/') THEN 'excluded' WHEN regexp_matches(path, '{paths.VENDORED_PATTERN}') THEN 'vendored' WHEN regexp_matches(path, '{paths.GENERATED_PATTERN}') THEN 'generated' END"
_CONFIG = rf"({_EXT} IN ({_IN(paths.CONFIG_EXTENSIONS)}) OR regexp_matches({_BASE}, '(?i)^(?:\.env(?:\..*)?|\.npmrc)$'))"


def _by_data(size: str) -> str:
    return f"CASE WHEN {_EXT} IN ({_IN(paths.DATA_EXTENSIONS)}) OR ({_EXT} IN ({_IN(paths.SCHEMA_EXTENSIONS)}) AND {size} > {paths.MOST_SCHEMA_BYTES}) OR ({_EXT} IN ({_IN(paths.SIZED_DATA_EXTENSIONS)}) AND {size} > {paths.MOST_DATA_BYTES} AND NOT {_MANIFEST}) THEN 'data' END"


_SHAPES = " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{p}'" for p in paths.SECRET_SHAPES)
SQL = {
    "f01_tokens": f"SELECT doc_id, len({_TOKENS})::BIGINT AS n, sha256(array_to_string({_TOKENS}, ' ')) AS digest FROM documents",
    "f02_camel_words": sql(r"SELECT file_id, line, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name || name || '_x9Y', '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda t: length(t) > 1), ' ') AS words FROM symbols", "symbols"),
    "f10_excerpt": "SELECT doc_id, CASE WHEN length(w) <= 200 THEN w ELSE rtrim(CASE WHEN instr(h, chr(10)) > 0 AND 201 - instr(reverse(h), chr(10)) > 100 THEN left(h, 200 - instr(reverse(h), chr(10))) ELSE h END) || '…' END AS excerpt FROM (SELECT doc_id, trim(text) AS w, left(trim(text), 200) AS h FROM documents)",
    "f30_title": sql(r"SELECT message_id, CASE WHEN length(one) <= 48 THEN one ELSE rtrim(left(one, 48)) || '…' END AS title, left(trim(regexp_replace(replace(replace('# `' || question, '`', ''), '#', ''), '[ \t\r\n\f]+', ' ', 'g')), 200) AS memory FROM (SELECT message_id, question, trim(regexp_replace(question, '[ \t\r\n\f]+', ' ', 'g')) AS one FROM messages)", "messages"),
    "f44_followups": sql(r"l AS (SELECT message_id, unnest(string_split('- ' || replace(question, '. ', chr(10) || '2. '), chr(10))) AS x, unnest(range(1, len(string_split('- ' || replace(question, '. ', chr(10) || '2. '), chr(10))) + 1)) AS i FROM messages), t AS (SELECT message_id, trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', '')) AS x, i FROM l), u AS (SELECT message_id, x, min(i) AS i FROM t WHERE x <> '' AND length(x) <= 200 GROUP BY message_id, x QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY min(i)) <= 3), a AS (SELECT message_id, string_agg(x, '|' ORDER BY i) AS q FROM u GROUP BY 1) SELECT m.message_id, coalesce(q, '') AS questions FROM messages m LEFT JOIN a USING (message_id)", "messages"),
    "f03_identifiers": r"SELECT doc_id, len(i)::BIGINT AS n, sha256(array_to_string(list_sort(i), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda t: strlen(t) > 2)) AS i FROM documents)",
    "f04_fold": r"SELECT doc_id, sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS digest FROM documents",
    "f05_content_words": f"SELECT doc_id, len(list_filter({_TOKENS}, lambda t: t NOT IN ({_STOP})))::BIGINT AS n FROM documents",
    "f08_contains": f"SELECT doc_id, lang FROM documents WHERE contains(translate(text, '{text.UPPER}', '{text.LOWER}'), 'therha') OR contains(text, 'éle') OR contains(text, 'Éle')",
    "f09_token_estimate": "SELECT doc_id, (length(text) + 3) // 4 AS cost FROM documents",
    "f11_hash": sql("SELECT file_id, sha256(repo || chr(29) || path || chr(29) || sha) AS hash FROM files", "files"),
    "f12_enriched": sql("SELECT chunk_id, sha256(repo || '/' || path || chr(10) || raw_text) AS digest FROM chunks", "chunks"),
    "f13_repo_fold": r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN '''s' ELSE 's' END), '''s$', ''), 's$', '') AS name FROM part",
    "f14_one_edit": sql("n AS (SELECT DISTINCT lower(name) AS name FROM symbols WHERE length(name) >= 4) SELECT a.name, b.name AS other FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 1 WHERE levenshtein(a.name, b.name) <= 1", "symbols"),
    "f16_whole_word": r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])thon($|[^\p{L}\p{N}_])') AS found, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_-])the($|[^\p{L}\p{N}_-])') AS hyphen FROM documents",
    "f18_paths": sql(f"SELECT file_id, {_BASE} AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, {_EXT} AS ext, (len(string_split(path, '/')) - 1)::BIGINT AS depth, {_EXT} AS language FROM files", "files"),
    "f19_comments": r"SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:The|In)')), chr(10))) AS digest FROM documents",
    "f20_split_long": "SELECT doc_id, pos, least(3200, length(text) - pos * 3200) AS n FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 3199) // 3200)) AS pos FROM documents)",
    "f24_image": "SELECT o_orderkey, 'reg.example.org:5000/a/img' || CAST(o_custkey % 9 AS VARCHAR) AS image, CASE o_orderkey % 3 WHEN 0 THEN 'v' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'sha256:' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS version FROM orders",
    "f26_dates": sql("SELECT sha, strftime(committed_at, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, left(sha, 7) AS short FROM commits", "commits"),
    "f28_l2": "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0",
    "f35_renumber": sql("SELECT message_id, right('x [1] and [2, 1]' || chr(10) || '```' || chr(10) || '[3]' || chr(10) || '```' || chr(10) || '[99] [3]', 34) AS tail, '7,3,1' AS used FROM messages WHERE answer IS NOT NULL", "messages"),
    "f21_redact": "SELECT doc_id, 'db.password=<redacted>' || chr(10) || 'server.port=80' || chr(10) || 'maps.key = <redacted>' || chr(10) || '# note' || chr(10) || 'url=https://<redacted>@host/x' || chr(10) || 'name=${A_NAME}' AS body FROM documents",
    "f21_redact_shapes": " UNION ALL ".join(f"SELECT doc_id, {i} AS shape, " + ("'header X <redacted>'" if hit is None else " || ".join(["'" + x.replace("'", "''").replace(chr(10), "' || chr(10) || '") + "'" for x in (a,)] + ["'<redacted>'" if hit else "source"] + ["'" + b + "'"])) + " AS body FROM documents" for i, (_, a, b, hit) in enumerate(_SHAPED)),
    "s19_symbols": "SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS name, 'class' AS kind, 1 AS line FROM documents WHERE regexp_matches(text, '[A-Za-z]') UNION ALL SELECT doc_id, 'm_' || CAST(doc_id AS VARCHAR), 'func', 2 FROM documents",
    "e02_tokens": "SELECT page_id, 'link' AS kind, value, line FROM (SELECT page_id, regexp_extract_all(line_text, 'href=\"(/[^\"]*)\"', 1) AS v, n AS line FROM (SELECT page_id, unnest(string_split(replace(html, '<li>', chr(10) || '<li>'), chr(10))) AS line_text, unnest(range(1, len(string_split(replace(html, '<li>', chr(10) || '<li>'), chr(10))) + 1)) AS n FROM pages)), unnest(v) AS t(value) QUALIFY row_number() OVER (PARTITION BY page_id, value ORDER BY line) = 1",
    "f42_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS absent FROM events",
    "p06_path_class": f"WITH {_NAMED} SELECT doc_id, path, regexp_matches(path, '{paths.TEST_PATTERN}') AS test, regexp_matches(path, '{paths.DOC_PATTERN}') AS doc, CASE WHEN regexp_matches(path, '{paths.DOC_PATTERN}') THEN 2 WHEN regexp_matches(path, '{paths.TEST_PATTERN}') THEN 1 ELSE 0 END AS kind FROM n",
    "p09_glob": f"WITH {_NAMED} SELECT doc_id, path FROM n WHERE regexp_matches(path, '^([^/]+/)*docs/.*$') OR regexp_matches(path, '^[^/]*/src/[^/]*/main[^/]*\\.go$') OR regexp_matches(path, '^1[^/]/README$')",
    "p10_select_files": f"WITH {_NAMED} SELECT doc_id, path, coalesce(CASE WHEN strlen(text) > {paths.MOST_BYTES} THEN 'too_large' ELSE coalesce({_BY_PATH}, {_by_data(f'(CASE WHEN {_CONFIG} THEN 0 ELSE strlen(text) END)')}) END, '') AS by_size FROM n",
    "p12_select_bodies": f"WITH {_NAMED} SELECT doc_id, CASE WHEN strlen(text) > {paths.MOST_BYTES} THEN 'too_large' WHEN {' OR '.join(f'regexp_matches(text, {chr(39)}{p}{chr(39)})' for p in paths.SECRET_SHAPES)} THEN 'secret' ELSE coalesce({_BY_PATH}, {_by_data('strlen(text)')}, CASE WHEN regexp_matches(left(text, 2048), '{paths.GENERATED_MARK}') THEN 'generated' END, '') END AS skip_reason FROM n",
    "p13_secret_scan": f"SELECT doc_id, shape FROM (SELECT doc_id, CASE {_SHAPES.replace('{0}', 'text')} END AS shape FROM documents) WHERE shape IS NOT NULL",
    "p17_superseded": "WITH d AS (SELECT doc_id, source AS parent, doc_id % 12 AS a, doc_id % 5 AS b FROM documents), m AS (SELECT parent, max(a * 100 + b) AS k FROM d GROUP BY 1) SELECT doc_id, parent, 'v' || CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) AS version FROM d JOIN m USING (parent) WHERE a * 100 + b < k",
    "t08_version_sort": "WITH p AS (SELECT DISTINCT o_orderkey % 40 AS a, o_custkey % 13 AS b, o_orderkey % 5 = 0 AS rc FROM orders), n AS (SELECT DISTINCT a, b, rc, 'v' || CAST(a AS VARCHAR) || '.' || lpad(CAST(b AS VARCHAR), 2, '0') || CASE WHEN rc THEN '-rc' ELSE '' END AS name FROM p) SELECT name, row_number() OVER (ORDER BY a, b, rc) AS rank FROM n",
    "e06_links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS value FROM pages",
}
