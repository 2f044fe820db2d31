"""Rules that SQL does not hold: tiers, terms, chunks, redaction, renumbering, clustering, admission, the feed."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import extract, paths, redaction, text
from tessera.operators import budget, fusion, gather, history, lanes, tables, walks
from tessera.sources import inputs
from tessera.streaming import feed


def test_tiers():
    names = lambda q: [t[0] for t in text.tiers(q)]
    assert names("how is the") == ["strict"] and names("") == []
    assert names("parser cache") == ["strict", "prefix", "any"]
    assert names("how does the parser work") == ["strict", "content", "prefix", "any"]
    assert names("parser") == ["strict", "prefix"]
    assert len(text.tiers(" ".join(f"w{i}" for i in range(50)))[0][1]) == 32


def test_substring_terms():
    terms = text.substring_terms("where is token refresh handled", ("Token_Store", "tokenstore", "a"))
    assert terms[:2] == ["token_store", "tokenstore"] and "tokenrefresh" in terms and "token_refresh" in terms
    assert len(terms) <= 12 and all(len(t) >= 8 for t in terms) and len(set(terms)) == len(terms)
    assert text.substring_terms("is it on") == []
    assert text.search_texts("q", " ", "q", "c") == ["q", "c"]


def test_globs():
    import re

    fits = lambda g, p: bool(re.search(paths.glob_pattern(g), p))
    assert fits("docs/plans/**", "docs/plans/x/y.md") and not fits("docs/plans/**", "a/docs/plans/x.md") and not fits("docs/plans/**", "docs/plans-notes.md")
    assert fits("**/x.go", "x.go") and fits("**/x.go", "a/b/x.go") and not fits("*/x.go", "a/b/x.go") and fits("a/?.go", "a/b.go")


def test_windows_cover_and_advance():
    rng = random.Random(0)
    for _ in range(200):
        costs = [rng.randint(1, 300) for _ in range(rng.randint(1, 60))]
        w = budget.line_windows(costs)
        assert w[0][0] == 1 and w[-1][1] == len(costs) and all(a[0] < b[0] <= a[1] + 1 for a, b in zip(w, w[1:]))
        for a, b in w:
            assert b == a or sum(costs[a - 1 : b]) <= 600
        for (a, b), (c, _) in zip(w, w[1:]):
            assert c == a + 1 or sum(costs[c - 1 : b]) >= 75


def test_chunks():
    body = "head\n// about f\nfunc f() {\n}\nfunc g() {\n}\n"
    assert [(o, a, b) for o, a, b, _ in extract.chunks(body, [3, 5])] == [(0, 1, 1), (1, 2, 4), (2, 5, 7)]
    assert [o for o, *_ in extract.chunks("x" * 10_000)] == [0, 1, 2, 3] and list(extract.chunks(" \n")) == [] == list(extract.chunks(None))
    assert len(list(extract.chunks(body, [5, 3]))) == 1


def test_tokens():
    java = '@RequestMapping("/api")\npublic class C {\n  @GetMapping("/x")\n  void x() {}\n  String s = "${app.name}"; // queue = "orders.in"\n  call("/other/route"); img("/a.png");\n'
    assert set(extract.tokens("C.java", java)) == {("route", "/api/x", 4), ("property", "app.name", 5), ("destination", "orders.in", 5), ("route", "/other/route", 6)}
    assert list(extract.tokens("a.yaml", "image: reg/x:1\nimages:\n- name: y\n  newName: reg/y\n  newTag: v2\n")) == [("image", "reg/x:1", 1), ("image", "reg/y:v2", 5)]
    assert list(extract.tokens("a.properties", "# c=1\na.b=2\na.b=3\n")) == [("property", "a.b", 2)]


def test_redaction():
    said = redaction.redact("a.yaml", "password: hunter2\nname: DB_PASSWORD\nvalue: x1\nmaxKeys: 5\nkey: k\nmap.key: \"k2\",\ntoken: |\n  line\n  more\nplain: ${A}\nsecret:\nurl: http://u:p@h/\nv: eyJa.b.c\nw: eyJhbGciOiJIUzI1NiJ9abcd.b.c")
    assert said.split("\n") == ["password: <redacted>", "name: DB_PASSWORD", "value: <redacted>", "maxKeys: 5", "key: k", 'map.key: "<redacted>",', "token: <redacted>", "plain: ${A}", "secret:", "url: http://<redacted>@h/", "v: eyJa.b.c", "w: <redacted>"]
    assert redaction.redact("x", None) is None


@pytest.mark.parametrize(
    ("path", "line", "want"),
    [
        ("a.properties", "db.url=ENC(abc)", "db.url=#"),
        ("a.properties", "db.password=${DB_PASSWORD}", "db.password=${DB_PASSWORD}"),
        ("a.properties", "mail.password=", "mail.password="),
        ("a.properties", "esb.consumer-key=1f", "esb.consumer-key=#"),
        ("a.properties", "map.producer.key-serializer=org.example.S", "map.producer.key-serializer=org.example.S"),
        ("a.properties", "a.keystorePath=/certs/s.jks", "a.keystorePath=/certs/s.jks"),
        ("a.properties", 'sasl.login=Module required username="u" password="p";', "sasl.login=#"),
        ("a.properties", "# password=no", "# password=no"),
        ("a.properties", "x.hmac=" + "0a" * 16, "x.hmac=#"),
        ("a.properties", "x.cron=0 0 * ? * *", "x.cron=0 0 * ? * *"),
        ("a.properties", "db.url=jdbc:x://u:p@h:1/d", "db.url=jdbc:x://#@h:1/d"),
        ("a.properties", "a.api.pass=z", "a.api.pass=#"),
        ("a.properties", "proxy.bypass=h", "proxy.bypass=h"),
        ("a.properties", "a.mapsKey=z", "a.mapsKey=#"),
        ("a.properties", "db.password hunter2", "db.password #"),
        ("a.properties", "db.host localhost", "db.host localhost"),
        ("a.properties", "password=x\r", "password=#\r"),
        ("k.yaml", "    newTag: " + "3f" * 20, "    newTag: " + "3f" * 20),
        ("k.yaml", "  - https://u:p@h/x", "  - https://#@h/x"),
        ("k.yaml", "  - task-scheduler.yaml", "  - task-scheduler.yaml"),
        ("k.yaml", "        key: app.properties", "        key: app.properties"),
        ("k.yaml", "  - apiKey: z", "  - apiKey: #"),
        ("k.yaml", "'password': z", "'password': #"),
        ("k.yaml", "  authorization: Basic YWJjOmRlZg==", "  authorization: #"),
        ("k.yaml", "db: {user: a, password: z}", "db: {user: a, password: #}"),
        ("k.yaml", 'args: "--user=a, token: z"', 'args: "--user=a, token: z"'),
        (".env.prod", "export SMTP_PASSWORD=z", "export SMTP_PASSWORD=#"),
        (".npmrc", "//r.example.org/:_authToken=z", "//r.example.org/:_authToken=#"),
        (".npmrc", "registry=https://r.example.org/", "registry=https://r.example.org/"),
        ("n.conf", '  proxy_set_header Authorization "Basic YWJjOmRlZjEyMw==";', '  proxy_set_header Authorization "#";'),
        ("n.conf", "# Basic settings for all", "# Basic settings for all"),
        ("c.json", '{"db":{"user":"a","password":"z"}}', '{"db":{"user":"a","password":"#"}}'),
        ("c.json", '  "password": "z",', '  "password": "#",'),
        ("c.json", '  "user": "a", "apiKey": "z1",', '  "user": "a", "apiKey": "#",'),
        ("c.json", '"note": "' + "0a" * 16 + '", "password": "x"', '"note": "#", "password": "#"'),
        ("s.xml", "  <password>z</password>", "  <password>#</password>"),
        ("c.json", '{"password": "ab\\"cd,ef", "b": 1}', '{"password": "#", "b": 1}'),
        ("s.xml", '<x password="two words" a="b"/>', '<x password="#" a="b"/>'),
        ("c.json", '{"password": "${A}", "token": ""}', '{"password": "${A}", "token": ""}'),
        ("s.xml", '<property name="password" value="z"/>', '<property name="password" value="#"/>'),
        ("s.xml", '<property name="url" value="z"/>', '<property name="url" value="z"/>'),
        ("s.xml", '<bean id="d" password="z" user="u"/>', '<bean id="d" password="#" user="u"/>'),
        ("w.config", '<add key="ApiToken" value="z" />', '<add key="ApiToken" value="#" />'),
        ("p.tfvars", 'db_password = "z"', 'db_password = "#"'),
        ("M.java", 'String password = "z";', 'String password = "z";'),
        ("R.md", "password=z", "password=z"),
        ("d.yaml", "- name: DB_PASSWORD\n  value: z\n- name: DB_HOST\n  value: h", "- name: DB_PASSWORD\n  value: #\n- name: DB_HOST\n  value: h"),
        ("d.yaml", "- name: DB_PASSWORD\n  valueFrom:\n    ref:\n      name: db\n      key: password", "- name: DB_PASSWORD\n  valueFrom:\n    ref:\n      name: db\n      key: password"),
        ("d.yaml", "privateKey: |\n  one\n\n  two\nnote: >-\n  kept", "privateKey: #\nnote: >-\n  kept"),
    ],
)
def test_redaction_of_every_shape(path, line, want):
    marked = redaction.redact(path, line)
    assert marked == (want if want == line else want.replace("#", redaction.MARKER))


def test_renumbering_in_pieces_equals_the_whole():
    rng, body = random.Random(1), "a [7] b [3, 7]\n```\n[3]\n```\n[99] [1]\nend [2]"
    whole, order = extract.renumber(body, 9)
    assert order == [7, 3, 1, 2] and whole == "a [1] b [2, 1]\n```\n[3]\n```\n[99] [3]\nend [4]"
    for _ in range(50):
        r, out, at = extract.Renumberer(9), "", 0
        while at < len(body):
            n = rng.randint(1, 9)
            out += r.feed(body[at : at + n])
            at += n
        assert out + r.feed("", last=True) == whole
    assert extract.strip_markers("a [1].\n```\n[1]\n```") == "a.\n```\n[1]\n```" and extract.swiss("Straße `ß` a_ß") == "Strasse `ß` a_ß"


def test_schema_symbols_and_processes():
    assert list(extract.schema_symbols('<s>\n<element name="a"/>\n<complexType name="b"/>\n</s>')) == [("a", "element", 2), ("b", "complexType", 3)]
    with pytest.raises(ValueError):
        list(extract.schema_symbols("<s>"))
    model = '<d><process id="p"><startEvent id="s" name="go"/><sequenceFlow id="f" sourceRef="s" targetRef="t"/><callActivity id="t" calledElement="q"/></process></d>'
    assert list(extract.process_model(model)) == [("p", "startEvent", "s", "go", ""), ("p", "flow", "f", "s", "t"), ("p", "callActivity", "t", "", "q")]
    assert list(extract.process_model("<broken")) == []


def test_clustering(spark):
    rows = [("r", f"a/b/f{i}", None, 3) for i in range(2)] + [("r", f"a/c/f{i}", None, 10) for i in range(3)] + [("r", "top", None, 1), ("r", "u/x", "u", 2), ("r", "a/d/g", None, 1)]
    got = {r.path: r.module for r in walks.cluster(spark.createDataFrame(rows, "repo string, path string, unit string, chunks long"), 8, 20).collect()}
    assert got == {"a/b/f0": ".", "a/b/f1": ".", "a/c/f0": "a/c", "a/c/f1": "a/c", "a/c/f2": "a/c", "top": ".", "u/x": "u", "a/d/g": "."}


def test_skipping_and_prefix_budgets(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 9, 2, 4, 1])], "g long, id long, cost long")
    assert sorted(r.id for r in budget.skipping_budget(rows, "cost", 9, ["id"], "id", "g").collect()) == [0, 2, 4]
    assert sorted(r.id for r in budget.prefix_budget(rows, "cost", 15, ["id"]).collect()) == [0, 1]


def test_fusion_orders_ties_by_address(spark):
    rows = [("b", "x", 1, 0, 1, r, l) for r, l in ((0, "s"), (3, "k"))] + [("a", "y", 1, 0, 2, r, l) for r, l in ((0, "k"), (3, "s"))] + [("a", "t_test.go", 1, 0, 3, 1, "s")]
    df = spark.createDataFrame(rows, "repo string, path string, start_line int, ordinal int, chunk_id long, rank int, lane string")
    lane = [fusion.lane(df.where(F.col("lane") == n), n, w, i) for i, (n, w) in enumerate((("s", 1.0), ("k", 1.0)))]
    got = fusion.ordered(fusion.fuse(lane[0].unionByName(lane[1])), 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3] and got[0].lanes == "s,k"
    muted = fusion.fuse(lane[0].unionByName(fusion.lane(df.where("lane = 'k'"), "k", 0.0, 1))).collect()
    assert all(r.lanes == "s" for r in muted)


def test_restriction_is_inside_top_k_and_the_cut_outside(spark):
    v = spark.createDataFrame([(i, "r" if i % 2 else "q", f"p{i}", 1, 0, [float(i), 0.0]) for i in range(8)], "chunk_id long, repo string, path string, start_line int, ordinal int, embedding array<double>")
    q = spark.createDataFrame([(99, [0.0, 0.0])], "query_id long, query array<double>")
    assert sorted(r.chunk_id for r in lanes.knn(v.where("repo = 'r'"), q, 2, 0).collect()) == [1, 3]
    assert sorted(r.chunk_id for r in lanes.knn(v, q, 4, 2.0).collect()) == [0, 1]


def test_gather_admits_hits_and_stops_references(spark):
    chunks = spark.createDataFrame([(1, 1, "r", "a.go", "Alpha uses Beta Gamma"), (2, 2, "r", "b.go", "x" * 400), (3, 3, "r", "c.go", "y"), (4, 4, "q", "d.go", "z")], "chunk_id long, file_id long, repo string, path string, raw_text string")
    symbols = spark.createDataFrame([(2, "r", "b.go", "Beta", 1), (3, "r", "c.go", "Gamma", 1)], "file_id long, repo string, path string, name string, line int")
    hits = chunks.where("chunk_id = 1").select("chunk_id", "file_id", "repo", "path", F.lit(1).alias("pos"))
    cross = spark.createDataFrame([(1, 4, "q", "d.go")], "from_id long, file_id long, repo string, path string")
    got = {r.chunk_id: r.reason for r in gather.gather(hits, chunks, symbols, cross, 50).collect()}
    assert got == {1: "hit", 4: "shares a token"}
    got = {r.chunk_id for r in gather.gather(hits, chunks, symbols, cross, 500).collect()}
    assert got == {1, 2, 3, 4}


def test_memory_limit_is_an_error(spark):
    held = spark.createDataFrame([("u", f"m{i}") for i in range(40)], "user string, text string")
    assert tables.memory_add(held, spark.createDataFrame([("u", "M3")], "user string, text string")).count() == 40
    with pytest.raises(Exception, match="too many memories"):
        tables.memory_add(held, spark.createDataFrame([("u", "new")], "user string, text string")).collect()


def test_ancestry(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b")], "sha string, parent string")
    got = {(r.tip, r.sha): r.distance for r in history.ancestry(parents, spark.createDataFrame([("c",), ("d",)], "sha string")).collect()}
    assert got == {("c", "c"): 0, ("c", "b"): 1, ("c", "a"): 2, ("d", "d"): 0, ("d", "b"): 1, ("d", "a"): 2}


def test_typed_search_and_snippets(spark):
    rows = spark.createDataFrame([(1, "Über den Café-Häusern: the affable case"), (2, "The cafe"), (3, None), (4, "x" * 90 + " cafeteria " + "y" * 90)], "id long, body string")
    found = {r.id: (r.m, r.s) for r in rows.select("id", text.matches_typed(F.col("body"), 'CAFÉ "aff').alias("m"), text.snippet(F.col("body"), "cafe").alias("s")).collect()}
    assert [found[i][0] for i in (1, 2, 3)] == [True, False, False]
    assert found[2][1] == "The [cafe]" and found[4][1] == "x" * 39 + " [cafeteria] " + "y" * 39 and not found[3][1]


def test_sources(spark):
    files = spark.createDataFrame([("r", "go.mod", "module ex.org/a\n\nrequire (\n\tex.org/b/c v1.2.0\n)\n"), ("r", "w/package.json", '{"name": "@x/a", "dependencies": {"@x/b": "1"}}'), ("r", "m/pom.xml", "<project><parent><groupId>g</groupId><artifactId>p</artifactId></parent><artifactId>svc</artifactId></project>"), ("r", "settings.gradle", "include ':a:b', ':c'\n")], "repo string, path string, body string")
    assert {(r.coordinate, r.direction) for r in inputs.go_modules(files).union(inputs.npm_packages(files)).collect()} == {("ex.org/a", "publishes"), ("ex.org/b/c", "requires"), ("@x/a", "publishes"), ("@x/b", "requires")}
    assert [(r.key, r.artifact, r.group, r.kind) for r in inputs.maven_units(files).collect()] == [("m", "svc", "g", "library")]
    assert sorted(r.key for r in inputs.gradle_includes(files).collect()) == ["a/b", "c"]
    log = spark.createDataFrame([("r", "abc\u00002024-01-02T03:04:05Z\u0000me\u0000Fix\u0000Why\n\nSigned-off-by: me <m@x>\n")], "repo string, value string")
    assert [(r.sha, r.subject, r.body.strip()) for r in inputs.git_log(log).collect()] == [("abc", "Fix", "Why")]
    specs = inputs.repository_list(spark, '{"projects": [{"name": "p", "repositories": [{"name": "a", "uses": ["l"]}]}], "libraries": [{"name": "l"}]}')
    assert {(r.name, r.project, r.library) for r in specs.collect()} == {("a", "p", False), ("l", "l", True)}
    with pytest.raises(ValueError):
        inputs.repository_list(spark, '{"libraries": [{"name": "a b"}]}')
