"""Queries over made tables that the provided ones are too small or too plain for, against their SQL."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import extract
from tessera.operators import edges
from tessera.streaming import answers


def same_as_sql(spark, tmp_path, name, **tables):
    """The number of rows of a query that equals its SQL over the given tables."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, rows in tables.items():
        pq.write_table(rows, f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = plans.queries()[name](spark, str(tmp_path))
    want = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    rows = plain(got.select(*columns).collect())
    assert rows == plain(want.fetchall())
    return len(rows)


def test_thread_search_lists_all_that_match(spark, tmp_path):
    turns = [(i, t, role, text) for i in range(700) for t, role, text in ((0, "user", f"{'Thering' if i % 9 == 0 else 'about'} x{i}"), (1, "assistant", f"the thering {'of many words ' * (i % 40)}" if i % 3 else "no"))]
    conv, turn, role, text = map(list, zip(*turns))
    assert same_as_sql(spark, tmp_path, "r16_thread_search", conversations=pa.table({"conv_id": conv, "turn": turn, "role": role, "text": text})) > 400


def test_words_that_a_cut_stands_in_are_one_word(spark, tmp_path):
    long = " ".join(f"wörd{i}" for i in range(3000))  # one line of several pieces
    texts = [long[k:] for k in range(9)] + ["x" * 7000 + " y-" + "e\u0301" * 4000, "a\nb " + "z" * 3199 + "é " + "q" * 3300, "-" * 3199 + "ab-cd", "short one\n", "ab cd " * 1100]
    assert same_as_sql(spark, tmp_path, "s21_one_file", documents=pa.table({"doc_id": [i * 40 + 1 for i in range(len(texts))], "source": [f"src{i % 3}" for i in range(len(texts))], "text": texts})) > 9
    assert [len(w) for _, w in extract.chunk_words("v" * 7000 + " w")] == [7000, 0, 2]
    assert [(o, len(b)) for o, _, _, b in extract.chunks("v" * 7000 + " w")] == [(0, 3200), (1, 3200), (2, 602)]


def test_many_turns_share_a_state_and_keep_their_own_deadlines(spark, tmp_path):
    rng, at = random.Random(3), lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    open_, want = {}, []
    for landing in range(3):
        rows = [(rng.randrange(2500) if i else None, "s", landing * 100 + rng.randrange(90), i, 1, rng.choice([None, 2]), rng.random() < 0.2) for i in range(1500)]
        spark.createDataFrame([(t, s, at(m), *rest) for t, s, m, *rest in rows], answers.CALLS).write.mode("append").parquet(f"{tmp_path}/landed")
        answers.landed(spark, f"{tmp_path}/landed", answers.CALLS, lambda c: answers.metered(c, "10 minutes", "60 minutes"), f"{tmp_path}/out", f"{tmp_path}/offsets")
        for t, _, m, prompt, completion, cached, closes in rows:
            was = open_.get(t, (0, 0, 0, None, m, m, False))
            open_[t] = (was[0] + 1, was[1] + prompt, was[2] + completion, was[3] if cached is None else (was[3] or 0) + cached, min(was[4], m), max(was[5], m), was[6] or closes)
        mark = max(r[2] for r in rows) - 60
        for t, (*sums, first, last, closed) in list(open_.items()):
            if closed or last + 10 < mark:
                want.append((t, *sums, at(first), at(last), not closed))
                del open_[t]
    got = [tuple(r) for r in spark.read.schema(answers.METER).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[-1] for w in want) > 100 < len(open_)
    assert spark.read.format("statestore").load(f"{tmp_path}/offsets").count() <= answers.TOGETHER < len(open_)


def test_includes_make_their_pairs_last(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, rng.choice(["src1"] * 8 + ["src4", "src14"] + [f"s{rng.randrange(40)}"]), rng.choice(["de", "fr", "it", "en", "es"]), rng.choice(["a\nB c\nWord", "x\nCapital is here", "none"])) for i in range(0, 2400, 3)]
    ids, source, lang, text = map(list, zip(*docs))
    assert same_as_sql(spark, tmp_path, "j10_includes", documents=pa.table({"doc_id": ids, "source": source, "lang": lang, "text": text})) > 3000
    plan = plans.queries()["j10_includes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan[: plan.index("Exchange")]  # what is above the join is not moved


def test_includes_of_many_sites_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 4)
    rng = random.Random(9)
    repos = {f: f"r{rng.randrange(5)}" for f in range(160)}
    files = [(f, r, f"p{f}", rng.choice(["de", "fr", "it", "en"]) + f"_{rng.randrange(3)}") for f, r in repos.items()]
    sites = [(f, repos[f], rng.choice(["{lang}_", "{lang}_", "fr_", "xx_"]) + f"{rng.randrange(3)}", rng.randrange(50)) for f in repos for _ in range(rng.randrange(5))]
    libraries, languages = {"r0", "r1"}, ("de", "fr", "it", "en")
    want = {}
    for f, repo, value in sorted({s[:3] for s in sites}):
        line = min(s[3] for s in sites if s[:3] == (f, repo, value))
        ways = [(i, value.replace("{lang}", x)) for i, x in enumerate(languages)] if "{lang}" in value else [(0, value)]
        found = [(far_repo != repo, rank, far, far_repo) for rank, stem in ways for far, far_repo, _, s in files if s == stem and far != f and (far_repo == repo or far_repo in libraries)]
        for away, rank, far, far_repo in found:
            if (away, rank) == min(x[:2] for x in found):
                want[f, far] = min(want.get((f, far), (99,)), (line, value, rank, far_repo))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunks = frame([(f, f * 10 + o, o, 1 + o * 5, 5 + o * 5) for f in repos for o in range(2)], "file_id long, chunk_id long, ordinal int, start_line int, end_line int")
    got = edges.includes(frame(sites, "file_id long, repo string, value string, line int"), frame(files, "file_id long, repo string, path string, stem string"), chunks, frame([(r, True) for r in libraries], "repo string, library boolean"), languages)
    rows = [((r.file_id, r.far_id), (r.line, r.value, r["rank"], r.far_repo)) for r in got.collect()]
    assert len(rows) == len(want) > 500 and dict(rows) == want and all(r.chunk_id == r.far_id * 10 and r.far_path == f"p{r.far_id}" for r in got.collect())


def test_pairs_of_shared_tokens_are_dealt_and_numbered_as_a_plain_version_does(spark, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 8)
    monkeypatch.setattr(edges, "PAIRS", 500)
    rng = random.Random(10)
    rows = []
    for i in range(420):
        kind, v = rng.choice(["route", "destination", "property", "property", "link", "other"]), rng.randrange(6)
        repo = f"r{(v + rng.randrange(5 if v == 5 else 1 + v % 3)) % 5}"  # value 5 stands in too many
        rows += [(kind, f"v{v}", repo, f"f{rng.randrange(30)}" + rng.choice([".go", ".properties"]), rng.randrange(4))] * rng.choice([1, 1, 1, 2, 3])
    few = {k for k in {r[:2] for r in rows} if len({r[2] for r in rows if r[:2] == k}) <= 3 and k[0] != "link"}
    meets = lambda a, b: a[2] != b[2] or (a[0] == "property" and a[3] != b[3] and not a[3].endswith(".properties") and b[3].endswith(".properties"))
    want = sorted((*a, *b[2:]) for a in rows if a[:2] in few for b in rows if b[:2] == a[:2] and meets(a, b))
    tokens = spark.createDataFrame(rows, "kind string, value string, repo string, path string, line long")
    near = edges.neighbours(tokens)
    assert sorted(map(tuple, near.collect())) == want and len(want) > 5000 and near.rdd.getNumPartitions() >= len(want) / 500
    first = {"route": 0, "destination": 1}
    rank = F.when(F.col("kind") == "route", 0).when(F.col("kind") == "destination", 1).otherwise(2)
    told = []
    for repo in {w[2] for w in want}:
        told += [(*w, n) for n, w in enumerate(sorted((w for w in want if w[2] == repo), key=lambda w: (first.get(w[0], 2), *w[:2], *w[3:])), 1)]
    numbered = edges.numbered_neighbours(tokens, rank)
    assert sorted(map(tuple, numbered.collect())) == sorted(told)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan[: plan.index("Exchange")] and "Window" not in plan[: plan.index("Join")]
