"""Queries that SQL does not hold, against plain versions over the smallest tables."""

import re
from collections import defaultdict

import duckdb

from tessera import plans
from tessera.plans import fixtures

DIR = "/root/testdata/sf0.001"


def rows(body, *views):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con.execute(fixtures.sql(body, *views)).fetchall()


def test_census_equals_a_plain_version(spark):
    places = defaultdict(set)
    for repo, value, path, line in rows("SELECT repo, value, path, line FROM tokens", "tokens"):
        places[repo, value].add((path, line))
    want, spent = set(), defaultdict(int)
    for (repo, value), at in sorted(places.items(), key=lambda x: (x[0][0].encode(), x[0][1].encode())):
        first = sorted(at, key=lambda p: (p[0].encode(), p[1]))
        listing = " ".join(f"{p}:{n}" for p, n in first[:3]) + (f" +{len(first) - 3} more" if len(first) > 3 else "")
        cost = (len(listing) + 3) // 4
        if spent[repo] + cost <= 60:
            spent[repo] += cost
            want.add((repo, value, listing, len(first), cost))
    got = {(r.repo, r.value, r.listing, r.n, r.cost) for r in plans.queries()["g06_census"](spark, DIR).collect()}
    assert sorted(got - want) == sorted(want - got) == [] and any(n > 1 for _, _, _, n, _ in want)


def test_gather_equals_a_plain_version(spark):
    """Hits, two hops of references, shared tokens and one more hop, in plain loops."""
    docs = {i: (repo, path, body) for i, repo, path, body in rows("SELECT chunk_id, repo, path, raw_text FROM hits", "hits")}
    symbols = [(n, f) for n, f in rows("SELECT DISTINCT name, file_id FROM symbols WHERE repo <> 'src3' AND length(name) > 2", "symbols")]
    by_name = defaultdict(set)
    for n, f in symbols:
        by_name[n].add(f)
    few = {n: fs for n, fs in by_name.items() if len(fs) <= 4}
    names = {i: {w for w in re.findall(r"\w+", body) if w in few} for i, (_, _, body) in docs.items()}
    cost = {i: -(-len(b) // 4) for i, (_, _, b) in docs.items()}
    got = plans.queries()["g02_gather"](spark, DIR).collect()
    crossings = {(r.from_id, r.file_id) for r in plans.graph._crossing(fixtures.Corpus(spark, DIR)).select("from_id", "file_id").collect()}
    is_test = lambda path: path.endswith("_test.go")
    taken, place = {}, []

    def add(i, hop, reason, spent):
        taken[i] = (hop, reason, len(place), spent)
        place.append(i)

    spent = 0
    for i in sorted(j for j in (5, 11, 40) if j in docs):
        spent += cost[i]
        add(i, 0, "hit", spent)

    def admit(found, hop, limit):
        nonlocal spent
        best = {}
        for key, i in sorted(found):
            if i not in taken and i not in best:
                best[i] = key
        new, start = [], spent
        for key, i in sorted((k, i) for i, k in best.items()):
            start += cost[i]
            if start > limit:
                break
            new.append((i, hop, key[-1], start))
        for x in new:
            add(*x)
        spent = new[-1][3] if new else spent
        return [x[0] for x in new]

    def references(sources):
        return [((taken[s][2], is_test(docs[f][1]), docs[f][0].encode(), docs[f][1].encode(), f, f"names {n}"), f) for s in sources for n in names[s] for f in few[n] if f != s and f in docs]

    last = list(taken)
    for hop in (1, 2):
        last = admit(references(last), hop, 6000)
    last = admit([((min(taken[a][2] for a, b in crossings if b == f and a in taken), is_test(docs[f][1]), docs[f][0].encode(), docs[f][1].encode(), f, "shares a token"), f) for f in {b for a, b in crossings if a in taken} if f in docs], 3, 7000)
    admit(references(last), 4, 7000)
    assert {r.chunk_id: (r.hop, r.reason, r.place, r.spent) for r in got} == taken and len(taken) > 3
