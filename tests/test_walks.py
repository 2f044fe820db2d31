"""Walks to their end, however long, and running sums in ranges, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import budget, history, running, walks


def test_closure_of_a_long_line_of_libraries_and_of_a_ring(spark):
    repos = spark.createDataFrame([("app", "p", False), ("other", "q", False), *((f"l{i}", "x", True) for i in range(30))], "name string, project string, library boolean")
    uses = [("app", "l0"), *((f"l{i}", f"l{i + 1}") for i in range(24)), ("l24", "l3"), ("other", "l28"), ("l28", "l29"), ("l29", "l28"), ("l5", "app"), ("app", "l2")]
    got = {(r.project, r.library): r.depth for r in walks.library_closure(spark.createDataFrame(uses, "repo string, uses string"), repos).collect()}
    assert got == {("p", "l0"): 1, ("p", "l1"): 2, **{("p", f"l{i}"): i - 1 for i in range(2, 25)}, ("q", "l28"): 1, ("q", "l29"): 2}


def test_chains_end_at_their_root_and_rings_have_none(spark):
    rows = [(i, i - 1 if i else None) for i in range(90)] + [(200, 201), (201, 202), (202, 200), (300, 999)]
    got = {r.id: (r.root, r.depth) for r in walks.chain_roots(spark.createDataFrame(rows, "id long, resumes long")).collect()}
    assert got == {**{i: (0, i) for i in range(90)}, 300: (999, 1)}


def plain_distances(parents, tip):
    seen, front, n = {tip: 0}, [tip], 0
    while front:
        n += 1
        front = [p for p in {p for s in front for p in parents.get(s, ())} if p not in seen]
        seen |= dict.fromkeys(front, n)
    return seen


def test_ancestry_of_600_commits_with_merges_and_rings(spark):
    rng = random.Random(4)
    parents = {f"c{i}": {f"c{i - 1}"} for i in range(1, 601)}
    for i in range(40):
        a, b = sorted(rng.sample(range(601), 2))
        parents.setdefault(f"c{b}", set()).add(f"c{a}")
    parents |= {"r0": {"r1"}, "r1": {"r2"}, "r2": {"r0", "c9"}, "c0": {None}}
    rows = [(s, p) for s, ps in parents.items() for p in ps]
    tips = ["c600", "c77", "r1", "lone"]
    got = {(r.tip, r.sha): r.distance for r in history.ancestry(spark.createDataFrame(rows, "sha string, parent string"), spark.createDataFrame([(t,) for t in tips], "sha string")).collect()}
    plain = {s: {p for p in ps if p} for s, ps in parents.items()}
    assert got == {(t, s): d for t in tips for s, d in plain_distances(plain, t).items()}


@pytest.mark.parametrize("n", [0, 1, 300])
def test_running_sums_equal_a_plain_loop_and_use_no_single_task(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1, 5, 40])) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g string, cost long").repartition(5)
    out = running.running(df, [F.desc("g"), F.col("id")], spent="cost", nth=F.lit(1))
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    want, spent = [], 0
    for k, (i, g, c) in enumerate(sorted(rows, key=lambda r: (-ord(r[1]), r[0])), 1):
        spent += c or 0
        want.append((i, g, c, spent, k))
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    capped = budget.capped(df.where("cost IS NOT NULL"), "cost", 10, 120, ["id"])
    assert sum(r.taken for r in capped.collect()) == min(120, sum(min(10, c) for *_, c in rows if c))


def test_more_terms_than_a_number_has_bits(spark):
    from tessera.operators import lanes

    rows = [("r", f"p{i}", 1, 0, i, " ".join(f"word{k:03d}x" for k in range(i, 140, 7))) for i in range(7)]
    hits = spark.createDataFrame(rows, "repo string, path string, start_line int, ordinal int, chunk_id long, raw_text string")
    got = {(r.term_pos, r.chunk_id) for r in lanes.substring(hits, [f"word{k:03d}x" for k in range(140)]).collect()}
    assert got == {(k, k % 7) for k in range(140)}


def test_texts_within_one_edit_share_a_key(spark):
    from tessera.functions import text

    pairs = [("abcd", "abcd"), ("abcd", "abxd"), ("abcd", "abcde"), ("abcd", "xabcd"), ("abcd", "abc"), ("aabb", "abab"), ("aaaa", "aaa"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (F.levenshtein("a", "b") <= 1).alias("near"), F.arrays_overlap(text.one_edit_keys(F.col("a")), text.one_edit_keys(F.col("b"))).alias("shared"))
    assert all(r.shared or not r.near for r in df.collect())
