"""Queries over search lanes, fusion and ordering, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import fusion, lanes
from tessera.operators.lanes import ADDRESS
from tessera.operators.storage import kept
from tessera.plans.fixtures import Corpus, sql

QUESTION = "how does the theaeati handle thattionwh"
TERMS12 = ("leellevi", "lichlich", "thanbletion", "thattionwh", "thesstble", "reingtion", "thstthou", "thesedhe", "ofretihaou", "onoueshe", "ciónueíez", "ananheea")
KEYS = ", ".join(ADDRESS)
_KIND = f"CASE WHEN regexp_matches(path, '{paths.DOC_PATTERN}') THEN 2 WHEN regexp_matches(path, '{paths.TEST_PATTERN}') THEN 1 ELSE 0 END"


def _out(df: DataFrame, *columns) -> DataFrame:
    """Only plain columns of one integer type, for a stable comparison."""
    return df.select(*[F.col(c).cast("long").alias(c) if dict(df.dtypes)[c] in ("int", "bigint") else F.col(c) for c in columns])


# --- SQL pieces ---------------------------------------------------------------------------------------------------


def knn_sql(where: str = "true", k: int = lanes.LANE_DEPTH, max_distance: float = lanes.MAX_DISTANCE) -> str:
    cut = f"WHERE distance < {max_distance}" if max_distance > 0 else ""
    return f"""SELECT * FROM (SELECT query_id, {KEYS}, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, {KEYS}) - 1 AS rank FROM
        (SELECT query_id, {KEYS}, round(list_distance(embedding::DOUBLE[], query::DOUBLE[]), 6) AS distance FROM vectors, qvec WHERE chunk_id <> query_id AND {where}) QUALIFY rank < {k}) {cut}"""


def bm25_sql(terms: list[str], all_match: bool, as_prefix: bool, table: str = "chunks", key: str = "chunk_id", body: str = "raw_text") -> str:
    tokens = rf"list_filter(regexp_split_to_array(strip_accents(lower({body})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    one = lambda t: f"len(list_filter({tokens}, lambda t: {f'starts_with(t, {chr(39)}{t}{chr(39)})' if as_prefix and len(t) >= 5 else f't = {chr(39)}{t}{chr(39)}'}))"
    tf = ", ".join(f"{one(t)} AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    keep = (" AND " if all_match else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""SELECT {key}, round({score}, 6) AS score FROM (SELECT {key}, len({tokens}) AS dl, {tf} FROM {table}) c,
        (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM (SELECT len({tokens}) AS dl, {tf} FROM {table})) s WHERE {keep}"""


def keyword_sql(terms: list[str], all_match: bool, as_prefix: bool, n: int = lanes.LANE_DEPTH) -> str:
    return f"SELECT {KEYS}, score, row_number() OVER (ORDER BY score DESC, {KEYS}) - 1 AS rank FROM hits JOIN ({bm25_sql(terms, all_match, as_prefix)}) USING (chunk_id) QUALIFY rank < {n}"


def contains_sql(term: str) -> str:
    if term.isascii():
        return f"contains(translate(raw_text, '{text.UPPER}', '{text.LOWER}'), '{term.lower()}')"
    return f"(contains(raw_text, '{term}') OR contains(raw_text, '{term[0].upper() + term[1:]}'))"


def substring_sql(terms: list[str], n: int = lanes.LANE_DEPTH) -> str:
    each = " UNION ALL ".join(f"SELECT {i} AS term_pos, '{t}' AS term, {KEYS}, {_KIND} AS kind, (SELECT count(*) FROM hits) AS total FROM hits WHERE {contains_sql(t)}" for i, t in enumerate(terms))
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term_pos ORDER BY kind, {KEYS}) - 1 AS rank, count(*) OVER (PARTITION BY term_pos) AS m FROM ({each}))
        WHERE rank < {n} AND NOT (total >= 500 AND m / total > 0.02)"""


def robin_sql(inner: str, n: int = lanes.LANE_DEPTH) -> str:
    return f"SELECT {KEYS}, row_number() OVER (ORDER BY rank, term_pos) - 1 AS pos FROM (SELECT * FROM ({inner}) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY rank, term_pos) = 1) QUALIFY pos < {n}"


def _decay_sql(test: float = 0.35, doc: float = 0.7) -> str:
    t = f"CASE WHEN regexp_matches(path, '{paths.TEST_PATTERN}') THEN {test} ELSE 1.0 END"
    return f"CASE WHEN regexp_matches(path, '{paths.DOC_PATTERN}') THEN least({t}, {doc}) ELSE {t} END"


def search_lanes(c: Corpus, question: str, w: lanes.Weights = lanes.Weights(), depth: int = lanes.LANE_DEPTH) -> DataFrame:
    """All lanes of one question, ranked. The question's vector is that of the highest query id."""
    hits, out = c.hits(), []
    query = c.question()
    out.append(fusion.lane(lanes.knn(c.vectors(), query, depth), "semantic", w.semantic, 0))
    tiers = text.tiers(question)
    if tiers:
        found = kept(lanes.tiered(hits, c.postings().counted([(terms, prefix) for _, terms, _, prefix in tiers]), tiers, depth))
        out += [fusion.lane(found.where(F.col("tier") == tier), tier, getattr(w, tier), 1 + i) for i, (tier, *_) in enumerate(tiers)]
    robin = lanes.round_robin(lanes.substring(hits, text.substring_terms(question), depth), depth)
    out.append(fusion.lane(robin.withColumnRenamed("pos", "rank"), "substring", w.substring, 9))
    lane = out[0]
    for more in out[1:]:
        lane = lane.unionByName(more)
    return lane


def lanes_sql(question: str, w: lanes.Weights = lanes.Weights()) -> str:
    parts = [f"SELECT {KEYS}, rank, distance, 'semantic' AS lane, {w.semantic} AS weight, 0 AS lane_pos FROM ({knn_sql('query_id = (SELECT max(query_id) FROM qvec)')})"]
    for i, (tier, terms, all_match, prefix) in enumerate(text.tiers(question)):
        parts.append(f"SELECT {KEYS}, rank, NULL, '{tier}', {getattr(w, tier)}, {1 + i} FROM ({keyword_sql(terms, all_match, prefix)})")
    parts.append(f"SELECT {KEYS}, pos, NULL, 'substring', {w.substring}, 9 FROM ({robin_sql(substring_sql(text.substring_terms(question)))})")
    return " UNION ALL ".join(parts)


def fused_sql(inner: str) -> str:
    return f"""SELECT {KEYS}, sum(weight / (60 + rank)) AS score, string_agg(lane, ',' ORDER BY lane_pos) AS lanes, coalesce(max(distance), 0) AS distance FROM ({inner}) WHERE weight > 0 GROUP BY ALL"""


def ordered_sql(inner: str, k: int, decay: float = 1.0) -> str:
    place = f"row_number() OVER (PARTITION BY repo ORDER BY score DESC, {KEYS}) - 1"
    return f"""SELECT *, row_number() OVER (ORDER BY decayed DESC, score DESC, {KEYS}) - 1 AS rank FROM (SELECT *, round(score * pow({decay}, {place}), 9) AS decayed FROM
        (SELECT * REPLACE (round(score * ({_decay_sql()}), 9) AS score) FROM ({inner}))) QUALIFY rank < {k}"""


# --- queries ------------------------------------------------------------------------------------------------------


def r10_hybrid_search(spark, sf_dir):
    found = fusion.ordered(fusion.fuse(search_lanes(Corpus(spark, sf_dir), QUESTION)), 20)
    return _out(found.withColumn("score", F.round("decayed", 6)), "rank", "chunk_id", "repo", "path", "score", "lanes", "distance")


def r01_knn_scoped(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(lanes.knn(c.vectors().where(F.col("repo").isin("src1", "src2", "src5")), c.queries(), 10, 0), "query_id", "chunk_id", "distance", "rank")


def t01_distance_cut(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(lanes.knn(c.vectors(), c.queries()), "query_id", "chunk_id", "distance", "rank")


def _keyword(c: Corpus, terms: list[str], all_match: bool, as_prefix: bool = False) -> DataFrame:
    """A keyword lane from the index."""
    return lanes.keyword(c.chunks(), c.hits(), terms, all_match, as_prefix, counts=c.postings().counted([(terms, as_prefix)]))


def _tier(name: str):
    return next(t for t in text.tiers("thintion theaeati onanshat the") if t[0] == name)


def r02_keyword_and(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(_keyword(c, ["thintion", "the"], True), "chunk_id", "score", "rank")


def r02_keyword_prefix(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return _out(_keyword(c, ["thint", "theae"], True, True), "chunk_id", "score", "rank")


def r02_keyword_or(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    _, terms, all_match, prefix = _tier("any")
    return _out(_keyword(c, terms, all_match, prefix), "chunk_id", "score", "rank")


def r03_code_override(spark, sf_dir):
    """The widest tier of the code text stands at the code lane's weight."""
    c = Corpus(spark, sf_dir)
    rows = _keyword(c, ["thbleing", "erbleing"], False, True)
    return _out(fusion.lane(rows, "code", lanes.Weights().code, 0), "chunk_id", "rank", "lane", "weight")


def r04_substring(spark, sf_dir):
    return _out(lanes.substring(Corpus(spark, sf_dir).hits(), ["thattionwh"]), "chunk_id", "kind", "rank")


def r05_substring_batched(spark, sf_dir):
    return _out(lanes.substring(Corpus(spark, sf_dir).hits(), list(TERMS12)), "term", "chunk_id", "kind", "rank")


def a06_hub_guard(spark, sf_dir):
    return _out(lanes.hub_guard(Corpus(spark, sf_dir).hits(), ["schein", "ouement", "ofretihaou"]), "term", "matched", "total", "hub")


def r06_round_robin(spark, sf_dir):
    return _out(lanes.round_robin(lanes.substring(Corpus(spark, sf_dir).hits(), list(TERMS12))), "chunk_id", "pos")


def r07_rrf(spark, sf_dir):
    fused = fusion.fuse(search_lanes(Corpus(spark, sf_dir), QUESTION))
    return _out(fused.withColumn("score", F.round("score", 9)), "chunk_id", "score", "lanes", "distance")


def r08_decay(spark, sf_dir):
    hits = Corpus(spark, sf_dir).hits()
    return _out(hits.select("chunk_id", "path", paths.kind_rank(F.col("path")).alias("kind"), fusion.supporting(F.col("path")).alias("factor")), "chunk_id", "path", "kind", "factor")


def w10_repo_decay(spark, sf_dir):
    found = fusion.ordered(fusion.fuse(search_lanes(Corpus(spark, sf_dir), QUESTION)), 20, repo_decay=0.9)
    return _out(found.withColumn("decayed", F.round("decayed", 6)), "rank", "chunk_id", "repo", "decayed")


def _module(how: str):
    def query(spark, sf_dir):
        c = Corpus(spark, sf_dir)
        rows = _keyword(c, ["thint", "theae"], False, True).withColumn("module", paths.directory(F.col("path")))
        return _out(fusion.module_score(rows, how), "chunk_id", "module", "module_score")

    query.__name__ = f"r14_module_rerank_{how}"
    return query


def t14_apply_picks(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    rows = _keyword(c, ["thint", "theae"], False, True)
    picks = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 99), (4, 0), (5, 9)], "pos int, pick int")
    return _out(fusion.apply_picks(rows, picks, 20), "chunk_id", "rank", "new_rank")


def r12_grep(spark, sf_dir):
    """Lines that hold a term, once per file and line, the first 80 by address."""
    lines = Corpus(spark, sf_dir).lines().where("repo <> 'src3'").where(text.contains_term(F.col("text"), F.lit("theaeati")))
    return _out(lines.dropDuplicates(["file_id", "line"]).orderBy("repo", "path", "line").limit(80).withColumn("text", F.left("text", F.lit(240))), "file_id", "line", "text")


def p03_repo_scope(spark, sf_dir):
    return _out(Corpus(spark, sf_dir).hits().where(F.col("repo").isin("src1", "src3", "src7")).select("chunk_id", "repo"), "chunk_id", "repo")


def p04_stage_scope(spark, sf_dir):
    """src1 and src2 declare the stage under a prefix, src5 declares none of that name: it matches nothing."""
    prefixes = spark.createDataFrame([("src1", "en/"), ("src2", "de/d1"), ("src5", "\u0000")], "repo string, prefix string")
    hits = Corpus(spark, sf_dir).hits().join(F.broadcast(prefixes), "repo", "left")
    return _out(hits.where(paths.stage_scope(F.col("repo"), F.col("path"), F.col("prefix"))), "chunk_id", "repo", "path")


def t12_comparison_merge(spark, sf_dir):
    """The best of each repository, merged by score (then repository) and cut."""
    c = Corpus(spark, sf_dir)
    rows = c.hits().select(*ADDRESS).join(lanes.bm25(c.postings().counted([(["thint", "theae", "onans"], True)]), ["thint", "theae", "onans"], False, True), "chunk_id").where(F.col("repo").isin("src1", "src2", "src7"))
    per = rows.withColumn("nth", F.row_number().over(_by("repo", F.desc("score"), *ADDRESS))).where("nth <= 8")
    return _out(per.orderBy(F.desc("score"), *ADDRESS).limit(16).withColumn("rank", F.row_number().over(_by(None, F.desc("score"), *ADDRESS)) - 1), "rank", "chunk_id", "repo", "score")


def _by(partition, *order):
    from pyspark.sql.window import Window

    return (Window.partitionBy(partition) if partition else Window).orderBy(*order)


_MODULE_SQL = {"sum": "sum(score) OVER (PARTITION BY module)", "best": "max(score) OVER (PARTITION BY module)", "count": "count(*) OVER (PARTITION BY module)::DOUBLE", "blend": "score * (1 + 0.15 * ln(1 + count(*) OVER (PARTITION BY module) - 1))"}
_SCOPE = "repo IN ('src1', 'src2', 'src5')"
_ANY = text.tiers("thintion theaeati onanshat the")[-1]

QUERIES = [r10_hybrid_search, r01_knn_scoped, t01_distance_cut, r02_keyword_and, r02_keyword_prefix, r02_keyword_or, r03_code_override, r04_substring, r05_substring_batched, a06_hub_guard, r06_round_robin, r07_rrf, r08_decay, w10_repo_decay, *map(_module, _MODULE_SQL), t14_apply_picks, r12_grep, p03_repo_scope, p04_stage_scope, t12_comparison_merge]

SQL = {
    "r10_hybrid_search": sql(f"SELECT rank, chunk_id, repo, path, round(decayed, 6) AS score, lanes, distance FROM ({ordered_sql(fused_sql(lanes_sql(QUESTION)), 20)})", "vectors", "qvec"),
    "r01_knn_scoped": sql(f"SELECT query_id, chunk_id, distance, rank FROM ({knn_sql(_SCOPE, 10, 0)})", "vectors", "qvec"),
    "t01_distance_cut": sql(f"SELECT query_id, chunk_id, distance, rank FROM ({knn_sql()})", "vectors", "qvec"),
    "r02_keyword_and": sql(f"SELECT chunk_id, score, rank FROM ({keyword_sql(['thintion', 'the'], True, False)})", "hits"),
    "r02_keyword_prefix": sql(f"SELECT chunk_id, score, rank FROM ({keyword_sql(['thint', 'theae'], True, True)})", "hits"),
    "r02_keyword_or": sql(f"SELECT chunk_id, score, rank FROM ({keyword_sql(_ANY[1], False, True)})", "hits"),
    "r03_code_override": sql(f"SELECT chunk_id, rank, 'code' AS lane, 0.8::DOUBLE AS weight FROM ({keyword_sql(['thbleing', 'erbleing'], False, True)})", "hits"),
    "r04_substring": sql(f"SELECT chunk_id, kind, rank FROM ({substring_sql(['thattionwh'])})", "hits"),
    "r05_substring_batched": sql(f"SELECT term, chunk_id, kind, rank FROM ({substring_sql(list(TERMS12))})", "hits"),
    "a06_hub_guard": sql(" UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (WHERE {contains_sql(t)}) AS matched, count(*) AS total, count(*) >= 500 AND count(*) FILTER (WHERE {contains_sql(t)}) / count(*) > 0.02 AS hub FROM hits" for t in ("schein", "ouement", "ofretihaou")), "hits"),
    "r06_round_robin": sql(f"SELECT chunk_id, pos FROM ({robin_sql(substring_sql(list(TERMS12)))})", "hits"),
    "r07_rrf": sql(f"SELECT chunk_id, round(score, 9) AS score, lanes, distance FROM ({fused_sql(lanes_sql(QUESTION))})", "vectors", "qvec"),
    "r08_decay": sql(f"SELECT chunk_id, path, {_KIND} AS kind, ({_decay_sql()})::DOUBLE AS factor FROM hits", "hits"),
    "w10_repo_decay": sql(f"SELECT rank, chunk_id, repo, round(decayed, 6) AS decayed FROM ({ordered_sql(fused_sql(lanes_sql(QUESTION)), 20, 0.9)})", "vectors", "qvec"),
    **{f"r14_module_rerank_{how}": sql(f"SELECT chunk_id, module, round({s}, 6) AS module_score FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS module FROM ({keyword_sql(['thint', 'theae'], False, True)}))", "hits") for how, s in _MODULE_SQL.items()},
    "t14_apply_picks": sql(f"""picks AS (SELECT pick - 1 AS rank, min(pos) AS pos FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 99), (4, 0), (5, 9)) v(pos, pick) GROUP BY pick)
        SELECT chunk_id, rank, row_number() OVER (ORDER BY pos IS NULL, pos, rank) - 1 AS new_rank FROM ({keyword_sql(['thint', 'theae'], False, True)}) LEFT JOIN picks USING (rank) QUALIFY new_rank < 20""", "hits"),
    "r12_grep": sql("SELECT file_id, line, left(text, 240) AS text FROM lines WHERE repo <> 'src3' AND contains(lower(text), 'theaeati') ORDER BY repo, path, line LIMIT 80", "lines"),
    "p03_repo_scope": sql("SELECT chunk_id, repo FROM hits WHERE repo IN ('src1', 'src3', 'src7')", "hits"),
    "p04_stage_scope": sql("SELECT chunk_id, repo, path FROM hits WHERE CASE repo WHEN 'src1' THEN starts_with(path, 'en/') WHEN 'src2' THEN starts_with(path, 'de/d1') WHEN 'src5' THEN false ELSE true END", "hits"),
    "t12_comparison_merge": sql(f"""SELECT row_number() OVER (ORDER BY score DESC, {KEYS}) - 1 AS rank, chunk_id, repo, score FROM
        (SELECT {KEYS}, score FROM hits JOIN ({bm25_sql(['thint', 'theae', 'onans'], False, True)}) USING (chunk_id) WHERE repo IN ('src1', 'src2', 'src7') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, {KEYS}) <= 8) QUALIFY rank < 16""", "hits"),
}
