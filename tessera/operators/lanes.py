"""Search lanes (R01-R06): exact nearest vectors, keyword tiers by bm25, substring scans."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths, text
from tessera.operators.storage import kept

ADDRESS = ("repo", "path", "start_line", "ordinal", "chunk_id")
MAX_DISTANCE, MOST_NEIGHBOURS, LANE_DEPTH = 1.25, 4096, 40
#: queries and vectors that meet in one task
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
K1, B, LEAST_IDF, PLACES = 1.2, 0.75, 1e-6, 6
HUB_SHARE, HUB_FLOOR = 0.02, 500


@dataclass(frozen=True)
class Weights:
    """Lane weights; a lane of weight 0 is muted."""

    strict: float = 1.0
    content: float = 0.9
    prefix: float = 0.7
    any: float = 0.4
    semantic: float = 0.6
    code: float = 0.8
    substring: float = 0.85


def knn(vectors: DataFrame, queries: DataFrame, k: int = LANE_DEPTH, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The k nearest chunks of each of `queries(query_id, query)` by L2, ties by address, *then* the distance cut. `vectors` is already restricted.

    Queries and vectors are dealt into blocks, and each pair of blocks is a task that both are shuffled to: no query passes the driver, and the plan is
    the same however many there are. A task compares its blocks as matrices and hands on, for each query, its own k best and what ties with the
    last of them. Only ids and vectors are moved; addresses are joined to what is left.
    """
    k = min(k, MOST_NEIGHBOURS)
    asked, held = (d.agg(F.count("*")).first()[0] for d in (queries, vectors))
    rows_of, blocks_of = max(1, -(-held // VECTOR_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("query IS NOT NULL").select("query_id", F.transform("query", lambda x: x.cast("double")).alias("query"), deal("query_id", blocks_of).alias("i"), every(rows_of).alias("j"))
    v = vectors.where("embedding IS NOT NULL").select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), deal("chunk_id", rows_of).alias("j"), every(blocks_of).alias("i"))
    near = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(_nearest(k), "query_id long, chunk_id long, distance double")
    # what cannot be among the k is gone before addresses come in
    close = near.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy("distance"))).where(F.col("place") <= k).drop("place")
    placed = close.join(vectors.select(*ADDRESS), "chunk_id").select("query_id", *ADDRESS, "distance")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", *ADDRESS)) - 1).where(F.col("rank") < k)
    return ranked.where(F.col("distance") < max_distance) if max_distance > 0 else ranked


def _nearest(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())])

    def of_width(t: pa.Table, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors by width: vectors of another width than a query's are not compared with it."""
        t = t.combine_chunks()
        widths, out = pc.list_value_length(t[column]).to_numpy(), {}
        for w in np.unique(widths).tolist():
            part = t.filter(pa.array(widths == w)).combine_chunks()
            out[w] = part.column(0).to_numpy(), part[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), w)
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ask, have, out = of_width(left.select(["query_id", "query"]), "query"), of_width(right.select(["chunk_id", "embedding"]), "embedding"), []
        for w in sorted(ask.keys() & have.keys()):
            (ids, q), (chunks, x) = ask[w], have[w]
            for lo in range(0, len(ids), 128):
                part = q[lo : lo + 128]
                far = np.round(np.sqrt(np.maximum((x * x).sum(1)[None, :] + (part * part).sum(1)[:, None] - 2 * part @ x.T, 0)), PLACES)
                far[chunks[None, :] == ids[lo : lo + 128, None]] = np.inf
                least = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if far.shape[1] > k else np.inf
                i, j = np.nonzero((far <= least) & np.isfinite(far))
                out.append(pa.Table.from_arrays([pa.array(ids[lo + i]), pa.array(chunks[j]), pa.array(far[i, j])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


@dataclass(frozen=True)
class Counts:
    """How long each text is and how often it holds some terms: one narrow row per text, made in one pass, with its sums."""

    rows: DataFrame
    key: str
    place: dict[tuple[str, bool], int]
    n: int
    average: float
    #: texts that hold each term
    seen: list[int]


def wanted_term(term: str, as_prefix: bool) -> tuple[str, bool]:
    return text.plain(term), as_prefix and len(term) >= text.PREFIX_LEAST


def counted(chunks: DataFrame, tiers: list[tuple[list[str], bool]], key: str = "chunk_id", body: str = "raw_text") -> Counts:
    """Counts of the terms of all tiers `(terms, as_prefix)`, without diacritics: each text is folded once to words between blanks, and terms are counted by their length in it."""
    wanted = list(dict.fromkeys(wanted_term(t, as_prefix) for terms, as_prefix in tiers for t in terms))

    def times(words, term: str):
        return ((F.octet_length(words) - F.octet_length(F.replace(words, F.lit(term), F.lit("")))) / len(term.encode())).cast("long")

    # two blanks between words, one at either end: no word shares a blank with the next
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(text.unaccented(F.lower(F.coalesce(F.col(body), F.lit("")))), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    length = F.when(F.col("words") == "  ", 0).otherwise(times(F.col("words"), "  ") + 1)
    tf = F.array(*(times(F.col("words"), f" {t}" if p else f" {t} ") for t, p in wanted)).cast("array<long>")
    rows = kept(chunks.select(key, words.alias("words")).select(key, length.cast("long").alias("dl"), tf.alias("tf")))
    sums = rows.agg(F.count("*"), F.avg("dl"), *(F.count_if(F.col("tf")[i] > 0) for i in range(len(wanted)))).first()
    return Counts(rows, key, {w: i for i, w in enumerate(wanted)}, sums[0], float(sums[1] or 0), list(sums[2:]))


def score(counts: Counts, terms: list[str], all_match: bool, as_prefix: bool = False) -> tuple[Column, Column]:
    """Of a counted row: whether it matches, and its bm25; statistics are those of all counted texts."""
    places = [counts.place[wanted_term(t, as_prefix)] for t in terms]
    idf = [max(math.log((counts.n - counts.seen[i] + 0.5) / (counts.seen[i] + 0.5)), LEAST_IDF) for i in places]
    parts = [F.lit(w) * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + K1 * (1 - B + B * F.col("dl") / F.lit(counts.average))) for i, w in zip(places, idf)]
    held = [F.col("tf")[i] > 0 for i in places]
    return reduce(lambda a, b: a & b if all_match else a | b, held), F.round(sum(parts[1:], parts[0]), PLACES)


def bm25(counts: Counts, terms: list[str], all_match: bool, as_prefix: bool = False) -> DataFrame:
    """`key` and score of the rows that match."""
    hit, value = score(counts, terms, all_match, as_prefix)
    return counts.rows.where(hit).select(counts.key, value.alias("score"))


def keyword(chunks: DataFrame, hits: DataFrame, terms: list[str], all_match: bool, as_prefix: bool = False, n: int = LANE_DEPTH, counts: Counts | None = None) -> DataFrame:
    """The n best hits by bm25, ties by address, with their rank; `counts` from an index or from a pass over `chunks` that several tiers share."""
    scored = hits.select(*ADDRESS).join(bm25(counts or counted(chunks, [(terms, as_prefix)]), terms, all_match, as_prefix), "chunk_id")
    return ranked(scored.orderBy(F.desc("score"), *ADDRESS).limit(n), F.desc("score"))


def tiered(hits: DataFrame, counts: Counts, tiers: list[tuple[str, list[str], bool, bool]], n: int = LANE_DEPTH) -> DataFrame:
    """All tiers of a question at once: (tier, address, score, rank from 0), each tier's n best; scored texts meet their address once."""
    each = []
    for name, terms, all_match, prefix in tiers:
        hit, value = score(counts, terms, all_match, prefix)
        each.append(F.when(hit, F.struct(F.lit(name).alias("tier"), value.alias("score"))))
    scored = counts.rows.select(counts.key, F.explode(F.array_compact(F.array(*each))).alias("s")).select(counts.key, "s.*")
    by = Window.partitionBy("tier").orderBy(F.desc("score"), *ADDRESS)
    placed = scored.join(hits.select(*ADDRESS), "chunk_id")
    return placed.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < n).select("tier", *ADDRESS, "score", "rank")


def ranked(rows: DataFrame, *by) -> DataFrame:
    """Ranks from 0 over rows that are few by now."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by, *ADDRESS)) - 1)


def _marked(hits: DataFrame, terms: list[str]) -> DataFrame:
    """Addresses of the chunks that hold a term, with a bit for each, BITS to a number: the text is folded once, and the terms are plain searches in it."""
    folded = hits.select(*ADDRESS, "raw_text", text.ascii_lower(F.col("raw_text")).alias("folded"))
    bits = [F.when(text.holds(F.col("raw_text"), F.col("folded"), t), F.lit(1 << i % BITS).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(terms)]
    return folded.select(*ADDRESS, F.array(*(sum(bits[lo + 1 : lo + BITS], bits[lo]) for lo in range(0, len(bits), BITS))).alias("bits"))


BITS = 62


def _bit(i: int) -> Column:
    return F.expr(f"bits[{i // BITS}] & {1 << i % BITS}L") != 0


def substring(hits: DataFrame, terms: list[str], n: int = LANE_DEPTH) -> DataFrame:
    """For each term its n first chunks by kind and address, all in one scan. A term that stands in more than HUB_SHARE of at least HUB_FLOOR chunks says nothing: its lane is empty."""
    if not terms:
        return hits.limit(0).select(F.lit(0).alias("term_pos"), F.lit("").alias("term"), *ADDRESS, F.lit(0).alias("kind"), F.lit(0).alias("rank"))
    marked = kept(_marked(hits, terms))
    sums = marked.agg(F.count("*"), *(F.count_if(_bit(i)) for i in range(len(terms)))).first()
    hub = [sums[0] >= HUB_FLOOR and m / sums[0] > HUB_SHARE for m in sums[1:]]
    open_ = [(i, t) for i, t in enumerate(terms) if not hub[i]]
    listed = F.array_compact(F.array(*[F.when(_bit(i), F.struct(F.lit(i).alias("term_pos"), F.lit(t).alias("term"))) for i, t in open_])) if open_ else F.expr("CAST(array() AS array<struct<term_pos:int,term:string>>)")
    rows = marked.where("exists(bits, b -> b <> 0)").select(*ADDRESS, F.explode(listed).alias("s")).select("s.*", *ADDRESS, paths.kind_rank(F.col("path")).alias("kind"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("term_pos").orderBy("kind", *ADDRESS)) - 1).where(F.col("rank") < n)


def hub_guard(hits: DataFrame, terms: list[str]) -> DataFrame:
    """How many chunks hold each term, of how many, and whether it is a hub."""
    counts = _marked(hits, terms).agg(F.count("*").alias("total"), *[F.count_if(_bit(i)).alias(f"m{i}") for i in range(len(terms))])
    listed = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"m{i}").alias("matched")) for i, t in enumerate(terms)]))
    rows = counts.select("total", listed.alias("s")).select("s.term", "s.matched", "total")
    return rows.withColumn("hub", (F.col("total") >= HUB_FLOOR) & (F.col("matched") / F.col("total") > HUB_SHARE))


def round_robin(rows: DataFrame, n: int = LANE_DEPTH) -> DataFrame:
    """First of each term, second of each, and so on; a chunk counts once, where it first stands."""
    order = F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank", "term_pos"))
    once = rows.withColumn("nth", order).where("nth = 1")
    return once.orderBy("rank", "term_pos").limit(n).withColumn("pos", F.row_number().over(Window.orderBy("rank", "term_pos")) - 1).select(*ADDRESS, "pos")
