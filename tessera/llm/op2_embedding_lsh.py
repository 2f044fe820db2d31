"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised in double precision; `tables` hash tables each join `width`-quantised projections on `k` Gaussian
directions into a bucket; vectors that share a bucket are candidates and are compared by exact cosine in double precision.
For unit vectors a cosine of 0.95 is a distance of 0.316; with a width of 2 one projection agrees for such a pair with a
probability of 0.874 and for unrelated ones with 0.486. `plan` takes as many directions as keep the unrelated vectors in a bucket
at about `STRANGERS`, and as many tables as keep the chance of missing a pair exactly at the threshold below `MISS` - see `miss`.

Equal vectors are one class with a count and are compared once. A bucket is dealt out in blocks of about `BLOCK` vectors:
pairs of blocks are tasks of their own, so a bucket with a third of all vectors meets in no task. Only names of buckets are
shuffled until buckets of one vector are gone; a vector is then sent once to each pair of blocks that it is in. A pair that shares
several buckets counts in the first of them only: the other names are computed again for vectors that link. A block emits, for each vector, its number of links and the root of
its local component, never pairs; the roots are joined to components by `connected_components`.

Nulls and edge cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does
one of another width; scaled copies link (cosine 1); rows that repeat a vec_id are vectors of their own, a component
carries the smallest vec_id; a null vec_id is kept and links with nothing; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import block_pairs, connected_components, groups_of, shared_dir, splitmix, stored, tidy

THRESHOLD, WIDTH, BLOCK, SEED, MISS, STRANGERS = 0.95, 2.0, 2048, 20, 0.005, 500


def agree(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two points at `distance` (p-stable, Gaussian)."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def miss(k: int, tables: int, cosine: float = THRESHOLD) -> float:
    """The chance that a pair of that cosine shares no bucket."""
    return (1 - agree(math.sqrt(2 - 2 * cosine)) ** k) ** tables


def plan(n: int, cosine: float = THRESHOLD) -> tuple[int, int]:
    """(k, tables): at most STRANGERS unrelated vectors expected in a bucket, a miss below MISS at the threshold."""
    far = agree(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(far)))
    near = agree(math.sqrt(2 - 2 * cosine)) ** k
    return k, math.ceil(math.log(MISS) / math.log(1 - near))


def projections(width: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, width])
    return rng.standard_normal((width, k * tables)), rng.random(k * tables) * WIDTH


def buckets(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """n x tables of 32-bit bucket names."""
    a, b = projections(unit.shape[1], k, tables)
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    out = np.broadcast_to(splitmix(np.arange(tables, dtype=np.uint64)), (len(unit), tables)).copy()
    for i in range(k):
        out = splitmix(out ^ cells[:, :, i])
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def units(vectors: list) -> tuple[np.ndarray, int]:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(ids, copies, unit, names, table: int, side, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and local root of each row of a block, or of two blocks (`across`: only pairs with one row of either side); `names(rows)`: their buckets."""
    n = len(ids)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(n), np.arange(n))
    hit = unit[left] @ unit[right].T >= threshold
    x, y = np.nonzero(hit if across else np.triu(hit, 1))
    x, y = left[x], right[y]
    if table and len(x):
        linked, at = np.unique(np.r_[x, y], return_inverse=True)
        signs = names(linked)[:, :table]
        new = ~(signs[at[: len(x)]] == signs[at[len(x) :]]).any(axis=1)
        x, y = x[new], y[new]
    links = np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
    root = np.arange(n)
    while len(x):  # hang the larger root on the smaller until all pairs agree
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    return links.astype(np.int64), ids[root]


def _blocks(threshold: float, k: int, tables: int):
    """Over rows sorted by pair of blocks; yields (rep, links, root) of rows that link."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches):
        for t in groups_of(batches, ["t", "bucket", "i", "j", "dim"]):
            ids, copies, side, table, i, j = (t[c].to_numpy() for c in ("rep", "copies", "side", "t", "i", "j"))
            if len(ids) < 2 or (i[0] != j[0] and side.min() == side.max()):
                continue
            unit = units(t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
            links, root = compare(ids, copies, unit, lambda rows: buckets(unit[rows], k, tables), int(table[0]), side, bool(i[0] != j[0]), threshold)  # noqa: B023
            keep = links > 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, links, root)], schema=schema)

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """`vectors(vec_id, embedding)` that can link -> one row per different vector: rep (smallest vec_id), copies, embedding, dim."""
    fit = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    sound = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return sound.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "embedding", F.size("embedding").alias("dim"))


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, (rep, links) counts over vectors, (node, component))."""
    spark = vectors.sparkSession
    shared_dir(spark)
    reps = stored(classes(vectors), "vectors")
    k, tables = plan(reps.count(), threshold)

    def sign(batches):
        for b in batches:
            dims, table = b.column(2).to_numpy(), pa.Table.from_batches([b])
            for d in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == d)).combine_chunks()
                unit = units(part["embedding"].combine_chunks().flatten().to_numpy().reshape(len(part), d))
                signs = pa.FixedSizeListArray.from_arrays(pa.array(buckets(unit, k, tables).ravel()), tables).cast(pa.list_(pa.int32()))
                yield pa.Table.from_arrays([part["rep"], part["dim"], signs], names=["rep", "dim", "signs"]).to_batches()[0]

    signed = stored(reps.select("rep", "embedding", "dim").mapInArrow(tidy(sign), "rep long, dim int, signs array<int>"), "signs")
    placed = signed.select("rep", "dim", F.posexplode("signs").alias("t", "bucket"))
    sizes = placed.groupBy("t", "bucket", "dim").agg(F.count("*").alias("n")).where("n > 1")
    dealt = block_pairs(placed.join(sizes, ["t", "bucket", "dim"]), "rep", "n", BLOCK)
    tasks = dealt.join(reps.select("rep", "copies", "embedding"), "rep").select("t", "bucket", "i", "j", "side", "dim", "rep", "copies", "embedding")
    keys = ["t", "bucket", "i", "j", "dim"]
    found = stored(tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_blocks(threshold, k, tables)), "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    return reps, counts, parts


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept, copies (equal vectors, itself included; 0 if it cannot link)."""
    reps, counts, parts = link(vectors, threshold)
    known = reps.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    joined = out.join(known, (out["embedding"] == known["embedding"]) & out["vec_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


SQL = f"""
WITH RECURSIVE s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT a AS v, a AS r FROM l UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.v),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
n AS (SELECT a AS v, count(*) AS n FROM l GROUP BY a),
e AS (SELECT a.vec_id AS v, count(*) AS copies FROM s a JOIN s b ON a.e = b.e GROUP BY a.vec_id)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept, CAST(coalesce(copies, 0) AS BIGINT) AS copies
FROM embeddings LEFT JOIN n ON n.v = vec_id LEFT JOIN c ON c.v = vec_id LEFT JOIN e ON e.v = vec_id
"""
