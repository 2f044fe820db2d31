"""Helpers shared by the operators of this package: shared storage, Arrow loops, word hashes, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    said = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not said and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        said = said or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(said)
    return said or current


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors, keeps column pruning.

    `arrow_rows`: how many rows its Python steps are given at once, where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if arrow_rows:
        spark.conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Memo(dict):
    """A bounded memo: `memo[key]` computes a missing value, and keeps it for keys of at most `LONGEST` characters; `trim()` empties it, but for the keys to keep, once it holds more than `most`."""

    LONGEST = 64

    def __init__(self, compute: Callable, most: int = 100_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.LONGEST:
            self[key] = value
        return value

    def trim(self, keep=()) -> None:
        if len(self) > self.most:
            kept = {key: self[key] for key in keep if key in self}
            self.clear()
            self.update(kept)


try:
    _trim = ctypes.CDLL(None).malloc_trim  # of the C library, where it has it
except (AttributeError, OSError):
    _trim = None


def give_back() -> None:
    """What is freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable) -> Callable:
    """`run` for `mapInArrow`: what a task held is given back before its Python worker takes the next one."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def runs(sizes: np.ndarray, size: int):
    """Slices of things that are worked on together: as many as `size` holds, and one at least."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield slice(lo, hi)
        lo = hi


def parts(texts: pa.Array, size: int = 1 << 20):
    """Slices of an array of texts that are worked on together: as many as `size` bytes hold, and one at least."""
    yield from runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), size)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers (wraps around)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of `k` words (one hash of everything if there are fewer)."""
    with np.errstate(over="ignore"):
        n = len(words)
        if n == 0:
            return np.zeros(0, np.uint64)
        runs = max(1, n - k + 1)
        out = np.zeros(runs, np.uint64)
        for i in range(min(k, n)):
            out = splitmix(out * np.uint64(0x100000001B3) + words[i : i + runs])
        return out


def block_pairs(rows: DataFrame, dealt_by: str, size: str, block: int) -> DataFrame:
    """Each row of a group of `size` rows, for every pair of blocks (i <= j) of about `block` rows that it is in; side: which of the two."""
    sized = rows.withColumn("__blocks", F.ceil(F.col(size) / block).cast("int"))
    own = sized.withColumn("__block", F.pmod(F.xxhash64(dealt_by), F.col("__blocks")).cast("int"))
    # a row of block x goes to the pairs (x, j), j >= x, as side 0 and to (i, x), i < x, as side 1
    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.struct(F.least("__block", o).alias("i"), F.greatest("__block", o).alias("j"), F.when(o < F.col("__block"), 1).otherwise(0).alias("side")))
    return own.select(*rows.columns, F.explode(pairs).alias("__p")).select(*rows.columns, "__p.i", "__p.j", "__p.side")


def groups_of(batches, keys: list[str]):
    """Record batches sorted by `keys` -> one table per group."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not len(t):
            continue
        columns = [t[c].to_numpy() for c in keys]
        edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns], axis=0)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield t.slice(lo, hi - lo)
        held = t.slice(edges[-1])  # the last group may go on
    if held is not None and len(held):
        yield held


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges(a, b)` of longs -> `(node, component)`, the component being its smallest node.

    Alternating large-star and small-star steps. Every step is a grouped minimum (combined before the shuffle)
    and an equi-join that adaptive execution may split, so a node with very many neighbours stays no task's
    burden. Each round is cut with `checkpoint()`.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        # large star: every larger neighbour of a node is hung on the smallest of its neighbourhood
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and itself, are hung on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s")).select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct().checkpoint()
        cur, before, mark = small, mark, small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def hex_fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the key's MD5: the same in every run and engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
