"""Hard-negative mining by distributed radix selection.

Scores are integer inner products of floor(256 * x). Each anchor has one window of scores per thing that is asked of it: first all
scores of its own label (its `POSITIVES` best are its positives), then, for each positive, the scores of other labels in
[80 % of the positive's, the positive's]. In a window a score is its distance from the upper end, a number of so many digits of
`DIGIT` bits. A pass counts, per window, the next digit among the scores that agree with what is known of the kth, one histogram per
window and task; the histograms are added up and the digit in which the kth lies becomes known, with what is still to be found there.
After the last digit the kth score is known exactly, and one more pass gathers the scores at or above it: less than k of them above,
and of those equal to it at most the k smallest vec_ids of each task, so the gathered rows are few whatever the ties. Windows with fewer than k scores
are taken whole.

Rows lie in blocks of `ROWS` vectors, packed as they are read, and anchors in blocks of `ANCHORS`; each pair of blocks is
a matrix product. A block of anchors is sent to the blocks of rows (a stated query set against all rows, in blocks), never a
pair of rows. The state of the windows is a table of a few numbers for each. Only the number of blocks and two bounds (largest norm, number of digits)
come to the driver.

Scores are exact: products of matrices in float64 where no sum can reach 2^53, and in int64 otherwise.

Nulls and edge cases: rows with a null label, a null, empty or non-finite vector or a null component take no part, nor do those with a null vec_id or
a length of 2^22 or more (scores would not fit 64 bits); rows of another width than the anchor's are not compared with it; of rows that repeat a
vec_id the least (label, vector) stands for all; ties go to the smaller vec_id; an anchor without another row of its label, or a positive
without a negative in its window, has no rows; a positive with a score below 0 has an empty window; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import shared_dir, stored, tidy

POSITIVES, NEGATIVES, ANCHOR_EVERY, SCALE = 5, 5, 100, 256
LOWEST, OF = 80, 100
DIGIT, ROWS, ANCHORS = 8, 8192, 512
BASE = 1 << DIGIT
#: histograms that a task holds before it hands them on
HELD = 1 << 14
#: packed blocks that a Python step is given at once
AT_ONCE = 8
#: sums of squares that scores of 64 bits allow for: no score reaches 2^60
FIT = f"vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)) AND aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)) < {float(1 << 60) / SCALE**2}"
BLOCKS = "block long, dim int, n int, ids binary, labels binary, vectors binary"
#: a window: which scores of an anchor it holds (of its own label or of others), its bounds, how many it asks for, and what is known of the kth
WINDOW = "anchor_id long, positive_id long, own boolean, low long, high long, need long, prefix long"


def participants(vectors: DataFrame, move: bool = True) -> DataFrame:
    """`vectors(vec_id, embedding, label)` -> (vec_id, label, v) of the rows that take part; `move`: every 7th has the next label."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label) if move else label
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = vectors.where(FIT).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.*")


def _packed(size: int):
    """Rows (vec_id, label, v) -> blocks of at most `size` of one width: number, width, rows, and ids, labels and vectors as little-endian bytes."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])

    def block(held: dict, d: int) -> pa.RecordBatch:
        ids, labels, v = (np.concatenate(x) for x in zip(*held.pop(d)))
        row = [0, d, len(ids), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), v.astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            dims = b.column(2).value_lengths().to_numpy()
            table = pa.Table.from_batches([b])
            for d in np.unique(dims).tolist():
                part = table.filter(pa.array(dims == d)).combine_chunks()
                ids, labels, v = part["vec_id"].to_numpy(), part["label"].to_numpy(), part["v"].combine_chunks().flatten().to_numpy().reshape(len(part), d)
                for lo in range(0, len(ids), size):
                    cut = slice(lo, lo + size)
                    if d in held and sum(len(x[0]) for x in held[d]) + len(ids[cut]) > size:
                        yield block(held, d)
                    held.setdefault(d, []).append((ids[cut], labels[cut], v[cut]))
        for d in sorted(held):
            yield block(held, d)

    return run


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """The blocks of `rows`, stored, numbered from 0 on within their width."""
    made = stored(rows.mapInArrow(tidy(_packed(size)), BLOCKS), f"{name}-packed", size)
    sizes = made.select("dim", "n", "ids")  # one row a block: few numbers for each thousands of vectors
    numbered = sizes.select("dim", "ids", (F.row_number().over(Window.partitionBy("dim").orderBy("ids")) - 1).cast("long").alias("block"))
    return stored(made.drop("block").join(numbered, ["dim", "ids"]).select("block", "dim", "n", "ids", "labels", "vectors"), name)


def _unpacked(dim: int, ids: bytes, labels: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<i4").reshape(-1, dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers."""
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Scored:
    """Scores of a block of anchors in a block of rows; `within`: the rows of a window and their distances from its upper end."""

    def __init__(self, anchors: tuple, rows: tuple):
        (self.anchor_ids, self.anchor_labels, a), (self.ids, self.labels, b) = anchors, rows
        self.at = {i: k for k, i in enumerate(self.anchor_ids.tolist())}
        self.scores = inner(a, b)
        self.own = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.anchor_labels).tolist()}
        self.others = {x: np.flatnonzero(self.labels != x) for x in self.own}

    def within(self, anchor: int, own: bool, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.at[anchor]
        rows = (self.own if own else self.others)[int(self.anchor_labels[k])]
        away = high - self.scores[k][rows]
        hit = (away >= 0) & (away <= high - low)
        if own:
            hit &= self.ids[rows] != anchor
        return rows[hit], away[hit]


WINDOWS = ("anchor_id", "positive_id", "own", "low", "high", "need", "prefix")


def _grid(windows: DataFrame, anchors: DataFrame, rows: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """Each pair of a block of anchors, with its windows, and a block of rows of its width."""
    asked = windows.groupBy("anchors").agg(F.collect_list(F.struct(*WINDOWS)).alias("windows"))  # at most POSITIVES for each of the ANCHORS of a block
    left = anchors.select("dim", F.concat_ws("-", "dim", "block").alias("anchors"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"))
    number = F.element_at(F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv)), F.col("dim"))
    sent = left.join(asked, "anchors").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), number.cast("long") - 1)))
    return sent.join(rows, ["dim", "block"]).select("dim", "a_ids", "a_labels", "a_vectors", "ids", "labels", "vectors", "windows")


def _pairs(batches):
    """Rows of the grid -> (scores, windows as a struct array)."""
    for b in batches:
        for r in range(b.num_rows):
            dim, *parts = (b.column(c)[r].as_py() for c in range(7))
            yield Scored(_unpacked(dim, *parts[:3]), _unpacked(dim, *parts[3:])), [list(w.values()) for w in b.column(7)[r].as_py()]


def _counted(shift: int):
    """Histograms of the digit at `shift` in each window, added up over what a task is given (at most HELD at a time)."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])

    def rows(held: dict):
        keys, counts = np.array(list(held), np.int64).reshape(-1, 2), np.stack(list(held.values()))
        w, d = np.nonzero(counts)
        for lo in range(0, len(w), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[w[part], 0]), pa.array(keys[w[part], 1]), pa.array(d[part], pa.int32()), pa.array(counts[w[part], d[part]])], schema=schema)

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for scored, windows in _pairs(batches):
            for anchor, positive, own, low, high, _, prefix in windows:
                away = scored.within(anchor, own, low, high)[1]
                digits = (away[away >> (shift + DIGIT) == prefix] >> shift) & (BASE - 1)
                if len(digits):
                    key = anchor, positive
                    if key not in held:
                        held[key] = np.zeros(BASE, np.int64)
                    held[key] += np.bincount(digits, minlength=BASE)
            if len(held) >= HELD:
                yield from rows(held)
                held = {}
        if held:
            yield from rows(held)

    return run


def _gathered(batches):
    """(anchor_id, positive_id, found_id, score) of the scores up to the kth (`prefix`) of each window; of a block's no more than asked for, best first."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])
    for scored, windows in _pairs(batches):
        out: list[list] = [[] for _ in schema]
        for anchor, positive, own, low, high, need, prefix in windows:
            rows, away = scored.within(anchor, own, low, high)
            best = np.flatnonzero(away <= prefix)
            best = best[np.lexsort((scored.ids[rows[best]], away[best]))][:need]
            for column, values in zip(out, ([anchor] * len(best), [positive] * len(best), scored.ids[rows[best]].tolist(), (high - away[best]).tolist())):
                column += values
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def select(windows: DataFrame, anchors: DataFrame, rows: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """`windows(anchors, anchor_id, positive_id, own, low, high)` -> their first `k` rows: (anchor_id, positive_id, found_id, score, rank)."""
    state = stored(windows.where("low <= high").withColumns({"need": F.lit(k).cast("long"), "prefix": F.lit(0).cast("long")}), "windows", AT_ONCE)
    widest = state.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    whole = None  # windows that hold fewer than k
    for shift in range(max(0, -(-widest.bit_length() // DIGIT) - 1) * DIGIT, -1, -DIGIT):
        counts = _grid(state, anchors, rows, blocks).mapInArrow(tidy(_counted(shift)), "anchor_id long, positive_id long, digit int, n long").groupBy("anchor_id", "positive_id", "digit").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor_id", "positive_id").orderBy("digit")))
        hit = F.min(F.when(F.col("upto") >= F.col("need"), F.struct("digit", (F.col("upto") - F.col("n")).alias("before")))).alias("hit")
        known = _stored(state.join(upto, ["anchor_id", "positive_id"]).groupBy(*state.columns).agg(hit), "digits")
        if whole is None:  # only the first digit can show that a window holds too few
            whole = known.where("hit IS NULL").drop("hit").withColumn("prefix", F.col("high") - F.col("low"))
        state = known.where("hit IS NOT NULL").select(*[c for c in state.columns if c not in ("need", "prefix")], (F.col("need") - F.col("hit.before")).alias("need"), (F.col("prefix") * BASE + F.col("hit.digit")).alias("prefix"))
    final = state.unionByName(whole).withColumn("need", F.lit(k).cast("long"))
    found = _stored(_grid(final, anchors, rows, blocks).mapInArrow(tidy(_gathered), "anchor_id long, positive_id long, found_id long, score long"), "gathered")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _stored(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name, AT_ONCE)


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """`vectors(vec_id, embedding, label)` -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    shared_dir(spark)
    members = stored(participants(vectors), "members")
    rows = packed(members, ROWS, "rows")
    anchors = packed(members.where(F.col("vec_id") % ANCHOR_EVERY == 0), ANCHORS, "anchors")
    blocks = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one number a width
    if not blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # |score| <= |anchor| * |row|, so a window of that reach holds all
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = members.agg(F.max(length)).first()[0]
    in_block = anchors.select(F.concat_ws("-", "dim", "block").alias("anchors"), "ids").mapInArrow(_ids, "anchors string, anchor_id long")
    reach = F.ceil(F.col("length") * longest * 1.000001) + 1
    asked = in_block.join(members.select(F.col("vec_id").alias("anchor_id"), length.alias("length")), "anchor_id").select("anchors", "anchor_id", F.lit(-1).cast("long").alias("positive_id"), F.lit(True).alias("own"), (-reach).cast("long").alias("low"), reach.cast("long").alias("high"))
    found = stored(select(asked, anchors, rows, blocks, positives), "positives", AT_ONCE)
    score = F.col("score")
    low = F.ceil(score.cast("decimal(38,0)") * LOWEST / OF).cast("long")
    windows = found.join(in_block, "anchor_id").select("anchors", "anchor_id", F.col("found_id").alias("positive_id"), F.lit(False).alias("own"), low.alias("low"), score.alias("high"))
    hard = select(windows, anchors, rows, blocks, negatives)
    out = hard.join(found.select("anchor_id", F.col("found_id").alias("positive_id"), score.alias("positive_score")), ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", score.alias("negative_score"))


def _ids(batches):
    for b in batches:
        for name, ids in zip(b.column(0).to_pylist(), b.column(1)):
            found = np.frombuffer(ids.as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found)], names=["anchors", "anchor_id"])


SQL = f"""
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.own WHERE {LOWEST} * positive_score <= {OF} * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
