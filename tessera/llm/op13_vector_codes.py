"""Vector code compression: product codes whose nearest entries are screened in float32 and settled in int64.

A vector of integers floor(256 * x) is cut into `PARTS` equal parts; each part's code is the nearest of its codebook's at most
`ENTRIES` entries by squared Euclidean distance, ties to the lower index. A task compares a batch with all entries by one float32
matrix product per part: |c|^2 - 2 x.c. Each such value has a rigorous interval: a float32 product of m terms errs by
at most g = (m + 6) u / (1 - (m + 6) u), u = 2^-24, times the sum of the terms' magnitudes, the roundings of the operands, of |c|^2
and of the difference included, and that sum is at most |c|^2 + 2 |x| |c| (Cauchy-Schwarz; computed in float64 and widened).
Only entries whose interval overlaps the one with the least upper end are evaluated again, in int64, and the least distance, then
the least index, wins. So the codes are exact whatever the float32 arithmetic did, and for most parts one or two entries are left.

Codebooks start as the parts of the smallest vec_ids and are replaced in `ROUNDS` rounds by floor(sum / count) of their parts; an
unused entry stays. They are `ENTRIES` vectors, so they are broadcast and their sums collected (64 times the width); everything else stays in tasks: sums
are added up in each task before they are shuffled.

Nulls and edge cases: a vector that is null, empty, or holds null or non-finite components is dropped, and so is one with a length
of 2^22 or more (squared distances would not fit 64 bits), one whose width is no multiple of PARTS, and one of another width than the smallest
kept vec_id has; rows that repeat a vec_id are coded each, and start codebooks in order of vector and label; a null vec_id is coded and
starts none; with fewer than ENTRIES rows there are fewer entries; null labels count together; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, stored, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: vectors that are compared at once
ROWS = 2048
#: with such sums of squares no squared distance reaches 2^62
FIT = f"size(embedding) > 0 AND size(embedding) % {PARTS} = 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)) AND aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)) < {float(1 << 60) / SCALE**2}"


def whole(vectors: DataFrame) -> DataFrame:
    """`vectors(vec_id, embedding, label)` -> the rows that are coded, stored: vec_id, label, v (floor of SCALE times each component)."""
    sound = vectors.where(FIT).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))
    kept = stored(sound, "whole")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    return kept.where(F.size("v") == (first[0] if first else PARTS))


@dataclass
class Codebooks:
    """`entries`: parts x entries x width of a part, int64."""

    entries: np.ndarray

    def __post_init__(self):
        c = self.entries.astype(np.float64)
        self.norm = (c * c).sum(axis=2)
        self.length = np.sqrt(self.norm)
        self.turned = np.ascontiguousarray(self.entries.astype(np.float32).transpose(0, 2, 1))

    def screened(self, x: np.ndarray) -> np.ndarray:
        """For parts x rows x width of int64: which entries may be nearest, parts x rows x entries."""
        m = x.shape[2]
        u = 2.0**-24
        g = (m + 6) * u / (1 - (m + 6) * u)
        value = self.norm.astype(np.float32)[:, None, :] - np.float32(2) * np.matmul(x.astype(np.float32), self.turned)
        size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=2))
        slack = g * (1 + 1e-9) * (self.norm[:, None, :] + 2 * size[:, :, None] * self.length[:, None, :])
        value = value.astype(np.float64)
        return value - slack <= (value + slack).min(axis=2, keepdims=True)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), parts x rows, exact."""
        part, row, entry = np.nonzero(self.screened(x))  # in this order, so the first of the least is the lowest index
        away = x[part, row] - self.entries[part, entry]
        distance = (away * away).sum(axis=1)
        start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
        least = np.minimum.reduceat(distance, start)
        hit = np.flatnonzero(distance == np.repeat(least, np.diff(np.r_[start, len(distance)])))
        _, at = np.unique(part[hit] * x.shape[1] + row[hit], return_index=True)
        return entry[hit[at]].reshape(x.shape[:2]), least.reshape(x.shape[:2])

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def cut(v: pa.Array, width: int) -> np.ndarray:
    """Lists of integers -> parts x rows x width of a part, int64."""
    rows = v.flatten().to_numpy().astype(np.int64).reshape(len(v), PARTS, width // PARTS)
    return np.ascontiguousarray(rows.transpose(1, 0, 2))


def started(kept: DataFrame) -> Codebooks | None:
    """The parts of the ENTRIES smallest vec_ids; None without any."""
    first = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "v", "label").limit(ENTRIES).select("v").collect()
    if not first:  # vec_ids are all null
        return None
    v = np.array([r.v for r in first], np.int64)
    return Codebooks(np.ascontiguousarray(v.reshape(len(v), PARTS, -1).transpose(1, 0, 2)))


def replaced(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    parts, entries, w = books.entries.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own, sums, counts = shared.value, np.zeros((parts * entries, w), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                x = cut(b.column(0)[lo : lo + ROWS], parts * w)
                at = (own.nearest(x)[0] + np.arange(parts)[:, None] * entries).ravel()
                counts += np.bincount(at, minlength=len(counts))
                np.add.at(sums, at, x.reshape(-1, w))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, w), pa.int32()), pa.array(np.tile(np.arange(w), len(used)), pa.int32()), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], w))], names=["entry", "pos", "total", "n"])

    found = kept.select("v").mapInArrow(tidy(run), "entry int, pos int, total long, n long").groupBy("entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    new = books.entries.reshape(-1, w).copy()
    new[found["entry"].to_numpy(), found["pos"].to_numpy()] = found["total"].to_numpy() // found["n"].to_numpy()  # floors
    return Codebooks(new.reshape(books.entries.shape))


def codes(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every kept row."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, _, w = books.entries.shape
    label = kept.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                code, away = shared.value.nearest(cut(part.column(2), parts * w))
                text = [c.hex() for c in np.ascontiguousarray(code.T.astype(np.uint8)).view(f"V{parts}").ravel().tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(away.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    return stored(kept.select("vec_id", "label", "v").mapInArrow(tidy(run), f"vec_id long, label {label}, code string, error long"), "codes")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per coded row of `vectors`: vec_id, code, error, label_error, codebooks_sha256."""
    shared_dir(vectors.sparkSession)
    kept = whole(vectors)
    books = started(kept)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        books = replaced(kept, books)
    coded = codes(kept, books)
    per = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(per, coded["label"].eqNullSafe(per["__label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    def assigned(step: int) -> str:
        return f"""
n{step} AS (SELECT r, x.part, entry, sum((x.v - c.v) * (x.v - c.v)) AS dist FROM x JOIN c{step} c ON x.part = c.part AND x.pos = c.pos GROUP BY r, x.part, entry),
a{step} AS (SELECT r, part, entry, dist FROM n{step} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY dist, entry) = 1)"""

    def moved(step: int) -> str:
        return f"""
s{step} AS (SELECT a.part, a.entry, x.pos, CAST(floor(sum(x.v)::DOUBLE / count(*)) AS BIGINT) AS v FROM a{step} a JOIN x ON a.r = x.r AND a.part = x.part GROUP BY a.part, a.entry, x.pos),
c{step + 1} AS (SELECT c.part, c.entry, c.pos, coalesce(s.v, c.v) AS v FROM c{step} c LEFT JOIN s{step} s ON c.part = s.part AND c.entry = s.entry AND c.pos = s.pos)"""

    steps = ",".join(assigned(i) + "," + moved(i) for i in range(ROUNDS))
    return f"""
WITH k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT r, len(embedding) // {PARTS} AS w, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS y FROM k),
x AS (SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT) AS v FROM u),
c0 AS (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= {ENTRIES}),{steps},{assigned(ROUNDS)},
e AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN k USING (r)
"""


SQL = _sql()
