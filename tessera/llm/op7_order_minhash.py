"""MinHash near-dedup by order MinHash.

A text is its sequence of lower-cased words. Sketches see it as runs (k-mers) of five words; each run is labelled with its
occurrence number, so repeated runs count as often as they stand. One sketch takes the `PICK` labelled runs of
least hash and hashes them *in the order of the text*: two texts agree on it if they share those runs in that
order, so the sketch follows edit similarity and not only the set of runs. `TABLES` sketches are the bands.

Candidates are verified by alignment of the two word sequences: similarity = matched words / (words of both - matched), at
least `SIMILARITY`. The alignment is the longest common subsequence within a diagonal band, bit-parallel, in windows that slide
along the band, so memory is linear in the text and the band; the band is widened until the alignment found in it is the best.

Texts with the same words are one class, represented by its smallest doc_id; only representatives are compared.
Within a bucket two leaders, the smallest doc_id and the shortest text, are verified against the others first: in a bucket
of texts around a shared passage the shortest is nearest to it. Links join components. Members of
buckets that then still hold several components, and all texts of at most `SHORT` words, whose few runs are no ground for
sketches, are joined exactly, by a prefix filter on their rarest words (`_rest`), and verified as well. So every similar pair
that shares a bucket ends in one component, and every similar pair of short texts: no bucket is capped, and none is expanded
into pairs. Two texts that share a share s of their runs meet in no bucket with a probability of about (1 - s^3)^24: 4 % at 0.5
(a text with one word in nine changed has at least that), 0.2 % at 0.6, nothing to speak of at 0.8. `tests/llm` measures the recall.

Nulls and edge cases: a null, empty or wordless text has no near copies (each such row is a class of its own); rows that
repeat a doc_id are one node: it links by any of its texts, and every such row gets the same class_id; a null doc_id links with
nothing and is kept; very long texts are read whole; further columns pass through `dedup` untouched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, block_pairs, connected_components, groups_of, shared_dir, shingle_hashes, splitmix, stored, tidy

RUN, PICK, TABLES, SIMILARITY, SHORT = 5, 3, 24, 0.8, 24
BROADCAST_IDS = 1_000_000
#: pairs of texts that a task is given at once: each row has both
PAIRS = 128
#: counters of how many texts have a word
SLOTS = 1 << 20
#: texts of a run from which they meet in blocks, and texts of a block
HOT, BLOCK = 512, 1024
#: columns of an alignment between two moves of its window; the narrowest band
STEP, NARROW = 64, 32
WORD = re.compile(r"\w+")
SKETCH = "doc_id long, class string, words int, bands array<long>"
LINK = "a long, b long, similarity double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hasher:
    """The words of a text as numbers; remembers words up to a bound."""

    def __init__(self):
        self.memo = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def __call__(self, words: list[str]) -> np.ndarray:
        self.memo.trim()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def run_hashes(words: np.ndarray) -> np.ndarray:
    return shingle_hashes(words, RUN)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Each hash mixed with how often it stood before."""
    order = np.argsort(runs, kind="stable")
    s = runs[order]
    start = np.r_[True, s[1:] != s[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
    times = np.empty(len(s), np.uint64)
    times[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return splitmix(runs ^ splitmix(times))


SEEDS = splitmix(np.arange(1, TABLES + 1, dtype=np.uint64))


def sketch(runs: np.ndarray) -> np.ndarray:
    """One value per table: the hash of the `PICK` least labelled runs in text order."""
    base = labelled(runs)
    n = min(PICK, len(base))
    if len(base) > 4096:  # the least runs of a long text, table by table, to keep the matrix small
        at = np.stack([np.argpartition(splitmix(base ^ s), n - 1)[:n] for s in SEEDS])
    else:
        mixed = splitmix(base[None, :] ^ SEEDS[:, None])
        at = np.argpartition(mixed, n - 1, axis=1)[:, :n] if len(base) > n else np.tile(np.arange(n), (TABLES, 1))
    at.sort(axis=1)
    picked, out = base[at], SEEDS.copy()
    for i in range(n):
        out = splitmix(out ^ picked[:, i])
    return out.view(np.int64)


def sketches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.string()), ("words", pa.int32()), ("bands", pa.list_(pa.int64()))])
    hashed = Hasher()
    for b in batches:
        ids, classes, counts, bands = [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = words_of(text.as_py())
            if i is None or not words:
                continue
            ids.append(i)
            classes.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            counts.append(len(words))
            bands.append(sketch(run_hashes(hashed(words))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.string()), pa.array(counts, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences by banded alignment; 0 if it is below `least`."""
    n, m = len(a), len(b)
    if n > m:
        a, b, n, m = b, a, m, n
    if not n or n < least * m:
        return 0.0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))  # matches needed
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need:
        return 0.0
    # what both begin and end with is aligned
    other = np.flatnonzero(a != b[:n])
    start = int(other[0]) if len(other) else n
    other = np.flatnonzero(a[start:] != b[m - n + start :])
    end = n - start - 1 - int(other[-1]) if len(other) else n - start
    matched = start + end
    inner, most = (a[start : n - end], b[start : m - end]), n + m - 2 * need  # words that may stay unmatched, so the furthest diagonal
    band = min(NARROW, most)
    while len(inner[0]):
        got = _banded(*inner, band)
        if n + m - 2 * (matched + got) <= band or band == most:  # an alignment this good never leaves the band
            matched += got
            break
        band = min(4 * band, most)
    found = matched / (n + m - matched)
    return found if found >= least - 1e-12 else 0.0


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of pairs (i, j) with |i - j| <= band.

    Bit-parallel over the rows i of a window that moves on every STEP columns j; a 0 is a row matched so far. Rows above the
    window have not been met and those below it are settled, so only the window is kept.
    """
    order = np.argsort(a, kind="stable")
    ranked, order = a[order], order.tolist()
    los, his = np.searchsorted(ranked, b, "left").tolist(), np.searchsorted(ranked, b, "right").tolist()
    width = 2 * band + STEP
    full, lane, gone = (1 << width) - 1, (1 << 2 * band + 1) - 1, (1 << STEP) - 1
    v, matched = full, 0
    for first in range(0, len(b), STEP):
        base, masks = first - band, {}
        for j in range(first, min(first + STEP, len(b))):
            lo, hi = los[j], his[j]
            if lo == hi:
                continue
            mask = masks.get(lo)
            if mask is None:
                at = order[bisect_left(order, base, lo, hi) : bisect_left(order, base + width, lo, hi)]
                mask = masks[lo] = _bits(at, base, width) if len(at) > 8 else sum(1 << i - base for i in at)
            if hits := v & mask & lane << j - first:
                v = ((v + hits) | (v - hits)) & full
        matched += STEP - (v & gone).bit_count()
        v = v >> STEP | gone << width - STEP
    return matched + width - v.bit_count()


def _bits(at: list[int], base: int, width: int) -> int:
    """A number of `width` bits with those set that stand for the rows `at`."""
    bits = np.zeros(width, np.uint8)
    bits[np.array(at) - base] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def verify(batches):
    """Rows are pairs with both texts, sorted by the first: its words are kept while it stays the same."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    last, words, hashed = None, None, Hasher()
    for batch in batches:
        out = ([], [], [])
        for a, b, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            text = left.as_py()
            if (a, text) != last:
                last, words = (a, text), hashed(words_of(text))
            if found := aligned(words, hashed(words_of(right.as_py()))):
                out[0].append(a)
                out[1].append(b)
                out[2].append(found)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most BROADCAST_IDS (16 MB); a shuffled join takes more."""
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`pairs(a, b)` and `texts(doc_id, text)` -> the links among them, stored."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = stored(texts.join(_small(needed), "doc_id", "left_semi"), "texts")
    left = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    both = left.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    return stored(both.select("a", "b", "left", "right").mapInArrow(tidy(verify), LINK).distinct(), "links", PAIRS)


def _word_counts(batches):
    """In how many of a task's texts a word of each slot stands."""
    hashed, held = Hasher(), np.zeros(SLOTS, np.int64)
    for b in batches:
        for t in b.column(0):
            if words := words_of(t.as_py()):
                held[np.unique(labelled(hashed(words)) % np.uint64(SLOTS)).astype(np.int64)] += 1
    slots = np.flatnonzero(held)
    for lo in range(0, len(slots), 100_000):
        part = slots[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(held[part])], names=["slot", "n"])


def _prefixes(counts):
    """The rarest words of each text that a similar text must share one of, but for those of one text alone."""

    def run(batches):
        seen, hashed = counts.value, Hasher()
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # a few MB at a time
                part, rows = b.slice(lo, 256), []
                for i, t, component in zip(*(part.column(c).to_pylist() for c in range(3))):
                    if not (found := words_of(t)):
                        continue
                    words = labelled(hashed(found))
                    docs = seen[(words % np.uint64(SLOTS)).astype(np.int64)]
                    n = len(words)
                    order = np.lexsort((words, docs))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
                    place = np.flatnonzero(docs[order] > 1)
                    rows.append((i, component, n, place, words[order][place], docs[order][place]))
                if not rows:
                    continue
                size = [len(r[3]) for r in rows]
                ids, components, n = (np.repeat(np.array([r[c] for r in rows], np.int64), size) for c in range(3))
                place, words, docs = (np.concatenate([r[c] for r in rows]) for c in (3, 4, 5))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(components), pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(words.view(np.int64)), pa.array(docs, pa.int64())], names=["doc_id", "component", "n", "place", "word", "docs"])

    return run


#: matches that two texts of n and m words need, whose words at places i and j of their rarest are the first that agree
FITS = f"least({{x}}n - {{x}}place, {{y}}n - {{y}}place) >= {SIMILARITY} * ({{x}}n + {{y}}n) / {1 + SIMILARITY} - 1e-6"


def _hot_pairs(batches):
    """Rows of two blocks of texts with one word -> the pairs that FITS keeps."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for t in groups_of(batches, ["word", "i", "j"]):
        ids, component, n, place, side, i, j = (t[c].to_numpy() for c in ("doc_id", "component", "n", "place", "side", "i", "j"))
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if i[0] != j[0] else (np.arange(len(ids)),) * 2
        room = n - place
        for lo in range(0, len(left), 256):
            x = left[lo : lo + 256, None]
            fits = (np.minimum(room[x], room[right]) >= SIMILARITY * (n[x] + n[right]) / (1 + SIMILARITY) - 1e-6) & (component[x] != component[right]) & ((ids[x] < ids[right]) | (i[0] != j[0]))
            p, q = np.nonzero(fits)
            a, b = ids[x[p, 0]], ids[right[q]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)


def _rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of `members(doc_id, component)` in different components that may reach SIMILARITY, by prefix filter.

    The words of a text are ordered by how many of the members have one of their slot (SLOTS counters, a few MB, so they are
    broadcast): any order that is the same for all texts will do, and this one puts rare words first. Two texts that reach the
    threshold share one of the first fifth and one more, so a passage that many texts share fetches nothing unless texts consist
    of it, and only that fifth becomes rows. Where the words at places i and j of two texts are the first that agree, at most
    min(n - i, m - j) can: pairs that cannot reach the threshold are dropped in the join. Texts that share a word of a slot with
    more than HOT texts meet in pairs of blocks, so no task holds all of them and pairs that do not fit are never rows.
    """
    # members of hot buckets stand near each other where they were read: dealt anew, every task has about as many of their words
    own = stored(texts.join(_small(members), "doc_id").select("doc_id", "text", "component").repartition("doc_id"), "texts")
    found = own.select("text").mapInArrow(tidy(_word_counts), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 1 << 30)
    shared = own.sparkSession.sparkContext.broadcast(counts)
    prefix = stored(own.mapInArrow(tidy(_prefixes(shared)), "doc_id long, component long, n int, place int, word long, docs long"), "prefixes")
    few, hot = prefix.where(f"docs <= {HOT}").drop("docs"), prefix.where(f"docs > {HOT}").drop("docs")
    sizes = hot.groupBy("word").agg(F.count("*").alias("docs")).where("docs > 1")
    pairs = few.alias("x").join(few.alias("y"), "word").where("x.doc_id < y.doc_id AND x.component <> y.component").where(FITS.format(x="x.", y="y.")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    blocks = block_pairs(hot.join(sizes, "word"), "doc_id", "docs", BLOCK).select("word", "i", "j", "side", "doc_id", "component", "n", "place")
    return pairs.union(blocks.repartition("word", "i", "j").sortWithinPartitions("word", "i", "j").mapInArrow(tidy(_hot_pairs), "a long, b long")).distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(doc_id, class_id)` of every doc_id that has words, and the verified links between representatives."""
    spark = docs.sparkSession
    shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stored(texts.mapInArrow(tidy(sketches), SKETCH), "sketches")
    # each class once; a doc_id with several texts is in several classes and ties them together
    reps = stored(made.groupBy("class").agg(F.min(F.struct("doc_id", "words", "bands")).alias("s")).select("class", "s.*"), "classes")
    ones = made.groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    torn = made.join(ones.where("class <> last").select("doc_id"), "doc_id", "left_semi").join(reps.select("class", F.col("doc_id").alias("rep")), "class").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    bands = reps.select("doc_id", "words", F.posexplode("bands").alias("t", "band"))
    # buckets of one need no work: they are found by counts alone
    shared = bands.groupBy("t", "band").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "words")).alias("least"), F.min(F.struct("words", "doc_id")).alias("short")).where("n > 1")
    members = stored(bands.join(shared, ["t", "band"]), "members")

    def led(leader: str) -> DataFrame:
        """Pairs of a leader and the members that are not too unlike in length."""
        a, n = F.col(f"{leader}.doc_id"), F.col(f"{leader}.words")
        near = F.least("words", n) >= F.lit(SIMILARITY) * F.greatest("words", n)
        return members.where((F.col("doc_id") != a) & near).select(F.least("doc_id", a).alias("a"), F.greatest("doc_id", a).alias("b"))

    first = led("least").union(led("short")).distinct().checkpoint()
    links = _verified(first, texts)
    parts = connected_components(links.select("a", "b").union(torn))
    # what the leaders did not settle: members of buckets that hold several components, and short texts
    placed = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = placed.groupBy("t", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("t", "band")
    brief = reps.where(f"words <= {SHORT}").select("doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    left = placed.join(open_, ["t", "band"], "left_semi").select("doc_id", "component").union(brief).distinct()
    rest = _rest(left, texts).join(first, ["a", "b"], "left_anti").checkpoint()
    links = links.union(_verified(rest, texts))
    parts = connected_components(links.select("a", "b").union(torn))
    named = reps.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("class", F.coalesce("component", "doc_id").alias("class_id"))
    return ones.select("doc_id", "class").join(named, "class").select("doc_id", "class_id"), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, class_id (smallest doc_id of its group) and kept (doc_id = class_id)."""
    found, _ = classes(docs)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id")))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but for those whose group is represented by another doc_id; all columns stay."""
    found, _ = classes(docs)
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
