"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their first 4 letters (marked), so inflected and compounded forms meet. `fit` takes the
`MOST_EXAMPLES` labelled documents of least hash (a documented bound, as a text is compared with all of them; fewer labels are all taken). Every term of their whole
texts is in the index and none is dropped. A term weighs (1 + log count) x idf; document frequencies are counted
over all documents. Vectors have length 1, so the similarity is the cosine of TF-IDF vectors: no label has a part in it.

The postings of a term lie in blocks of `BLOCK` examples, each block with its largest weight. A query bounds every block by the
sum of its terms' largest weights there, scores the blocks of the largest bounds first, and of the others those whose bound
reaches the k-th best similarity so far; all exactly, so the k nearest are exact. Terms that an eighth of the examples have are a matrix instead: nearly every block has them, so they
would prune nothing. Examples as similar as the k-th (to nine places) all vote: no number and no doc_id decides. Texts are compared
together, as many as hold about `HELD` numbers: their rows are arrays, one after the other, and no step is taken text by text.

Labels speak in the votes. A neighbour's vote weighs the square of a second cosine, in which each term counts by its
relevance as well: from `LEAST_RELEVANCE`, for terms that stand about as often in either kind of example (a chi-square below `LEAST_CHI_SQUARE`), to
1, for terms whose presence depends on the label (the square of chi-square / `CHI_SQUARE`, 1 at most). So neighbours that share no more than a text's topic say
little. Examples with exactly the text's terms count one less together, for every text alike: an example is not its own evidence, and the
isotonic regression that turns votes into scores is fitted on votes made in the same way. A text without a term has the calibrated score of no votes.

Each text is read once: its terms are stored as sparse rows, counted, then scored. What is collected and broadcast is bounded
by the examples: their terms and the index.

Nulls and edge cases: null, empty and wordless texts have no terms and the score of no votes; very long texts are read whole;
labels that are null or other than 0 and 1 are no examples, nor are documents without a label; rows that repeat a doc_id
are scored each; labels that repeat with different values count for the larger; with no example of either kind every score
is the share of toxic examples (0 without any); a null doc_id is scored and is never an example; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, give_back, parts, runs, stored, tidy

MOST_EXAMPLES, CHI_SQUARE, LEAST_CHI_SQUARE, LEAST_RELEVANCE, CLEAR = 1_500, 50.0, 4.0, 0.05, 0.5
NEAREST, BLOCK, FIRST_BLOCKS, PRIOR_VOTES, DECISION = 50, 64, 4, 0.5, 0.3
PREFIXES = (4,)
#: similarity, to nine places, of equal terms
ALIKE = 1 - 1e-9
WORD = re.compile(r"[^\W_]+")
#: texts that are compared with the examples together
QUERIES = 256
#: about how many numbers are held of the texts that are compared together
HELD = 1 << 20
#: tasks that compute the votes of the examples (at most MOST_EXAMPLES)
LEFT_OUT = 24


def terms_of(word: str) -> list[str]:
    """A lower-cased chunk between white space -> its words and their beginnings (`abcd^`)."""
    out = []
    for w in WORD.findall(word):
        out.append(w)
        out += [w[:k] + "^" for k in PREFIXES if len(w) > k]
    return out


def name_of(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of the slices [start, start + length), one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


@cache
def _in_words() -> np.ndarray:
    """Of every code point: whether it stands in words, as WORD has it."""
    return np.fromiter(map(str.isalnum, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


class Reader:
    """Texts -> (places of terms in the vocabulary, counts), as arrays of all texts' words."""

    def __init__(self, places: dict[str, int]):
        self.terms = max(1, len(places))
        self.known = []  # (length of a beginning, 0: whole words; spellings, places)
        for k in (0, *PREFIXES):
            found = {t[:-1] if k else t: at for t, at in places.items() if (t[-1] == "^" and len(t) == k + 1 if k else t[-1] != "^")}
            self.known.append((k, pa.array(found, pa.large_string()), np.fromiter(found.values(), np.int64, len(found))))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's terms begin, and the end of all; places, sorted by text; counts): what `terms_of` gives for the chunks of each."""
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer("\n".join(lowered).encode("utf-32-le"), "<u4")
        inside = _in_words()[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, length = edges[::2], edges[1::2] - edges[::2]
        spelt = codes[inside]
        wide = (spelt >= 0x80).astype(np.uint8)
        for least in (0x800, 0x10000):
            wide += spelt >= least
        ends = np.r_[0, np.cumsum(length + np.add.reduceat(wide, np.cumsum(length) - length, dtype=np.int64))]  # in bytes
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(spelt.tobytes().decode("utf-32-le").encode()))
        begins = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begins)))
        pairs = []
        for k, known, places in self.known:
            longer = length > k
            asked = pc.utf8_slice_codeunits(words.filter(pa.array(longer)), 0, k) if k else words
            at = pc.fill_null(pc.index_in(asked, value_set=known), -1).to_numpy(zero_copy_only=False)
            pairs.append(text[longer][at >= 0] * self.terms + places[at[at >= 0]])
        pairs, counts = np.unique(np.concatenate(pairs), return_counts=True)
        return np.r_[0, np.cumsum(np.bincount(pairs // self.terms, minlength=len(texts)))], pairs % self.terms, counts


@dataclass
class Index:
    """Examples as TF-IDF vectors of length 1: postings (example, count) by term; `ready` deals them in blocks with their largest weight."""

    names: np.ndarray  # of terms, sorted
    weight: np.ndarray  # idf of each term
    relevance: np.ndarray  # of each term, for the votes
    clear: dict[int, str]  # terms that depend on the label, as evidence
    labels: np.ndarray
    ids: np.ndarray
    term_at: np.ndarray | None = None
    example: np.ndarray | None = None
    count: np.ndarray | None = None
    built: tuple = ()

    def __getstate__(self):
        return self.__dict__ | {"built": ()}

    def vectors(self, at: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms of texts that begin at `at`; of length 1 by text."""
        w, text = (1 + np.log(counts)) * self.weight[terms], _texts(at)
        return w / np.sqrt(np.bincount(text, w * w, len(at) - 1))[text]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vectors(np.array([0, len(terms)]), terms, counts)

    def add(self, example: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> Index:
        """Rows of (example, term, count), in any order; kept in as few bytes as they need, for they are broadcast."""
        order = np.lexsort((example, terms))
        self.term_at = np.searchsorted(terms[order], np.arange(len(self.names) + 1)).astype(np.int32)
        self.example = example[order].astype(np.min_scalar_type(max(len(self.labels), 1)))
        self.count = counts[order].astype(np.min_scalar_type(int(counts.max(initial=0))))
        return self

    def ready(self) -> Index:
        """With weights, in blocks. Terms of an eighth of the examples or more are columns of a matrix, as its blocks hold nearly all of them;
        the postings of the others begin by term at blocks, which have a number, a largest weight and a place."""
        if not self.built:
            n, blocks = len(self.labels), -(-len(self.labels) // BLOCK)
            e, t = self.example.astype(np.intp), np.repeat(np.arange(len(self.names)), np.diff(self.term_at))
            w = (1 + np.log(self.count, dtype=np.float64)) * self.weight[t]
            w /= np.sqrt(np.bincount(e, w * w, n))[e]
            # for the votes: how long each example is when terms count by relevance, and its terms above the least (numbered), by example
            length, heard = np.sqrt(np.bincount(e, (w * self.relevance[t]) ** 2, n)), self.relevance > LEAST_RELEVANCE
            number = np.where(heard, np.cumsum(heard) - 1, -1)
            above = np.flatnonzero(heard[t])
            above = above[np.argsort(e[above], kind="stable")]
            rows = length, np.searchsorted(e[above], np.arange(n + 1)), number[t[above]], w[above] * (self.relevance[t[above]] ** 2 - LEAST_RELEVANCE**2), number, int(heard.sum())
            common = np.diff(self.term_at) >= max(1, n / 8)
            column = np.where(common, np.cumsum(common) - 1, -1)
            dense = np.zeros((blocks * BLOCK, int(common.sum())))
            dense[e[common[t]], column[t[common[t]]]] = w[common[t]]
            e, t, w = e[~common[t]], t[~common[t]], w[~common[t]]
            first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (e[1:] // BLOCK != e[:-1] // BLOCK)]) if len(e) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(w, first) if len(first) else w
            self.built = column, dense, np.searchsorted(t[first], np.arange(len(self.names) + 1)), e[first] // BLOCK, most, np.r_[first, len(e)], e, w, rows
        return self

    def sizes(self, at: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Of each text: about how many numbers are held to compare it."""
        column, dense, *_, rows = self.ready().built
        listed = np.where(column[terms] < 0, self.term_at[terms + 1] - self.term_at[terms], 0)
        return np.bincount(_texts(at), listed, len(at) - 1).astype(np.int64) + len(dense) + rows[-1]

    def similar(self, at: np.ndarray, terms: np.ndarray, vector: np.ndarray, k: int) -> np.ndarray:
        """Similarities of each text (row) and example, and of the room in the last block: exact, or 0 for some that are not among the k most similar."""
        column, dense, term_at, block, most, block_at, example, value, _ = self.ready().built
        texts, room, blocks, text = len(at) - 1, len(dense), len(dense) // BLOCK, _texts(at)
        rare = column[terms] < 0
        across = np.zeros((texts, dense.shape[1]))
        across[text[~rare], column[terms[~rare]]] = vector[~rare]
        common = across @ dense.T
        text, terms, vector = text[rare], terms[rare], vector[rare]
        length = term_at[terms + 1] - term_at[terms]
        entries, q, text = _spread(term_at[terms], length), np.repeat(vector, length), np.repeat(text, length)
        at_block = text * blocks + block[entries]
        by_block = common.reshape(texts, blocks, BLOCK)
        bound = by_block.max(axis=2, initial=0.0) + np.bincount(at_block, q * most[entries], texts * blocks).reshape(texts, blocks)

        def exact(chosen: np.ndarray) -> np.ndarray:
            """Similarities of the examples in the chosen blocks."""
            here = np.flatnonzero(chosen.ravel()[at_block])
            start = block_at[entries[here]]
            length = block_at[entries[here] + 1] - start
            at = _spread(start, length)
            sums = np.bincount(np.repeat(text[here] * room, length) + example[at], np.repeat(q[here], length) * value[at], texts * room)
            return np.round(sums.reshape(texts, room) + (by_block * chosen[:, :, None]).reshape(texts, room), 9)

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        sims = exact(first)
        rest = (bound >= _kth(sims, k)[:, None] - 1e-8) & ~first
        return sims + exact(rest) if rest.any() else sims

    def nearest(self, terms: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k most similar to one text and of all as similar as the k-th, best first."""
        sims = self.similar(np.array([0, len(terms)]), terms, vector, k)
        return _best(sims, _kth(sims, k))[1:]

    def neighbours(self, at: np.ndarray, terms: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, examples, similarities) of each text's NEAREST and of all as similar as the last of them, best first; one more if some have exactly these terms."""
        sims = self.similar(at, terms, vector, NEAREST + 1)
        return _best(sims, np.where(sims.max(axis=1, initial=0.0) < ALIKE, _kth(sims, NEAREST), _kth(sims, NEAREST + 1)))

    def votes(self, at: np.ndarray, terms: np.ndarray, vector: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each text: share of toxic neighbours weighted by the square of the cosine with relevances, drawn to the overall share; sums of sorted numbers, so that order does not matter.

        Those with exactly these terms count one less together, whatever their labels. Terms of the least relevance give that cosine their part of
        the similarity, so only the others are added up.
        """
        lengths, begin, term, value, number, heard = self.ready().built[-1]
        (text, found, sims), texts, of = near, len(at) - 1, _texts(at)
        own = np.sqrt(np.bincount(of, (vector * self.relevance[terms]) ** 2, texts))
        above = number[terms] >= 0
        across = np.zeros(texts * heard)
        across[of[above] * heard + number[terms[above]]] = vector[above]
        each = begin[found + 1] - begin[found]
        places = _spread(begin[found], each)
        shared = np.bincount(np.repeat(np.arange(len(found)), each), across[np.repeat(text * heard, each) + term[places]] * value[places], len(found)) + LEAST_RELEVANCE**2 * sims
        weight, alike = np.round(shared / (own[text] * lengths[found]), 9) ** 2, sims >= ALIKE
        n = np.bincount(text[alike], minlength=texts)
        weight[alike] *= (n[text[alike]] - 1) / n[text[alike]]
        prior, order = float(self.labels.mean()) if len(self.labels) else 0.0, np.lexsort((weight, text))
        text, weight, bad = text[order], weight[order], self.labels[found[order]] > 0
        return (PRIOR_VOTES * prior + np.bincount(text, weight * bad, texts)) / (PRIOR_VOTES + np.bincount(text, weight, texts))


def _texts(at: np.ndarray) -> np.ndarray:
    """Of each term: the text that it is in."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _kth(sims: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row (0 if there are fewer)."""
    return np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] >= k else np.zeros(len(sims))


def _best(sims: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of what is above 0 and not below its row's least, by row, largest first."""
    row, column = np.nonzero((sims > 0) & (sims >= least[:, None]))
    value = sims[row, column]
    order = np.lexsort((column, -value, row))
    return row[order], column[order], value[order]


@dataclass
class Scale:
    """Votes -> scores: isotonic regression of labels on the examples' votes; `silent` is the score of a text without terms."""

    votes: list[float]
    scores: list[float]
    silent: float

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray, silent: float) -> Scale:
        """Pool adjacent violators; equal votes are one pool."""
        x, at = np.unique(np.round(votes, 12), return_inverse=True)
        pools: list[list[float]] = []  # sum of votes, sum of labels, rows
        for v, y, n in zip(x.tolist(), np.bincount(at, labels).tolist(), np.bincount(at).tolist()):
            pools.append([v * n, y, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                a = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], a)]
        return cls([p[0] / p[2] for p in pools] or [0.0], [p[1] / p[2] for p in pools] or [silent], silent)

    def __call__(self, vote: float) -> float:
        x, y = self.votes, self.scores
        i = bisect_right(x, vote + 1e-12) - 1
        if i < 0:
            return y[0]
        if i + 1 == len(x):
            return y[-1]
        return y[i] + (y[i + 1] - y[i]) * (vote - x[i]) / (x[i + 1] - x[i]) if x[i + 1] > x[i] else y[i]


def relevance(bad_with: np.ndarray, good_with: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Of each term: how far its presence depends on the label, from LEAST_RELEVANCE to 1 (1 for all without both kinds)."""
    if not bad or not good:
        return np.ones(len(bad_with))
    n, seen = bad + good, bad_with + good_with
    chi = n * (bad_with * float(good) - good_with * float(bad)) ** 2 / np.maximum(seen * (n - seen) * float(bad) * good, 1)
    return LEAST_RELEVANCE + np.where(chi >= LEAST_CHI_SQUARE, (1 - LEAST_RELEVANCE) * np.minimum(1, chi / CHI_SQUARE) ** 2, 0.0)


EXAMPLE = "doc_id long, toxic int, terms array<string>, counts array<int>"


def examples(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """(doc_id, toxic, terms, counts) of at most `most` labelled documents that may be learnt from, stored."""
    fit = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = stored(fit.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def split(batches):
        for b in batches:
            terms, counts = [], []
            for text in b.column(2):
                found = pa.array(list(chain.from_iterable(map(terms_of, (text.as_py() or "").lower().split()))), pa.string()).value_counts()
                terms.append(found.field(0).to_pylist())
                counts.append(found.field(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "counts"])

    return stored(texts.mapInArrow(tidy(split), EXAMPLE), "examples")


def features(docs: DataFrame, places: dict[str, int]) -> DataFrame:
    """`(doc_id, terms, counts)` of every row, stored: the index's terms in the whole text."""
    known = docs.sparkSession.sparkContext.broadcast(places)
    lists = pa.list_(pa.int32())

    def run(batches):
        read = Reader(known.value)
        for b in batches:
            for part in parts(b.column(1)):
                at, *found = read(b.column(1)[part.start : part.stop].to_pylist())
                columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in found]
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], *(c.cast(lists) for c in columns)], names=["doc_id", "terms", "counts"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, terms array<int>, counts array<int>"), "features")


def _documents_with(rows: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each term stands."""

    def count(batches):
        held, n = np.zeros(terms, np.int64), 0
        for b in batches:
            n += b.num_rows
            held += np.bincount(b.column(0).flatten().to_numpy(), minlength=terms)
        seen = np.flatnonzero(held)
        for lo in range(0, len(seen) + 1, 50_000):
            part = seen[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, part] if not lo else part, pa.int32()), pa.array(np.r_[n, held[part]] if not lo else held[part], pa.int64())], names=["term", "n"])

    found = rows.select("terms").mapInArrow(tidy(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 1, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()  # -1: the last
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> tuple[DataFrame, Broadcast, Scale]:
    """Features of all documents, the index of the examples, broadcast, and the scale of votes."""
    rows = examples(docs, labels, most)
    own = rows.toArrow().combine_chunks()
    labelled, sizes = own["toxic"].to_numpy().astype(np.float64), pc.fill_null(pc.list_value_length(own["terms"]), 0).to_numpy()
    spelt = own["terms"].combine_chunks().flatten().dictionary_encode()
    terms = spelt.dictionary.to_pylist()
    hashed = np.array([name_of(t) for t in terms], np.uint64)
    names, places = np.unique(hashed, return_inverse=True)
    term, counts, row = places[spelt.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64), own["counts"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    bad, good = int(labelled.sum()), int(len(labelled) - labelled.sum())
    depends = relevance(np.bincount(term, labelled[row], len(names)), np.bincount(term, 1 - labelled[row], len(names)), bad, good)
    featured = features(docs, dict(zip(terms, places.tolist())))
    n, seen = _documents_with(featured, len(names))
    weight = np.log((1 + n) / (1 + seen)) + 1
    clear = {int(places[i]): t for i, t in enumerate(terms) if depends[places[i]] >= CLEAR and bad and good}
    # examples that share their heaviest term stand together, so that blocks have tight maxima
    heaviest, sounding = np.full(len(sizes), -1), np.flatnonzero(sizes)
    by_weight = np.lexsort((term, weight[term] * (1 + np.log(counts)), row))
    heaviest[sounding] = term[by_weight[np.cumsum(sizes[sounding]) - 1]]
    order = np.lexsort((own["doc_id"].to_numpy(), heaviest))
    order = order[sizes[order] > 0]
    number = np.full(len(sizes), -1)
    number[order] = np.arange(len(order))
    index = Index(names, weight, depends, clear, labelled[order], own["doc_id"].to_numpy()[order]).add(number[row], term, counts)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    # examples without a term have no votes: what share of them is toxic
    silent_bad, silent_good = bad - int(index.labels.sum()), good - int(len(order) - index.labels.sum())
    silent = silent_bad / (silent_bad + silent_good) if silent_bad + silent_good else (bad / (bad + good) if bad + good else 0.0)
    return featured, shared, Scale.fit(_left_out(rows, shared, len(order)), index.labels, silent)


def _compared(index: Index, at: np.ndarray, terms: np.ndarray, counts: np.ndarray):
    """(text, example, similarity) of the neighbours of some texts at a time, numbered from 0, and these texts' votes."""
    for part in runs(index.sizes(at, terms), HELD):
        own = slice(at[part.start], at[part.stop])
        begin = at[part.start : part.stop + 1] - own.start
        vector = index.vectors(begin, terms[own], counts[own])
        near = index.neighbours(begin, terms[own], vector)
        yield *near, index.votes(begin, terms[own], vector, near)


def _left_out(rows: DataFrame, shared: Broadcast, examples: int) -> np.ndarray:
    """Each example's votes, in example order (bounded as the examples are)."""

    def run(batches):
        index = shared.value
        number = {i: e for e, i in enumerate(index.ids.tolist())}
        for b in batches:
            at = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False))]
            terms = np.searchsorted(index.names, np.array([name_of(t) for t in b.column(2).flatten().to_pylist()], np.uint64))
            votes = np.concatenate([np.zeros(0), *(v for *_, v in _compared(index, at, terms, b.column(3).flatten().to_numpy()))])
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array([number[i] for i in b.column(0).take(pa.array(some)).to_pylist()], pa.int32()), pa.array(votes[some])], names=["e", "vote"])

    found = rows.repartition(LEFT_OUT).mapInArrow(tidy(run), "e int, vote double").toArrow()
    out = np.zeros(examples)
    out[found["e"].to_numpy()] = found["vote"].to_numpy()
    return out


SCORE = "doc_id long, score double, vote double, neighbours array<struct<doc_id:long,similarity:double,toxic:int>>, evidence array<string>"


def score(rows: DataFrame, shared: Broadcast, scale: Scale) -> DataFrame:
    """Features -> calibrated score, with the nearest examples and the terms that speak of the label as evidence."""

    def run(batches):
        index = shared.value
        memo = Memo(None, 5_000)  # copies of a text are scored once
        speaks = np.zeros(len(index.names), bool)
        speaks[list(index.clear)] = True

        for b in batches:
            for lo in range(0, b.num_rows, QUERIES):
                memo.trim()
                part, keys, new = b.slice(lo, QUERIES), [], []
                ends = np.r_[0, np.cumsum(part.column(1).value_lengths().to_numpy())]
                terms, counts = (part.column(c).flatten().to_numpy() for c in (1, 2))
                for i, (start, end) in enumerate(pairwise(ends.tolist())):
                    keys.append(hashlib.blake2b(terms[start:end].tobytes() + counts[start:end].tobytes(), digest_size=16).digest())
                    if keys[-1] not in memo:
                        memo[keys[-1]] = None
                        new.append(i)
                own = _spread(ends[new], ends[np.array(new, int) + 1] - ends[new])
                at, terms, counts = np.r_[0, np.cumsum((ends[1:] - ends[:-1])[new])], terms[own], counts[own]
                evidence = [[] for _ in new]
                for i, term in zip(_texts(at)[speaks[terms]].tolist(), terms[speaks[terms]].tolist()):
                    evidence[i].append(index.clear[term])
                done = 0
                for text, found, sims, votes in _compared(index, at, terms, counts):
                    cut = np.searchsorted(text, np.arange(len(votes) + 1)).tolist()
                    for i, vote in enumerate(votes.tolist()):
                        result = min(1.0, max(0.0, scale(vote))) if at[done] < at[done + 1] else scale.silent
                        memo[keys[new[done]]] = result, vote, found[cut[i] : cut[i + 1]], sims[cut[i] : cut[i + 1]], sorted(evidence[done])
                        done += 1
                scores, votes, found, sims, evidence = zip(*map(memo.__getitem__, keys))
                near, at = np.concatenate(found), np.cumsum([0, *map(len, found)])
                columns = {"doc_id": pa.array(index.ids[near], pa.int64()), "similarity": pa.array(np.concatenate(sims), pa.float64()), "toxic": pa.array(index.labels[near].astype(np.int32))}
                neighbours = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + QUERIES], pa.array(scores, pa.float64()), pa.array(votes, pa.float64()), neighbours, pa.array(evidence, pa.list_(pa.string()))], names=["doc_id", "score", "vote", "neighbours", "evidence"])

    return rows.mapInArrow(tidy(run), SCORE)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, score, vote, neighbours, evidence, predicted (1 from DECISION on)."""
    fitted = fit(docs, labels)
    give_back()  # what the driver held of the examples
    return score(*fitted).withColumn("predicted", (F.col("score") >= DECISION).cast("int"))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: those whose crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns."""
    bad = toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["__bad"], "left_anti")
