"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The tokenizer is read from its public file: text is put in NFC, white space becomes one space, letters are lower-cased,
the text is cut into words (contractions, letter runs, single digits, other runs), each word's bytes are written in the
byte alphabet, and pairs are merged by rank, the last symbol carrying the word end. Its two special tokens are found in
the raw text first, as the library does.

`frequent_words` counts the words of all texts exactly: each task hands on its counts whenever it holds `FLUSH` of them, Spark
sums them, and the `LEXICON` most frequent words of at most `LONGEST` characters are compiled. The compiled form (`Lexicon`) is the
minimal deterministic automaton of the sorted words, so shared suffixes are stored once; every edge outputs the number of words
that sort before its target's, the sum along a word is its rank, and the rank addresses the word's ids. It is a flat file of
integers, written by each task from the broadcast bytes (about 7 MB, bounded by `LEXICON` and `LONGEST`) to an unnamed temporary
file and memory-mapped. The texts of about a MB are encoded together: their new words walk through the automaton side by side, a byte at a
time. A word outside it is merged exactly, in n log n steps for a word of n bytes. The lexicon only saves work:
results do not depend on it. Nothing outlives its task, and results leave it in batches of about `BATCH` bytes.

Decoding maps ids to the vocabulary's strings joined by a space, as the library does for a file without a decoder.

Nulls and edge cases: null and empty texts have no ids and decode to the empty text; very long texts and words are encoded
whole, very long texts one at a time; repeated rows and null doc_ids are rows like others; extra columns are ignored (`encode` keeps doc_id only).
"""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, give_back, parts, tidy

LEXICON, LONGEST, FLUSH, BATCH, NONE = 200_000, 48, 60_000, 4 << 20, 1 << 62
#: symbols from which a heap is faster than looking through all pairs
HEAP_FROM = 64
#: White space as the tokenizer's regular expressions have it; Python's `split` also takes 0x1C-0x1F.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CUT = regex.compile(rf"[{SPACE}]+")
ODD = regex.compile(r"[\x1c-\x1fΣ]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """What the file says: vocabulary, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.vocab: dict[str, int] = said["model"]["vocab"]
        self.end: str = said["model"]["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in said["model"]["merges"]]
        vocab = self.vocab
        #: pair of ids -> rank and merged id in one number, so that the least of them is the next merge
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.strings = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in (self.vocab | self.special).items():
            self.strings[i] = s
        self.symbols = [vocab[c] for c in byte_alphabet()]
        self.last = {vocab[c]: vocab[c + self.end] for c in byte_alphabet()}

    def merged(self, word: str) -> list[int]:
        """Exact merging: the leftmost pair of least rank first, until none is left."""
        ids = [self.symbols[b] for b in word.encode()]
        ids[-1] = self.last[ids[-1]]
        get = self.merges.get
        if len(ids) >= HEAP_FROM:
            return self._merged_long(ids)
        found = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while found and (least := min(found)) != NONE:
            i = found.index(least)
            ids[i] = least & 0xFFFFF
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(found):
                found[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same over linked symbols: a heap gives the next pair, and pairs that are no longer there are passed over."""
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapify(heap)
        while heap:
            m, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get(ids[i] << 20 | ids[k]):
                    heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := get(ids[h] << 20 | ids[i])):
                heappush(heap, (m, h))
        return [x for x in ids if x >= 0]


class Lexicon:
    """A minimal acyclic automaton over UTF-8 bytes with ranks as outputs and ids by rank; `lookup(word)` gives bytes or None."""

    MAGIC = b"LEX1"

    @staticmethod
    def compile(entries: dict[bytes, bytes]) -> bytes:
        """`entries`: word -> ids as little-endian unsigned 32-bit integers."""
        registry: dict[bytes, int] = {}
        states: list[bytes] = []  # whether a word ends there, then label and target of each edge
        words: list[int] = []  # reachable from each state

        def settle(final: bool, edges: list[tuple[int, int]]) -> int:
            key = bytes([final]) + b"".join(b.to_bytes(1) + t.to_bytes(4) for b, t in edges)
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
                words.append(final + sum(words[t] for _, t in edges))
            return registry[key]

        path: list[list] = [[False, []]]  # open states along the last word: [final, edges]
        last = b""
        ordered = sorted(entries)
        for word in ordered:
            same = len(os.path.commonprefix([last, word]))
            for i in range(len(last), same, -1):
                path[i - 1][1].append((last[i - 1], settle(*path.pop())))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], settle(*path.pop())))
        root = settle(*path.pop())
        registry.clear()
        first, label, target, skip = array("I", [0]), bytearray(), array("I"), array("I")
        for state in states:
            before = state[0]
            for at in range(1, len(state), 5):
                t = int.from_bytes(state[at + 1 : at + 5])
                label.append(state[at])
                target.append(t)
                skip.append(before)
                before += words[t]
            first.append(len(label))
        at = np.cumsum([0, *(len(entries[w]) for w in ordered)], dtype=np.uint32)
        parts = [*(np.array(x, "<u4").tobytes() for x in (first, target, skip, at)), bytes(label), bytes(s[0] for s in states), b"".join(entries[w] for w in ordered)]
        return Lexicon.MAGIC + struct.pack("<IIII", len(states), len(label), len(ordered), root) + b"".join(parts)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Memory-mapped from a file that has no name any more, so that nothing stays behind."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __init__(self, data):
        self.data, view = data, memoryview(data)
        n, m, k, self.root = struct.unpack_from("<IIII", data, 4)
        at = 20

        def take(size: int, kind: str):
            nonlocal at
            at += size
            return view[at - size : at].cast(kind)

        self.first, self.target, self.skip, self.ids_at = take(4 * (n + 1), "I"), take(4 * m, "I"), take(4 * m, "I"), take(4 * (k + 1), "I")
        self.label, self.final, self.ids = take(m, "B"), take(n, "B"), take(self.ids_at[k], "B")
        self.states, self.words, self.edges = n, k, None

    def lookups(self, words: list[bytes]) -> list[bytes | None]:
        """`lookup` of many words at once: all of them take their step on the same byte together."""
        if self.edges is None:  # each edge by its state and label, in order
            self.edges = np.repeat(np.arange(self.states, dtype=np.uint32) << 8, np.diff(np.asarray(self.first))) | np.asarray(self.label)
        edges, skip, target = self.edges, np.asarray(self.skip), np.asarray(self.target)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, rank, known = np.full(len(words), self.root, np.uint32), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        going, i = np.flatnonzero(size), 0
        while len(going):
            wanted = state[going] << 8 | data[start[going] + i]
            edge = np.searchsorted(edges, wanted)
            there = edge < len(edges)
            there[there] = edges[edge[there]] == wanted[there]
            known[going[~there]] = False
            going, edge = going[there], edge[there]
            rank[going] += skip[edge]
            state[going] = target[edge]
            i += 1
            going = going[size[going] > i]
        known &= np.asarray(self.final)[state] > 0
        rank[~known] = 0
        ids_at = np.asarray(self.ids_at)
        ends = ids_at[rank + 1].tolist() if self.words else [0] * len(words)
        data, at = self.data, len(self.data) - len(self.ids)  # they stand last
        return [data[at + lo : at + hi] if k else None for k, lo, hi in zip(known.tolist(), ids_at[rank].tolist(), ends)]

    def lookup(self, word: bytes) -> bytes | None:
        state, rank, first, label = self.root, 0, self.first, self.label
        for b in word:
            lo, hi = first[state], first[state + 1]
            while lo < hi:  # labels of a state are sorted
                mid = (lo + hi) // 2
                if label[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == first[state + 1] or label[lo] != b:
                return None
            rank += self.skip[lo]
            state = self.target[lo]
        return bytes(self.ids[self.ids_at[rank] : self.ids_at[rank + 1]]) if self.final[state] else None


def normal(text: str) -> str:
    """NFC and lower case, character by character (so a final sigma is an ordinary one)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def chunks(text: str) -> list[str]:
    """Runs between white space of a normalised text; no word crosses them."""
    return [c for c in CUT.split(text) if c] if ODD.search(text) else text.split()


def words_of(chunk: str) -> list[str]:
    """The words of a chunk."""
    if chunk.isalpha():  # nearly all: a word, or a word and a mark
        return [chunk]
    if chunk[:-1].isalpha() and chunk[-1] in ",.":
        return [chunk[:-1], chunk[-1]]
    return WORD.findall(chunk)


class Encoder:
    """Encodes texts; remembers chunks up to a bound."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.memo = Memo(self._chunk)
        self.rare = Memo(self._merged, 30_000)
        self.seen = [0, 0]  # words from the lexicon, words merged

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word, words_of(chunk)))

    def _word(self, word: str) -> bytes:
        if self.lexicon is not None and (ids := self.lexicon.lookup(word.encode())) is not None:
            self.seen[0] += 1
            return ids
        return self._merged(word)

    def _merged(self, word: str) -> bytes:
        self.seen[1] += 1
        return np.array(self.tokenizer.merged(word), "<u4").tobytes()

    def _learn(self, found: set[str]) -> None:
        """Chunks that are not remembered yet, their words looked up together and merged once each."""
        new = [c for c in found if c not in self.memo and len(c) <= Memo.LONGEST]
        whole, rest = [c for c in new if c.isalpha()], [c for c in new if not c.isalpha()]
        cut = list(map(words_of, rest))
        words = list({*whole, *chain.from_iterable(cut)})
        ids = dict(zip(words, self.lexicon.lookups([w.encode() for w in words]) if self.lexicon is not None else [None] * len(words)))
        for w in (unknown := [w for w, known in ids.items() if known is None]):
            ids[w] = self.rare[w]
        self.seen[0] += len(words) - len(unknown)
        get = ids.__getitem__
        self.memo.update(zip(whole, map(get, whole)))
        self.memo.update((c, b"".join(map(get, ws))) for c, ws in zip(rest, cut))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """`encode` of each text; what is new in them is learnt together first."""
        self.rare.trim()
        cut = [chunks(normal(t)) if t and "<|" not in t else None for t in texts]
        found = set().union(*(c for c in cut if c))
        self.memo.trim(found)
        self._learn(found)
        return [self.encode(t) if c is None else b"".join(map(self.memo.__getitem__, c)) for t, c in zip(texts, cut)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        self.memo.trim()
        if "<|" not in text:
            return b"".join(map(self.memo.__getitem__, chunks(normal(text))))
        out = []
        for part in self.tokenizer.special_cut.split(text):
            if (i := self.tokenizer.special.get(part)) is not None:
                out.append(struct.pack("<I", i))
            else:
                out += map(self.memo.__getitem__, chunks(normal(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokenizer.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent words over all texts, at most `most`."""

    def words(held: Counter) -> pa.RecordBatch:
        out: dict[str, int] = {}
        get = out.get
        for chunk, n in held.items():
            for w in words_of(chunk):
                if len(w) <= LONGEST:
                    out[w] = get(w, 0) + n
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                if t := text.as_py():
                    held.update(chunks(normal(t)))
                    if len(held) > FLUSH:
                        yield words(held)
        yield words(held)

    counted = docs.select("text").mapInArrow(tidy(count), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return top.select("word").toArrow()["word"].to_pylist()


def compiled_words(docs: DataFrame, path: str, most: int = LEXICON) -> Broadcast:
    """The lexicon of the most frequent words, broadcast; the driver holds nothing of it afterwards."""
    tokenizer = Tokenizer(path)
    entries = {w.encode(): np.array(tokenizer.merged(w), "<u4").tobytes() for w in frequent_words(docs, most)}
    return docs.sparkSession.sparkContext.broadcast(Lexicon.compile(entries))


def encode(docs: DataFrame, path: str, most: int = LEXICON) -> DataFrame:
    """`docs(doc_id, text)` -> doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded."""
    compiled = compiled_words(docs, path, most)
    give_back()

    def run(batches):
        encoder = Encoder(Tokenizer(path), Lexicon.mapped(compiled.value))
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=["doc_id", "n_tokens", "ids", "decoded"])

        for b in batches:
            for part in parts(b.column(1)):
                for doc_id, ids in zip(b.column(0)[part.start : part.stop].to_pylist(), encoder.encode_all(b.column(1)[part.start : part.stop].to_pylist())):
                    rows.append((doc_id, len(ids) // 4, ids, encoder.decode(ids)))
                    size += len(ids) + len(rows[-1][3])
                    if size >= BATCH:
                        yield batch()
                        rows.clear()
                        size = 0
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
