"""Secret scans: a linear-chain conditional random field that tags tokens as secret begin, inside or outside.

Base patterns come first (`assign`, `access`, `hex`); their spans always stay. The field adds spans of kind `crf` that overlap
none of them. Its tokens are all of the text: runs of letters and digits, and single marks. A secret holds no blanks: after one,
every tag is followed as the outside is, so chains are the pieces between blanks, and decoding them is exact for the whole text. Features
of a token: its shape (case, digits, length, alternation of characters, runs of consonants, share of vowels), the
kinds of its neighbours and whether they touch it, how far back a word stands that speaks of secrets, the piece between blanks
that it is part of (length, mixed tokens, marks of addresses, a known beginning, a form of names that are no secrets: UUIDs, hardware addresses, query strings), and the file
(whether it speaks of secrets, how many of its tokens are mixed). Every feature is a category, so a text's scores are sums of table rows, and Viterbi runs over the pieces in which some
path other than all outside could win: `hopeful` bounds what any such path can gain, and pieces that cannot are outside for certain.

Weights are trained here, once per driver, by maximising the conditional likelihood (forward and backward sums, Adagrad) on `TRAIN`
generated lines: keys, tokens, passwords with and without marks and digits, pass phrases joined by marks, against prose, numbers, dates, versions,
addresses, mails, phone and card numbers, paths, query strings, UUIDs and other ids, names and sentences about secrets. They are some thousand numbers, shipped with the task.

A text is tagged segment by segment: a segment ends at a line feed, and holds `SEGMENT` characters if a line does, so memory is bounded by the segment. A longer line is
cut at its last blank in it, or, without any, at `SEGMENT` characters, as if a line ended there. What a token knows of the file is found over the whole text before.
Shorter texts are tagged together as long as they fit into a segment, with a line feed between them.

Nulls and edge cases: null and empty texts have no spans; very long texts are read whole, in segments;
repeated rows and null doc_ids are rows like others; equal starts are ordered by kind; extra columns pass through `mask`;
positions are code points, ends exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, give_back, parts, tidy

KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 12, "access": 18, "hex": 16}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: what the lower case of a text holds if ASSIGN finds anything in it
KEY_HINTS = ("passw", "secret", "token", "api")
TRAIN, EPOCHS, BATCH, SEED, RATE = 8000, 5, 512, 11, 0.25
SEGMENT = 1 << 16
#: own features of a token, at most
OWN = 16
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
#: beginnings that some services give their keys
BEGINS = re.compile(r"(?<![^\W_])(?:gh[po]_|[sr]k[_-]|xox[a-z]-|AKIA|ASIA|AIza|eyJ|glpat-|npm_|pat_)")
#: forms of names that are no secrets by themselves: UUIDs, hardware addresses; the beginning of a query string
NAMES = re.compile(r"(?<![^\W_])(?:(?P<id>[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2})(?![^\W_]))|\?[\w.-]{1,40}=")
SPEAKS = re.compile(r"passw|pass(?![a-z])|passphrase|secret|token|api|key|credential|auth|bearer|pwd|login", re.I | re.A)
#: what a text holds if BEGINS, SPEAKS (in lower case) or NAMES find anything in it
BEGIN_HINTS = ("ghp_", "gho_", "sk_", "sk-", "rk_", "rk-", "xox", "AKIA", "ASIA", "AIza", "eyJ", "glpat-", "npm_", "pat_")
SPEAK_HINTS = ("pass", "secret", "token", "api", "key", "credential", "auth", "bearer", "pwd", "login")
MARKS = "=:\"'`@/.-_+,()[]{}<>&$!#%*^?~;|\\"
#: kinds of tokens; the marks of MARKS follow
BLANK, LINE, CUE, SMALL, WORD, LONG, NUMBER, MIXED, ODD, MARK = range(10)
N_KINDS = MARK + len(MARKS)
#: categories: the left and the right neighbour, the two left of it, distance of the last cue, the piece (twice, and its beginning), the file
SIZES = (2 * N_KINDS, 2 * N_KINDS, N_KINDS * 10, 5 * 10, 4 * 6 * 10, 8 * 10, 2 * 3 * 10, 2 * 4 * 10)


OFFSETS = [sum(SIZES[:i]) for i in range(len(SIZES))]
#: how far back a cue stands, in steps
GAPS = np.digitize(np.arange(8), (2, 4, 7))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base patterns, leftmost and non-overlapping per kind; a match under its least length is dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in KEY_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Outline(dict):
    """For `str.translate`: digits, vowels and consonants of either case become 0, a, b, A and B, other letters e; the rest stays. Tokens of one outline share a row."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0] if c.isalpha() else c
        new = "0" if c.isdigit() else c if not c.isalnum() else "e" if not base.isascii() or not base.isalpha() else "a" if base in "aeiouy" else "b" if base.islower() else "A" if base in "AEIOUY" else "B"
        self[code] = ord(new)
        return self[code]


OUTLINE = Outline()
SPOKEN = "\0"  # the outline of a word that speaks of secrets


def kind_of(t: str) -> int:
    """The kind of an outline."""
    if t == SPOKEN:
        return CUE
    if t.isspace():
        return LINE if "\n" in t or "\r" in t else BLANK
    if not t[0].isalnum():
        return MARK + MARKS.index(t) if t in MARKS else ODD
    if t.isdigit():
        return NUMBER
    return (SMALL if len(t) < 4 else WORD if len(t) < 12 else LONG) if t.isalpha() else MIXED


def _bucket(x: float, *steps: float) -> int:
    return sum(x >= s for s in steps)


def own_features(t: str) -> list[str]:
    """What a token shows by its outline."""
    kind, n = kind_of(t), len(t)
    out = ["bias", f"kind={kind}"]
    if kind not in (SMALL, WORD, LONG, NUMBER, MIXED):
        return out
    digits, upper, vowels = t.count("0"), t.count("A") + t.count("B"), t.count("a") + t.count("A") + t.count("e")
    change = sum(map(t.count, ("0a", "0b", "0A", "0B", "a0", "b0", "A0", "B0", "aA", "aB", "bA", "bB"))) / n
    case = "digits" if digits == n else "lower" if not upper else "upper" if upper + digits == n else "title" if upper == 1 and t[0] in "AB" else "camel"
    consonants = max(map(len, re.split("[^bB]", t)))
    length, odd = _bucket(n, 5, 8, 12, 16, 20, 28, 36), _bucket(consonants, 3, 4, 5, 6)
    return [
        *out, f"case={case}", f"length={length}", f"case={case} length={length} digits={digits > 0}", f"change={_bucket(change, 0.1, 0.2, 0.35)}", f"digits={_bucket(digits / n, 0.01, 0.15, 0.4, 0.8)}",
        f"consonants={odd}", f"vowels={_bucket(vowels / max(1, n - digits), 0.1, 0.2, 0.3, 0.4)} length={length}", f"case={case} consonants={odd}", f"case={case} change={_bucket(change, 0.1, 0.2, 0.35)}", f"other={'e' in t}",
    ]


FILE_STEPS = (1, 4, 20)


def segments(text: str):
    """(start, end) of the parts of a text that are tagged one after the other."""
    at = 0
    while len(text) - at > SEGMENT:
        end = text.rfind("\n", at, at + SEGMENT) + 1 or text.rfind(" ", at, at + SEGMENT) + 1 or at + SEGMENT
        yield at, end
        at = end
    yield at, len(text)


def _short(kinds: np.ndarray) -> np.ndarray:
    return np.minimum(kinds, MARK)


@dataclass
class Tokens:
    """The tokens of a text but for blanks: places, own numbers, categories (one column per table of SIZES, as rows of one table), first token of each piece between blanks."""

    start: np.ndarray
    end: np.ndarray
    own: np.ndarray
    codes: np.ndarray
    pieces: np.ndarray


class Reader:
    """Cuts texts into tokens; numbers what tokens show by themselves, the row `made(token)` being kept by number in `table`."""

    def __init__(self, made, width: int, kind: type, most: int = 100_000):
        self.made, self.most = made, most
        self.memo = Memo(self._new, most)
        self.table, self.kinds, self.used = np.zeros((1024, width), kind), np.zeros(1024, np.int64), 0

    def _new(self, token: str) -> int:
        if self.used == len(self.table):
            self.table, self.kinds = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        self.table[self.used], self.kinds[self.used] = self.made(token), kind_of(token)
        self.used += 1
        return self.used - 1

    def mixed(self, text: str) -> int:
        """How many tokens are mixed."""
        return sum(kind_of(t) == MIXED for t in TOKEN.findall(text.translate(OUTLINE)))

    def __call__(self, text: str | list[str], trim: bool = True, file: tuple[bool, int] | None = None) -> Tokens:
        """Several texts are read as one with a line feed between them, so none is a neighbour of another's tokens, and places are in that one.

        `file`: whether it speaks of secrets, and how many of its tokens are mixed, if `text` is a segment of it.
        """
        if trim and self.used > self.most:
            self.memo.clear()
            self.used = 0
        texts = [text] if isinstance(text, str) else text
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        tokens = TOKEN.findall("\n".join(texts).translate(OUTLINE))
        own = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        kinds = self.kinds[own]
        spoken, begun, formed, speaks = [], [], [], np.zeros(len(texts), bool)
        for i, (t, at) in enumerate(zip(texts, begin.tolist())):
            low = t.lower()
            if any(h in low for h in SPEAK_HINTS) and (found := [at + m.start() for m in SPEAKS.finditer(t)]):
                spoken += found
                speaks[i] = True
            if any(h in t for h in BEGIN_HINTS):
                begun += [at + m.start() for m in BEGINS.finditer(t)]
            if "?" in t and "=" in t or t.count("-") > 3 or t.count(":") > 4:
                formed += [(at + m.start(), 1 if m["id"] else 2) for m in NAMES.finditer(t)]
        if spoken:
            at = np.unique(np.searchsorted(ends, spoken, "right"))
            at = at[(kinds[at] >= SMALL) & (kinds[at] <= LONG) & (sizes[at] < 16)]
            own[at] = self.memo[SPOKEN]
            kinds[at] = CUE
        line = np.cumsum(kinds == LINE)
        piece = np.cumsum(kinds <= LINE)
        real = np.flatnonzero(kinds > LINE)
        k, line, piece, end, own, sizes = kinds[real], line[real], piece[real], ends[real], own[real], sizes[real]
        start, n = end - sizes, len(real)
        if not n:
            return Tokens(start, end, own, np.zeros((0, len(SIZES)), np.int64), np.zeros(0, np.int64))
        same, touch, left, right, second = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.equal(line[1:], line[:-1], out=same[1:])
        np.equal(start[1:], end[:-1], out=touch[1:])
        left[1:] = k[:-1] * same[1:]
        right[:-1] = k[1:] * same[1:]
        second[2:] = k[:-2] * (same[2:] & same[1:-1])
        right *= 2
        right[:-1] += touch[1:]
        at = np.arange(n)
        cue = np.full(n, -1)  # before the token
        np.maximum.accumulate(np.where(k == CUE, at, -1)[:-1], out=cue[1:])
        opening = np.maximum.accumulate(np.where(same, 0, at))
        gap = np.where(cue >= opening, GAPS[np.minimum(at - cue, len(GAPS) - 1)], 4)
        begins = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        each = lambda x: np.add.reduceat(x, begins, dtype=np.int64)
        length, mixed, words = each(sizes), each(k == MIXED), each((k >= CUE) & (k <= LONG))
        slashes, ats, dots = each(k == MARK + MARKS.index("/")), each(k == MARK + MARKS.index("@")), each(k == MARK + MARKS.index("."))
        address = np.where(slashes > 1, 1, np.where(ats > 0, 2, np.where(dots > 1, 3, 0)))
        size = np.digitize(length, (8, 12, 20, 32, 48))
        # by piece: which of them begin as keys do, and the forms in them
        known, form = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        piece_of = lambda places: np.searchsorted(start[begins], places, "right") - 1
        if begun:
            known[piece_of(begun)] = 1
        if formed:
            places, which = np.array(formed).T
            np.maximum.at(form, piece_of(places), which)
        count, s = np.diff(begins, append=n), _short(k)
        many = np.concatenate([[0], np.cumsum(k == MIXED)])
        edges = np.searchsorted(start, begin)
        of_file = (file[0] * 4 + np.digitize(file[1], FILE_STEPS)) * 10 if file else np.repeat((speaks * 4 + np.digitize(many[edges[1:]] - many[edges[:-1]], FILE_STEPS)) * 10, np.diff(edges))
        tables = (
            left * 2 + touch, right, second * 10 + s, gap * 10 + s, np.repeat((np.minimum(mixed, 3) * 6 + size) * 10, count) + s, np.repeat((address * 2 + (words > 1)) * 10, count) + s,
            np.repeat((known * 3 + form) * 10, count) + s, of_file + s,
        )
        return Tokens(start, end, own, np.stack([t + o for t, o in zip(tables, OFFSETS)]).T, begins)


ALLOWED = np.zeros((3, 3))
ALLOWED[OUTSIDE, INSIDE] = -1e6  # inside only after begin or inside


@dataclass
class Field:
    """Weights per own feature, category and pair of tags; before and after a chain stands the outside."""

    names: dict[str, int]
    own: np.ndarray
    codes: np.ndarray
    steps: np.ndarray

    def reader(self) -> Reader:
        return Reader(lambda t: self.own[[self.names[f] for f in own_features(t) if f in self.names]].sum(axis=0), 3, np.float64)

    def emissions(self, tokens: Tokens, reader: Reader) -> np.ndarray:
        total = self.codes[tokens.codes[:, 0]]
        for column in tokens.codes.T[1:]:  # one after the other, as a sum over rows does
            total += self.codes[column]
        return reader.table[tokens.own] + total

    def hopeful(self, e: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Pieces in which tags other than outside may win.

        A stretch of tags that begins at one token changes the score of all outside by what its begin and end gain and by what further
        tokens gain, at most the sum of those behind it that gain at all. Where that is not positive for any begin, no stretch can win.
        """
        t = self.steps
        gain = e - e[:, OUTSIDE : OUTSIDE + 1]
        begin = gain[:, BEGIN] + t[OUTSIDE, BEGIN] + max(t[BEGIN, OUTSIDE], t[INSIDE, OUTSIDE]) - 2 * t[OUTSIDE, OUTSIDE]
        inside = gain[:, INSIDE] + max(t[BEGIN, INSIDE], t[INSIDE, INSIDE]) - t[OUTSIDE, OUTSIDE]
        again = gain[:, BEGIN] + max(t[BEGIN, BEGIN], t[INSIDE, BEGIN]) - t[OUTSIDE, OUTSIDE]
        more = np.maximum(np.maximum(inside, again), 0)
        size = np.diff(np.r_[pieces, len(e)])
        total = np.cumsum(more)
        after = np.repeat(total[pieces + size - 1], size) - total  # what tokens of the piece behind this one may add
        return np.flatnonzero(np.maximum.reduceat(begin + after, pieces) > 0)

    def viterbi(self, e: np.ndarray) -> list[int]:
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.steps.tolist()
        rows = e.tolist()
        b, i, o = rows[0][0] + ob, -1e18, rows[0][2] + oo
        back = []
        for x, y, z in rows[1:]:
            from_b = BEGIN if b + bb >= i + ib and b + bb >= o + ob else INSIDE if i + ib >= o + ob else OUTSIDE
            from_i = BEGIN if b + bi >= i + ii else INSIDE
            from_o = BEGIN if b + bo >= i + io and b + bo >= o + oo else INSIDE if i + io >= o + oo else OUTSIDE
            back.append((from_b, from_i, from_o))
            b, i, o = max(b + bb, i + ib, o + ob) + x, max(b + bi, i + ii) + y, max(b + bo, i + io, o + oo) + z
        last = (b + bo, i + io, o + oo)
        tags = [last.index(max(last))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]

    def spans(self, text: str, reader: Reader) -> list[tuple[int, int]]:
        if len(text) <= SEGMENT:
            return self._spans(text, reader, None)
        mixed = 0
        for lo, hi in segments(text):
            mixed += reader.mixed(text[lo:hi])
            if mixed >= FILE_STEPS[-1]:
                break
        file = SPEAKS.search(text) is not None, mixed
        return [(lo + a, lo + b) for lo, hi in segments(text) for a, b in self._spans(text[lo:hi], reader, file)]

    def spans_of_all(self, texts: list[str], reader: Reader) -> list[list[tuple[int, int]]]:
        """`spans` of each text; those that fit into a segment are read together."""
        out, held, size = [], [], 0
        for text in texts:
            if held and size + len(text) > SEGMENT:
                out += self._together(held, reader)
                held, size = [], 0
            if len(text) > SEGMENT:
                out.append(self.spans(text, reader))
            else:
                held.append(text)
                size += len(text) + 1
        return out + self._together(held, reader)

    def _together(self, texts: list[str], reader: Reader) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        begin = [0, *accumulate(len(t) + 1 for t in texts)]
        for lo, hi in self._spans(texts, reader, None) if texts else ():
            i = bisect_right(begin, lo) - 1
            out[i].append((lo - begin[i], hi - begin[i]))
        return out

    def _spans(self, text: str | list[str], reader: Reader, file: tuple[bool, int] | None) -> list[tuple[int, int]]:
        tokens = reader(text, file=file)
        if not len(tokens.own):
            return []
        e, ends, out = self.emissions(tokens, reader), np.r_[tokens.pieces[1:], len(tokens.own)], []
        for at in self.hopeful(e, tokens.pieces).tolist():
            lo, hi = int(tokens.pieces[at]), int(ends[at])
            for j, tag in enumerate(self.viterbi(e[lo:hi]), lo):
                if tag == BEGIN:
                    out.append((int(tokens.start[j]), int(tokens.end[j])))
                elif tag == INSIDE:
                    out[-1] = (out[-1][0], int(tokens.end[j]))
        return out


def _generated(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line and the spans of its secrets."""
    pick, letters, numbers = rng.choice, "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, lo, hi=None: "".join(pick(chars) for _ in range(rng.randint(lo, hi or lo)))
    sound = lambda: pick(("", "b", "ch", "d", "f", "g", "l", "m", "n", "p", "r", "s", "sch", "st", "t", "th", "tr", "v")) + pick(("a", "e", "i", "o", "u", "ie", "ou", "ä", "é", "ó", "ión")) + pick(("", "", "n", "r", "s", "t", "nd", "ng", "nt", "ll", "rst", "cht"))
    word = lambda most=5: "".join(sound() for _ in range(rng.randint(1, most)))
    both = letters + letters.upper() + numbers
    case = lambda w: w.title() if rng.random() < 0.15 else w
    words = lambda lo, hi: " ".join(case(word()) + pick(("", "", "", "", ",", ".", "###", "&&")) for _ in range(rng.randint(lo, hi)))
    secrets = (
        lambda: some(both, 16, 44), lambda: some(both + "+/", 24, 64) + pick(("", "=", "==")), lambda: some(letters, 12, 24), lambda: some(letters + letters.upper(), 10, 24), lambda: pick(("ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_", "pat_")) + some(both, 18, 40),
        lambda: f"xox{pick('bap')}-{some(numbers, 10, 12)}-{some(both, 16, 24)}", lambda: pick(("AKIA", "ASIA", "AIza")) + some(letters.upper() + numbers, 14, 20), lambda: some(both, 3, 10) + pick("$!@#%&*^?~") + some(both, 3, 12), lambda: word(2).title() + some(numbers, 1, 4) + pick("$!@#%&*") + word(2).title() + some(numbers, 0, 3),
        lambda: "eyJ" + some(both, 15, 24) + "." + some(both, 24, 40) + "." + some(both + "-_", 24, 43), lambda: "-".join(some(both, 4, 6) for _ in range(rng.randint(3, 6))), lambda: "-".join(word(2) for _ in range(rng.randint(3, 5))) + some(numbers, 0, 2),
        lambda: word(3) + some(numbers, 1, 3) + word(1) + pick("$!@#%&*?") + some(both, 0, 3), lambda: word(2).title() + pick("&!?_#") + word(2).title() + pick(("-", "_", "!", "")) + some(numbers, 2, 4) + pick(("", "!", "x")),
        lambda: pick(("rk_live_", "rk_test_", "sk_test_", "hvs.", "whsec_", "SG.", "dop_v1_")) + some(both, 16, 40), lambda: some(both, 14, 24) + "." + some(both, 20, 40), lambda: "-".join(word(2) for _ in range(3)) + "-" + some(numbers, 1, 2),
    )
    hexes = "abcdef" + numbers
    plain = (
        lambda: some(numbers, 1, 19), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}-{pick(('rc1', 'beta2', 'final0'))}",
        lambda: f"{word(2)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: "/".join([word(2), word(2), f"{word(2)}{rng.randint(0, 99)}.{pick(('html', 'py', 'txt'))}"]),
        lambda: f"{word(2)}_{word(2)}_{rng.randint(0, 999)}", lambda: f"{word(2)}{rng.randint(10, 9999)}", lambda: f"https://{word(2)}.example.org/{word(2)}/{rng.randint(1, 99999)}?page={rng.randint(1, 9)}&{word(2)}={word(2)}", lambda: f"{word(2).title()}-{word(2)}-{rng.randint(1, 99)}", lambda: f"{rng.randint(1, 999)},{rng.randint(100, 999)}.{rng.randint(10, 99)}",
        lambda: pick("- ").join(some(numbers, 4) for _ in range(4)), lambda: f"{rng.randint(1, 12)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}.{rng.randint(100, 999)}", lambda: f"0x{some('abcdef' + numbers, 6, 8)}", lambda: f"ISBN-{some(numbers, 13)}", lambda: f"{word(2)}2{word(2)}4{word(2)}",
        lambda: word(2).title() + word(2).title() + word(3).title(), lambda: f"{word(3)}({word(2)}, {word(2)})", lambda: word(9), lambda: f"<a href=\"/{word(2)}/{rng.randint(1, 999)}\">{word(3)}</a>", lambda: f"{word(2)} | {word(2)}", lambda: f"GPL-{rng.randint(1, 3)}.0", lambda: some(letters.upper(), 2) + some(numbers, 18, 20),
        lambda: f"{word(3)}{pick(('!', '?', '...', '!!!', '%', '$$$'))}", lambda: word(2) + "s'" + word(2), lambda: f"CC BY-{pick(('NC', 'SA'))} {rng.randint(1, 4)}.0", lambda: f"{word(3)}-{word(4)}", lambda: f"#{some(numbers + 'abcdef', 6)}", lambda: f"https://{word(2)}.example.org/{pick(('api', 'login', 'auth', 'docs'))}/v{rng.randint(1, 9)}/{pick(('token', 'key', 'secret', 'password'))}-{word(3)}?{word(2)}={word(2)}&{word(1)}={rng.randint(1, 99)}",
        lambda: f"{pick(('get', 'set', 'new', 'max'))}_{pick(('token', 'key', 'secret', 'auth'))}_{word(2)}({word(2)}_{word(2)}, {word(2)}_{word(2)}): {word(2)} {word(2)}[{word(2)}_{word(1)}]", lambda: "".join(word(3) for _ in range(rng.randint(2, 4))).title(), lambda: f"${rng.randint(1, 999)}.{rng.randint(10, 99)}",
        lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: f'{{"id": "{"-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))}", "{word(2)}": {rng.randint(1, 99)}}}',
        lambda: f"{pick(('request', 'trace', 'span', 'session', 'build', 'X-Request-Id', 'X-Trace-Id', 'record', 'correlation'))}{pick((' id ', ' id: ', ': ', '=', ' '))}{pick(('', '#', 'req-'))}{some(hexes, 6, 8)}{pick(('', '-' + some(hexes, 4)))}", lambda: ":".join(some(hexes, 2) for _ in range(6)).upper(), lambda: ":".join(some(hexes, 1, 4) for _ in range(6)),
        lambda: f"https://{word(2)}.example.com/{word(1)}/{word(2)}?{word(1)}={some(both, 4, 12)}", lambda: f"https://{word(2)}.example.net/{word(2)}?{word(1)}={word(2)}&{word(1)}_id={some(both, 6, 14)}&{word(1)}={rng.randint(1, 99)}", lambda: f"{word(2)}.com/{word(1)}?{pick('vqtcs')}={some(both, 8, 12)}",
        lambda: f"/{word(2)}/{word(1)}.{some(hexes, 8)}.{pick(('js', 'css', 'png'))}", lambda: f"{pick(('css', 'sc', 'jss'))}-{some(letters + numbers, 6, 8)}", lambda: f'W/"{some(hexes, 8, 14)}"', lambda: f"commit {some(hexes, 7, 10)}", lambda: f"{some(letters.upper(), 2, 4)}-{rng.randint(10, 99999)}", lambda: f"{some(letters.upper(), 2)}{some(numbers, 2, 4)}",
        lambda: f"IMG_{some(numbers, 8)}_{some(numbers, 6)}.jpg", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}.{some(numbers, 3)}Z", lambda: f"{pick(('secretName', 'tokenName', 'keyName', 'KEY_NAME', 'tokenType', 'authType', 'apiVersion'))}{pick((': ', ' = '))}{pick((word(2), word(2) + '-' + word(2), word(1) + '-' + word(2) + '-' + word(1)))}",
        lambda: f"{pick(('password', 'token', 'secret', 'api_key'))}{pick((': ', '=', ' = '))}{pick(('${' + word(2).upper() + '_' + word(1).upper() + '}', '<' + word(2) + ' ' + word(1) + '>', 'os.environ[' + word(2) + ']', '****', 'null', 'none'))}", lambda: f"{pick(('pass', 'passed', 'passing', 'passport', 'keyboard', 'monkey', 'secretary'))} the {word(2)} {pick(('and', 'to', 'in'))} {word(2)}",
    )
    cue = ("key", "api key", "auth", "Bearer", "secret", "token", "password", "pwd", "credential", "access_key", "passphrase", "login", "pass", "passwd", "DB_PASS", "API_TOKEN", "private key", "credentials", "--password", "auth key")
    far = (" for the {}: ", " of the {} is ", " was changed to ", " for {} and {} is ", ", ", " to the {}: ", " are {} and ", " {} / ", " (old): ", " for {}: ", ' of {} "')
    about = (" of the ", " was kept by ", " is ", " for ", "s and ", " meeting in ", ": see ", " policy ", " - ", " = ")
    text, spans = words(0, 8), []
    for _ in range(rng.randint(1, 3)):
        text += " "
        roll = rng.random()
        if roll < 0.4:
            cued = rng.random() < 0.75
            make = pick(secrets)
            made = make()
            if make in (secrets[2], secrets[3], secrets[7], secrets[8], secrets[11], secrets[12], secrets[13], secrets[15], secrets[16]):
                cued = True  # nothing but the context tells them from words
            quote, after = pick(("", "", '"', "'")), pick((" ", ". ", ", ", "; ", ") ", f" {word(1)} "))
            if rng.random() < 0.1 and "@" not in made and "/" not in made:  # in an address
                cued, quote, after = False, "", f"@{word(2)}.example.org{pick(('', ':5432'))}/{word(1)} "
                text += f"{pick(('postgres', 'redis', 'amqp', 'https', 'ftp', 'mongodb'))}://{pick((word(1), 'admin', 'root', ''))}:"
            if cued:
                text += pick(cue) + (pick((" ", ": ", "=", " = ", " is ", ":")) if rng.random() < 0.8 else pick(far).format(word(2), word(1)))
            text += quote
            spans.append((len(text), len(text) + len(made)))
            text += made + quote + after
        elif roll < 0.55:
            text += pick(cue) + pick(about) + (words(1, 4) if rng.random() < 0.6 else pick(plain)()) + " "
        else:
            text += pick(plain)() + pick((" ", '" ', ". ", ", "))
        text += words(0, 6)
    return text, spans


def examples(n: int, seed: int = SEED):
    """(text, spans) of `n` generated lines."""
    rng = random.Random(seed)
    return [_generated(rng) for _ in range(n)]


def tagged(tokens: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.full(len(tokens.own), OUTSIDE)
    for lo, hi in spans:
        within = np.flatnonzero((tokens.start >= lo) & (tokens.start < hi))
        tags[within] = INSIDE
        tags[within[:1]] = BEGIN
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(e: np.ndarray, steps: np.ndarray, sizes: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected counts of tags and steps, for chains of emissions padded to one length."""
    n, most, _ = e.shape
    step, rows = ALLOWED + steps, np.arange(n)
    fore, aft = np.empty_like(e), np.empty_like(e)
    fore[:, 0] = e[:, 0] + step[OUTSIDE]
    for i in range(1, most):
        fore[:, i] = e[:, i] + _lse(fore[:, i - 1, :, None] + step, 1)
    aft[:, -1] = step[:, OUTSIDE]
    for i in range(most - 2, -1, -1):
        aft[:, i] = np.where((i == sizes - 1)[:, None], step[:, OUTSIDE], _lse(step + (e[:, i + 1] + aft[:, i + 1])[:, None, :], 2))
    total = _lse(fore[rows, sizes - 1] + step[:, OUTSIDE], 1)
    here = np.arange(most) < sizes[:, None]
    seen = np.eye(3)[tags]
    token = np.where(here[..., None], seen - np.exp(np.minimum(fore + aft - total[:, None, None], 0)), 0.0)
    pair = np.exp(np.minimum(fore[:, :-1, :, None] + step + (e[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None], 0))
    both = here[:, 1:, None, None]
    moved = np.where(both, seen[:, :-1, :, None] * seen[:, 1:, None, :] - pair, 0.0).sum(axis=(0, 1))
    moved[OUTSIDE] += token[:, 0].sum(axis=0)
    moved[:, OUTSIDE] += token[rows, sizes - 1].sum(axis=0)
    return token, moved


@lru_cache(maxsize=1)
def trained(n: int = TRAIN, epochs: int = EPOCHS) -> Field:
    """The field; what its training held is given back, for the driver keeps its place in memory for all that follows."""
    field = _train(n, epochs)
    give_back()
    return field


def _train(n: int, epochs: int) -> Field:
    names: dict[str, int] = {}

    def numbered(t: str) -> np.ndarray:
        out = np.full(OWN, -1)
        found = [names.setdefault(f, len(names)) for f in own_features(t)]
        out[: len(found)] = found
        return out

    reader = Reader(numbered, OWN, np.int16)

    def read(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """Own features, categories, tags and sizes of chains, in as few bytes as they need."""
        t = reader(text, trim=False)
        return reader.table[t.own], t.codes.astype(np.int16), tagged(t, spans).astype(np.int8), np.diff(np.r_[t.pieces, len(t.own)])

    own, codes, tags, sizes = (np.concatenate(x) for x in zip(*(read(*x) for x in examples(n))))
    starts = np.cumsum(sizes) - sizes
    w_own, w_codes, steps = np.zeros((len(names) + 1, 3)), np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    squares = [np.full_like(x, 1e-3) for x in (w_own, w_codes, steps)]
    order, rng = np.arange(len(sizes)), np.random.default_rng(SEED)
    for _ in range(epochs):
        rng.shuffle(order)
        batches = [near[i : i + BATCH] for lo in range(0, len(order), 16 * BATCH) for near in [sorted(order[lo : lo + 16 * BATCH], key=sizes.__getitem__)] for i in range(0, len(near), BATCH)]
        for part in rng.permuted(np.arange(len(batches))):
            part = np.array(batches[part])  # chains of like length
            size = sizes[part]
            row, column = np.repeat(np.arange(len(part)), size), np.concatenate([np.arange(s) for s in size])
            at = starts[part][row] + column
            e, y = np.zeros((len(part), int(size.max()), 3)), np.full((len(part), int(size.max())), OUTSIDE)
            e[row, column], y[row, column] = w_own[own[at]].sum(axis=1) + w_codes[codes[at]].sum(axis=1), tags[at]
            token, moved = gradient(e, steps, size, y)
            g = token[row, column]
            for weights, square, which in ((w_own, squares[0], own[at] % len(w_own)), (w_codes, squares[1], codes[at])):
                total = np.stack([np.bincount(which.ravel(), np.repeat(g[:, k], which.shape[1]), len(weights)) for k in range(3)], 1)
                square += total * total
                weights += RATE * total / np.sqrt(square)
            w_own[-1] = 0  # stands for no feature
            squares[2] += moved * moved
            steps += RATE * moved / np.sqrt(squares[2])
    return Field(names, w_own, w_codes, steps)


Spans = list[tuple[int, int, int]]


def spans_of(text: str | None, field: Field, reader: Reader) -> tuple[Spans, Spans]:
    """(base spans, all spans) as (start, kind, end), sorted."""
    return all_spans([text], field, reader)[0]


def all_spans(texts: list[str | None], field: Field, reader: Reader) -> list[tuple[Spans, Spans]]:
    """`spans_of` each text."""
    return [_merged(sorted(base_spans(t)), found) if t else ([], []) for t, found in zip(texts, field.spans_of_all([t or "" for t in texts], reader))]


def _merged(base: Spans, found: list[tuple[int, int]]) -> tuple[Spans, Spans]:
    added, at, most = [], 0, 0  # both are sorted: base spans that begin before an added one ends, and how far they reach
    for lo, hi in found:
        while at < len(base) and base[at][0] < hi:
            most = max(most, base[at][2])
            at += 1
        if most <= lo:
            added.append((lo, 3, hi))
    return base, sorted(base + added)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        reader = field.value.reader()
        for b in batches:
            for part in parts(b.column(1)):
                cols: list[list] = [[] for _ in range(6)]
                for base, every in all_spans(b.column(1)[part.start : part.stop].to_pylist(), field.value, reader):
                    for i in range(3):
                        cols[i].append(sum(k == i for _, k, _ in base))
                    cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    cols[4].append(_joined(every))
                    cols[5].append(len(every) - len(base))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


MASK = "[SECRET]"


def masked(text: str | None, field: Field, reader: Reader, mask: str = MASK) -> str | None:
    """The text with every span (overlapping ones as one) replaced."""
    return _masked(text, spans_of(text, field, reader)[1], mask)


def _masked(text: str | None, spans: Spans, mask: str = MASK) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with secrets in `text` masked and `n_chars`, if it is there, set to the new length; other columns as they are."""
    field = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index("text")

    def run(batches):
        reader = field.value.reader()
        for b in batches:
            for some in parts(b.column(at)):
                part = b.slice(some.start, some.stop - some.start)
                texts = part.column(at).to_pylist()
                texts = pa.array([_masked(t, every) for t, (_, every) in zip(texts, all_spans(texts, field.value, reader))], pa.string())
                yield part.set_column(at, part.schema.field(at).with_type(pa.string()), texts)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
