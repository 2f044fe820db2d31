"""Line frequencies, hard negatives and vector codes against plain versions, with the awkward rows of their contracts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import op11_line_frequency, op12_radix_negatives, op13_vector_codes
from tests.llm.test_operators import AWKWARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(text):
    return [x for x in (text or "").split("\n") if WORD.search(x)]


def plain_normal(line):
    plain = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")
    return plain or re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")


def plain_judge(rows):
    """(doc_id, host, text) -> the verdicts and measures, by plain counting."""
    having, hosts, out = defaultdict(set), defaultdict(set), []
    for _, host, text in rows:
        for x in plain_lines(text):
            having[host, plain_normal(x)].add(text)
            hosts[host].add(text)
    over = {k for k, texts in having.items() if len(texts) > op11_line_frequency.LEAST_DOCS and len(texts) > len(hosts[k[0]]) * op11_line_frequency.SHARE}
    for i, host, text in rows:
        w, x = WORD.findall(text or ""), plain_lines(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k for j in range(len(w) - 2) if windows[w[j], w[j + 1], w[j + 2]] > 1 for k in (j, j + 1, j + 2)}
        gone = sum(len(y) for y in x if (host, plain_normal(y)) in over)
        share = gone / sum(map(len, x)) if x else 0.0
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(x) - len(set(x)), len(covered), failed, round(share, 9), not failed and share <= 0.7))
    return out, over


def lined(rng, n):
    return "\n".join(prose(rng, rng.randint(4, 12)) + rng.choice(("", ".", " #1", " | <b>")) for _ in range(n))


@pytest.fixture(scope="module")
def pages_of_hosts():
    rng, rows = random.Random(5), []
    menu, foot = "Home | About  us | Contact!", "all RIGHTS reserved, 2024"
    for i in range(60):
        text = lined(rng, rng.randint(2, 14))
        if i % 2:
            text = f"{menu}\n{text}\n{foot.lower() if i % 4 == 1 else foot}"
        rows.append((i, ("a", "b", None)[i % 3], text))
    passage = prose(rng, 60)
    rows += [(100 + i, "a", f"{passage}\n{prose(rng, 4)}") for i in range(8)]  # nothing but a frequent passage
    rows += [(120 + i, "c", rows[0][2]) for i in range(9)]  # copies of a text: no frequent lines
    rows += [(200 + i, "b", t) for i, t in enumerate(AWKWARD)] + [(None, "a", rows[1][2]), (3, "b", rows[3][2]), (300, "a", "one two three " * 40), (301, "b", "-----\n=====\n" + lined(rng, 9) + "\n-----")]
    return rows


def test_lines_equal_a_plain_version(spark, pages_of_hosts):
    # other columns may have names of our own
    frame = spark.createDataFrame([(*r, "x", 1) for r in pages_of_hosts], "doc_id long, source string, text string, h string, chars long")
    want, over = plain_judge(pages_of_hosts)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.removed_share, 9), r.kept) for r in op11_line_frequency.judge(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x for _, x in over} >= {"home about us contact", "all rights reserved 2024"} and all(not k for i, *_, k in want if i in range(100, 108))
    assert all(k for i, *_, f, _, k in want if i in range(120, 129) and not f)
    cleaned = op11_line_frequency.clean(frame)
    assert cleaned.columns == frame.columns
    kept = {(w[0], r[2]) for w, r in zip(want, pages_of_hosts) if w[-1]}
    plain = Counter((i, h, "\n".join(x for x in t.split("\n") if not WORD.search(x) or (h, plain_normal(x)) not in over)) for i, h, t in pages_of_hosts if (i, t) in kept)
    assert Counter((r.doc_id, r.source, r.text) for r in cleaned.collect()) == plain


def test_lines_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    assert op11_line_frequency.judge(frame).count() == op11_line_frequency.clean(frame).count() == 0


# --- 12 hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, block int"


def awkward_vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) + rng.standard_normal((1, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i % (n // 2)].tolist() if i % 3 == 0 else x[i].tolist(), int(rng.integers(labels)), 1) for i in range(n)]  # copies, so ties
    rows += [(n + 1, None, 1, 1), (n + 2, [None] * dim, 1, 1), (n + 3, [math.nan] + [0.0] * (dim - 1), 1, 1), (n + 4, [math.inf] * dim, 1, 1), (n + 5, [0.0] * dim, 1, 1), (n + 6, [], 1, 1)]
    return rows


def plain_negatives(rows, every):
    kept = {}
    for i, v, y, *_ in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (y, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, (z, w) in kept.items() if i != a and len(w) == len(v))
        for p, i, z in [s for s in scored if s[2] == y][:5]:
            hard = [(-s, j) for s, j, z in scored if z != y and -80 * p <= -100 * s <= -100 * p][:5]
            out += [(a, i, k, j, -p, s) for k, (s, j) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows_", "anchors"), [(16, 3), (8192, 512)])
def test_hard_negatives_equal_a_plain_version(spark, monkeypatch, rows_, anchors):
    rows = awkward_vectors(150, 8, 1)
    rows += [(None, [1.0] * 8, 1, 1), (77, [0.5] * 8, None, 1), (4, rows[4][1], 2, 1), (4, rows[9][1], 0, 1), (310, [300.0] * 8, 1, 1), (320, [0.1, 0.2], 1, 1), (330, [0.1, 0.3], 1, 1), (331, [0.1, 0.25], 2, 1)]
    monkeypatch.setattr(op12_radix_negatives, "ANCHOR_EVERY", 10)
    monkeypatch.setattr(op12_radix_negatives, "ROWS", rows_)
    monkeypatch.setattr(op12_radix_negatives, "ANCHORS", anchors)
    got = op12_radix_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want = plain_negatives(rows, 10)
    assert len(want) > 60 and sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == want


def test_hard_negatives_of_equal_vectors_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(op12_radix_negatives, "ANCHOR_EVERY", 10)
    rows = [(i, [0.5, 0.25], i % 2, 1) for i in range(40)]  # all scores tie: the smallest vec_ids
    got = op12_radix_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == plain_negatives(rows, 10)
    assert op12_radix_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert op12_radix_negatives.mine(spark.createDataFrame([(10, [1.0, 0.0], 1, 1)], VECTORS)).count() == 0


def test_inner_products_are_exact_beyond_doubles():
    a, b = np.full((2, 8), (1 << 29) - 1), np.full((3, 8), (1 << 29) - 3)
    assert (op12_radix_negatives.inner(a, b) == 8 * ((1 << 29) - 1) * ((1 << 29) - 3)).all()


# --- 13 vector codes


def plain_codes(rows, rounds=2):
    kept = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for *_, v in kept], object).reshape(len(kept), 16, -1)
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:64]
    books = x[order].transpose(1, 0, 2).copy()

    def assign():
        away = ((x.transpose(1, 0, 2)[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
        code = np.array([[min(range(len(order)), key=lambda e: (away[p, r, e], e)) for r in range(len(x))] for p in range(16)])
        return code, np.array([[away[p, r, code[p, r]] for r in range(len(x))] for p in range(16)], object).sum(axis=0)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(16):
            for e in range(len(order)):
                own = x[code[p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, error = assign()
    per = defaultdict(int)
    for (_, y, _), e in zip(kept, error):
        per[y] += e
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in code[:, r]), int(error[r]), int(per[y]), digest) for r, (i, y, _) in enumerate(kept))


@pytest.mark.parametrize("n", [20, 130])
def test_codes_equal_a_plain_version(spark, n):
    rows = awkward_vectors(n, 32, 7)
    rows += [(None, rows[1][1], None, 1), (3, rows[3][1], 1, 1), (900, [4000.0] * 32, None, 1), (901, [-4000.5] * 32, 2, 1), (902, [0.001] * 32, 2, 1)]
    got = Counter(tuple(r) for r in op13_vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == plain_codes(rows)


def test_codes_of_none_and_of_odd_widths(spark):
    assert op13_vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert op13_vector_codes.compress(spark.createDataFrame([(1, [1.0] * 15, 1, 1), (2, None, 1, 1)], VECTORS)).count() == 0
    rows = [(1, [1.0] * 16, 1, 1), (2, [1.0] * 32, 1, 1), (3, [3.0] * 16, 1, 1)]
    assert sorted(r.vec_id for r in op13_vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()) == [1, 3]


@pytest.mark.parametrize("size", [3, 1 << 8, 1 << 16, 1 << 27])
def test_screening_keeps_the_nearest(size):
    """Entries that differ by little at large magnitudes, where float32 alone errs."""
    rng = np.random.default_rng(size)
    books = op13_vector_codes.Codebooks(size + rng.integers(-9, 9, (4, 64, 4)))
    x = size + rng.integers(-9, 9, (4, 200, 4))
    away = ((x[:, :, None, :] - books.entries[:, None, :, :]) ** 2).sum(axis=3)
    assert np.take_along_axis(books.screened(x), away.argmin(axis=2)[:, :, None], 2).all()
    code, error = books.nearest(x)
    assert (code == away.argmin(axis=2)).all() and (error == away.min(axis=2)).all()
    if size <= 1 << 8:
        assert books.screened(x).sum() < 0.2 * away.size
