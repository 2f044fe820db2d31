"""The field on hand-written lines, and on texts of any length."""

import random
import tracemalloc

from tessera.llm import op10_secret_crf
from tests.llm.secret_lines import CLEAN, SECRET
from tests.llm.test_operators import prose


def read(line):
    """(text, begin and end of its secret)."""
    return line.replace("«", "").replace("»", ""), line.index("«"), line.index("»") - 1


def test_hand_written_lines():
    field = op10_secret_crf.trained()
    reader = field.reader()
    found = beyond = 0
    for line in SECRET:
        text, a, b = read(line)
        spans = op10_secret_crf.spans_of(text, field, reader)[1]
        found += all(any(x <= i < y for x, _, y in spans) for i in range(a, b))
        beyond += any(kind == 3 and (x < a - 20 or y > b + 20) for x, kind, y in spans)
    touched = [t for t in CLEAN if op10_secret_crf.spans_of(t, field, reader)[1]]
    assert found >= 0.95 * len(SECRET) and beyond <= 2 and len(touched) <= 2, (found, beyond, touched)


def test_probes():
    field = op10_secret_crf.trained()
    reader = field.reader()
    masked = lambda t: op10_secret_crf.masked(t, field, reader)
    for kept in ("123e4567-e89b-12d3-a456-426614174000 is a record", "https://example.com/a/b?c=Zx81kQ9"):
        assert masked(kept) == kept
    for text, secret in (("DB_PASS hunter2xyz!Q", "hunter2xyz!Q"), ("rk_live_51Habcdefghijklmnop", "51Habcdefghijklmnop"), ("use rk_live_51Habcdefghijklmnop here", "51Habcdefghijklmnop")):
        assert secret not in masked(text) and "[SECRET]" in masked(text)


def test_long_texts_are_tagged_in_segments(monkeypatch):
    field = op10_secret_crf.trained()
    reader, rng = field.reader(), random.Random(8)
    lines = [prose(rng, 8) for _ in range(300)]
    for i in range(0, 300, 30):
        lines[i] = read(SECRET[i // 30])[0]
    text = "\n".join(lines)
    whole = op10_secret_crf.spans_of(text, field, reader)
    for size in (700, 5000):  # lines are shorter: cuts change nothing
        monkeypatch.setattr(op10_secret_crf, "SEGMENT", size)
        assert op10_secret_crf.spans_of(text, field, reader) == whole
        assert list(op10_secret_crf.segments("x" * 2 * size)) == [(0, size), (size, 2 * size)]
    assert len(whole[1]) >= 9


def test_memory_does_not_follow_the_text():
    field = op10_secret_crf.trained()
    reader, rng = field.reader(), random.Random(9)
    body = "\n".join(prose(rng, 12) + f" a{i}b7 {rng.random()}" for i in range(2000))

    def peak(times):
        text = "\n".join([body] * times)
        tracemalloc.start()
        op10_secret_crf.spans_of(text, field, reader)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, len(text)

    small, n = peak(2)
    large, m = peak(16)
    assert m > 5e6 and large < small + 3 * (m - n)
