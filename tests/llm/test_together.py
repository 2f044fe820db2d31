"""Texts that are worked on together: as alone, and what they share is worked on once."""

import sys

import numpy as np
import pyarrow as pa

from tessera.llm import common, op5_bpe_lexicon, op8_toxicity, op10_secret_crf
from tests.llm.secret_lines import CLEAN, SECRET

ODD = [None, "", " \n\t", "one", "\x1cΣσς a", "İ secret K", "token", "= abc", "x" * 300, "<|endoftext|> é", "a\n", "\r\n b"]


def test_parts_leave_nothing_out():
    texts = pa.array([*ODD, "y" * 50, "z"])
    got = list(common.parts(texts, 40))
    assert [i for p in got for i in range(p.start, p.stop)] == list(range(len(texts))) and len(got) > 3
    assert list(common.parts(texts)) == [slice(0, len(texts))] and not list(common.parts(pa.array([], pa.string())))


def test_words_are_merged_once_for_all_chunks():
    tokenizer = op5_bpe_lexicon.Tokenizer(op5_bpe_lexicon.default_path())
    words = ["the", "quux", "quick", "é", "thequick"]
    lexicon = op5_bpe_lexicon.Lexicon(op5_bpe_lexicon.Lexicon.compile({w.encode(): np.array(tokenizer.merged(w), "<u4").tobytes() for w in words}))
    asked = [w.encode() for w in (*words, "th", "zz", "", "quickly", "thé")]
    assert lexicon.lookups(asked) == [lexicon.lookup(w) for w in asked] and lexicon.lookups([]) == []
    assert op5_bpe_lexicon.Lexicon(op5_bpe_lexicon.Lexicon.compile({})).lookups([b"a", b""]) == [None, None]
    texts = [*ODD, "quux; quux. (quux) zzyzx zzyzx; (zzyzx) zzyzx!", "the zzyzx? quick"]
    together, alone = op5_bpe_lexicon.Encoder(tokenizer, lexicon), op5_bpe_lexicon.Encoder(tokenizer, None)
    assert together.encode_all(texts) == [alone.encode(t) for t in texts]
    before = together.seen[1]
    together.encode_all(["wwyzx; (wwyzx) wwyzx! wwyzx wwyzx."])
    assert together.seen[1] == before + 1  # the marks are known


def test_terms_of_many_texts_are_those_of_each():
    texts = [*ODD, "Walking, walked_walks; one-two", "walking walking WALK!"]
    places = {t: i for i, t in enumerate(["walking", "walk^", "one", "two", "walk", "secret", "secr^"])}
    at, found, counts = op8_toxicity.Reader(places)(texts)
    for i, t in enumerate(texts):
        want = [places[x] for c in (t or "").lower().split() for x in op8_toxicity.terms_of(c) if x in places]
        assert [found[at[i] : at[i + 1]].tolist(), counts[at[i] : at[i + 1]].tolist()] == [x.tolist() for x in np.unique(np.array(want, int), return_counts=True)]
    assert at[-1] == len(found) and len(at) == len(texts) + 1


def calls_of(work):
    """How many Python functions the work calls, and what it gives."""
    seen = []
    sys.setprofile(lambda frame, event, arg: seen.append(1) if event == "call" else None)
    try:
        got = work()
    finally:
        sys.setprofile(None)
    return len(seen), got


def test_letters_of_words_and_calls_of_reading():
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    places = {"ab": 0, "ab𐐷é": 1, "ab𐐷é^": 2, "ß": 3, "abcd^": 4}
    read = op8_toxicity.Reader(places)
    at, found, counts = read([f"ab{c}ab" for c in every])
    want = [op8_toxicity.WORD.findall(f"ab{c}ab".lower()).count("ab") for c in every]
    assert np.bincount(np.repeat(np.arange(len(every)), np.diff(at))[found == 0], counts[found == 0], len(every)).tolist() == want
    got = read(["AB𐐷É ab𐐷é, ab𐐷éx_ß", "", None, "ab-abcde;ab", "abcd"])
    assert [x.tolist() for x in got] == [[0, 3, 3, 3, 5, 5], [1, 2, 3, 0, 4], [2, 1, 1, 2, 1]]
    n, _ = calls_of(lambda: read([f"word{i} other{i}, more{i}" for i in range(5000)]))
    assert n < 5_500  # none for each word


def test_votes_of_many_texts_are_those_of_each(monkeypatch):
    gen = np.random.default_rng(3)
    rows = [np.unique((200 * gen.random(gen.integers(1, 40)) ** 2).astype(int), return_counts=True) for _ in range(400)]
    rows[7] = rows[8] = rows[9]
    index = op8_toxicity.Index(np.arange(200, dtype=np.uint64), gen.random(200) + 1, np.where(gen.random(200) < 0.6, op8_toxicity.LEAST_RELEVANCE, gen.random(200) + 0.1), {}, (gen.random(300) < 0.3).astype(float), np.arange(300))
    index.add(np.repeat(np.arange(300), [len(t) for t, _ in rows[:300]]), *(np.concatenate(x) for x in zip(*rows[:300])))
    dense = np.zeros((400, 200))
    for i, (t, c) in enumerate(rows):
        dense[i, t] = index.vector(t, c)
    stressed = dense * index.relevance
    stressed /= np.linalg.norm(stressed, axis=1)[:, None]
    rows += [(np.zeros(0, int), np.zeros(0, int))]
    at = np.cumsum([0, *(len(t) for t, _ in rows)])
    terms, counts = (np.concatenate(x) for x in zip(*rows))

    def compared(*args):
        got = list(op8_toxicity._compared(index, *args))
        near, done = [], 0
        for text, found, sims, votes in got:
            near += [(found[text == i].tolist(), sims[text == i].tolist()) for i in range(len(votes))]
            done += len(votes)
        return near, np.concatenate([v for *_, v in got]), len(got)

    index.ready()
    n, (near, votes, runs) = calls_of(lambda: compared(at, terms, counts))
    assert n < 4 * len(rows)  # few for each text
    assert near[-1] == ([], []) and votes[-1] == index.labels.mean()
    for i in range(400):
        sims = np.round(dense[:300] @ dense[i], 9)
        k = op8_toxicity.NEAREST + int(sims.max() >= op8_toxicity.ALIKE)
        want = np.flatnonzero((sims > 0) & (sims >= np.sort(sims)[-k]))
        want = want[np.lexsort((want, -sims[want]))]
        assert near[i][0] == want.tolist() and near[i][1] == sims[want].tolist()
        alike = sims[want] >= op8_toxicity.ALIKE
        weight = np.round(stressed[want] @ stressed[i], 9) ** 2 * np.where(alike, (alike.sum() - 1) / max(1, alike.sum()), 1)
        prior = op8_toxicity.PRIOR_VOTES
        assert abs(votes[i] - (prior * index.labels.mean() + weight[index.labels[want] > 0].sum()) / (prior + weight.sum())) < 1e-7
    assert near[7] == near[8] == near[9] and votes[7] == votes[8] == votes[9]
    monkeypatch.setattr(op8_toxicity, "HELD", 1)  # each text alone
    alone = compared(at, terms, counts)
    assert alone[0] == near and (alone[1] == votes).all() and runs < alone[2] == len(rows)


def test_secrets_of_many_texts_are_those_of_each(monkeypatch):
    field = op10_secret_crf.trained()
    reader, alone = field.reader(), field.reader()
    texts = [*ODD, *(t.replace("«", "").replace("»", "") for t in SECRET + CLEAN), *ODD]
    want = [op10_secret_crf.spans_of(t, field, alone) for t in texts]
    calls = []
    monkeypatch.setattr(op10_secret_crf.Reader, "__call__", lambda self, *a, f=op10_secret_crf.Reader.__call__, **b: calls.append(1) or f(self, *a, **b))
    assert op10_secret_crf.all_spans(texts, field, reader) == want and sum(len(s) for _, s in want) > 50
    assert len(calls) < 5
