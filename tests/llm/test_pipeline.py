"""The pipeline's stages, each on what the one before kept."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import op5_bpe_lexicon, op9_mixing, op10_secret_crf
from tests.llm.test_operators import AWKWARD, DOCS, plain_base, plain_groups, plain_targets, plain_toxicity, prose

DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        out = common_store(spark, stage(spark, docs, DIR), name)
        seen.append((name, len(before), out.count()))
        if name != "bpe_encoding":
            assert out.columns == columns
            ids = {i for i, _ in before}
            assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        if name == "minhash_near_dedup":
            assert out.groupBy("text").count().where("count > 1").count() == 0
        if name == "secret_scan":
            field = op10_secret_crf.trained()
            reader = field.reader()
            assert all(op10_secret_crf.masked(t, field, reader) == m for (_, t), m in zip(sorted(before), [r.text for r in out.orderBy("doc_id", "text").collect()]))
        if name == "mixing":
            plan = op9_mixing.plan(docs).agg(F.sum("copies")).first()[0]
            assert out.count() == plan
        if name == "bpe_encoding":
            lookup = dict(before)
            tokenizer = op5_bpe_lexicon.Tokenizer(op5_bpe_lexicon.default_path())
            encoder = op5_bpe_lexicon.Encoder(tokenizer, None)
            assert all(bytes(r.ids) == encoder.encode(lookup[r.doc_id]) for r in out.collect())
        docs = out
    assert [n for n, _, _ in seen] == ["toxicity", "minhash_near_dedup", "secret_scan", "mixing", "bpe_encoding"]


def common_store(spark, df, name):
    from tessera.llm.common import stored

    return stored(df, f"test-{name}")


def test_run_equals_a_plain_version(spark, tmp_path):
    """All stages over a small folder of tables, against plain versions of each one after the other."""
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(77)
    free = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 4 == 2]
    texts = []
    for i in range(70):
        words = prose(rng, rng.randint(12, 30)).split()
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["Scumbag", "scumbags!"])
        texts.append(" ".join(words))
    y = [int(i % 4 == 0) for i in range(70)]
    for i in range(10):  # near copies, one of them with a secret
        words = texts[i * 4 + 1].split()
        words[3] = 'password="q8ZpW4Xk29fL"' if i == 2 else "changed"
        texts.append(" ".join(words))
    texts += [prose(rng, 20) + " scumbag", prose(rng, 15) + " login: abcdefgh$ijkl12345, bye", prose(rng, 15), *AWKWARD, texts[1], None, prose(rng, 300)]
    ids = free[:70] + sorted(free[70:90] + held)[: len(texts) - 70]
    sources = [("a", "b", "c", "a", None)[i % 5] for i in range(len(texts))]
    rows = sorted(zip(ids, texts, ["en"] * len(texts), sources, [len(t or "") for t in texts]))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, v) for i, v in zip(ids, y)] + [(h, 1, 1) for h in held if h not in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    scores = plain_toxicity(texts, y)
    kept = sorted((i, t, s) for i, t, s, score in zip(ids, texts, sources, scores) if score is None or score < 0.3)
    assert 0 < len(kept) < len(texts)
    group = plain_groups([t for _, t, _ in kept])
    kept = [r for k, r in enumerate(kept) if group[k] == k]
    field = op10_secret_crf.trained()
    reader, clean = field.reader(), []
    for i, t, s in kept:
        spans = []
        if t:
            tokens = reader(t)
            e = field.emissions(tokens, reader)
            for lo, hi in zip(tokens.pieces, [*tokens.pieces[1:], len(e)]):  # every piece is decoded
                for j, tag in enumerate(field.viterbi(e[lo:hi]), lo):
                    if tag == 0:
                        spans.append((int(tokens.start[j]), int(tokens.end[j])))
                    elif tag == 1:
                        spans[-1] = (spans[-1][0], int(tokens.end[j]))
        base = [(a, b) for a, _, b in plain_base(t)]
        spans = sorted(base + [(a, b) for a, b in spans if not any(x < b and a < y for x, y in base)])
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        clean.append((i, t if t is None else out + t[at:], s))
    assert sum("[SECRET]" in (t or "") for _, t, _ in clean) >= 1
    sizes: dict = {}
    for _, t, s in clean:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = plain_targets(sizes)
    library = tokenizers.Tokenizer.from_file(op5_bpe_lexicon.default_path())
    want = Counter()
    for i, t, s in clean:
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids_ = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids_, skip_special_tokens=False)
        want[i, len(ids_), np.array(ids_, "<u4").tobytes(), hashlib.sha256(decoded.encode()).hexdigest()] += int(rate) + (draw < rate - int(rate))
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
