"""Importance resampling against plain Python on a small table with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import resampling

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def expected(rows, targets, share=(5, 100)):
    corpus, target = Counter(), Counter()
    for _, t in rows:
        corpus.update(runs(t)[1])
    for t in targets:
        target.update(runs(t)[1])
    s, t = sum(corpus.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        n, found = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * share[0] // share[1]])}
    return [(*r[:1], *r[2:], rank.get(id(r))) for r in out]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = ["alpha", "Beta9", "gämma", "δ", "x" * 31, "y" * 32, "z" * 33, "q" * 64, "r" * 4200, "7", "İstanbul", "naïve"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "--", "\x00", "_", " '"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \x00 "), (403, text(3000)), (404, "w" * 70_000), (None, text(30)), (5, rows[5][1])]
    return rows, [text(30) for _ in range(5)] + [None, ""]


def collected(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("piece", [4_000_000, 900])
def test_equals_plain_python(spark, corpus, piece):
    rows, targets = corpus
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, rank string, weight int").repartition(5)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    assert collected(resampling.resample(docs, target, piece_bytes=piece)) == sorted(expected(rows, targets), key=repr)


def test_small_block_inside_one_process(corpus, monkeypatch):
    """The blocks of a piece hold the same features as the piece; workers do not see a patched constant, so here."""
    texts = [(t or "").encode() for _, t in corpus[0]]

    def held():
        found = [Counter() for _ in texts]
        for own, bucket in resampling.features(texts):
            for o, b in zip(own.tolist(), [] if bucket is None else bucket.tolist(), strict=False):
                found[o][b] += 1
        return found

    whole = held()
    monkeypatch.setattr(resampling, "BLOCK", 3)
    assert held() == whole == [Counter(runs(t)[1]) for _, t in corpus[0]]


def test_checksums_are_put_together():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8)
    cuts = [(0, 1), (1, 40), (41, 64), (105, 4096), (4201, 262_144)]
    for at, size in cuts:
        ahead = np.array([zlib.crc32(b"some words")], np.uint32)
        own = resampling.checksums(data, np.array([at]), np.array([size]))
        assert own[0] == zlib.crc32(data[at : at + size].tobytes())
        assert (resampling.shifted(ahead, np.array([size])) ^ own)[0] == zlib.crc32(b"some words" + data[at : at + size].tobytes())


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string")
    rows = corpus[0][:50]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert collected(resampling.resample(some, none)) == sorted(expected(rows, []), key=repr)


def test_drawn_documents(spark, corpus):
    rows, targets = corpus
    docs = spark.createDataFrame([r for r in rows[:400]], "doc_id long, text string")
    ranked = resampling.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"), share=(1, 4))
    drawn = resampling.drawn_documents(docs, ranked).orderBy("rank").collect()
    want = sorted((r[4], r[0]) for r in expected(rows[:400], targets, (1, 4)) if r[4])
    assert [(r["rank"], r.doc_id) for r in drawn] == want and len(want) > 50
    assert all(r.text == rows[r.doc_id][1] for r in drawn)
