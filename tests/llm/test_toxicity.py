"""The string kernel against enumerated subsequences; the classifier by held-out accuracy and odd rows."""

import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import toxicity

TABLES = os.environ.get("TOXICITY_SF_DIR", "/root/testdata/sf0.1")
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
INSULTS = ["idiot", "worthless", "scum", "pathetic"]


def enumerated(word):
    """Subsequences of three letters with their weights, scaled as a word of this length is."""
    c = [0, *word, 0]
    found, norm = {}, 0.0
    for i, j, k in itertools.combinations(range(len(c)), 3):
        if k - i < toxicity.SPAN:
            w = toxicity.GAP ** (k - i - 2)
            found[c[i], c[j], c[k]] = found.get((c[i], c[j], c[k]), 0) + w
            norm += w * w
    return {t: w / norm**0.5 for t, w in found.items()}


def test_kernel_equals_enumeration():
    rng = random.Random(2)
    landmarks = ["idiot", "scum", "réeuxpa", "no"]
    words = ["".join(rng.choice("idiotscuméx") for _ in range(rng.randint(1, 12))) for _ in range(300)] + landmarks
    at, rows = toxicity.Kernel(landmarks).rows(words)
    got = np.zeros((len(words), len(landmarks)))
    got[at] = rows
    own = [enumerated(x) for x in landmarks]
    for w, row in zip(words, got, strict=True):
        mine = enumerated(w)
        plain = [sum(v * x.get(t, 0) for t, v in mine.items()) for x in own]
        assert np.allclose(row, [p**toxicity.POWER if p >= toxicity.LEAST else 0 for p in plain], atol=1e-4) or any(abs(p - toxicity.LEAST) < 1e-5 for p in plain)
    assert len(at) < len(words)


def test_sentences():
    s = toxicity.Sentences(pa.array(["One two. Three", None, "", "a b c d. e f " + "w " * 65, "i d", "!!"]))
    assert s.texts == 6 and s.owner.tolist() == [0, 0, 3, 3, 3, 3, 4, 5]
    assert s.spelled == ["abcdef" + "w" * 65]
    assert [s.words[i] for i in s.ids[:3]] == ["one", "two", "three"]


def invented(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words, bad = invented(rng, rng.randint(20, 200)), rng.random() < 0.3
        if bad:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((i, " ".join(w + rng.choice(["", "", "", ".", ","]) for w in words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_gapped_and_inserted_insults(sample):
    rows, labels = sample
    y = np.array([bool(b) for _, b in labels])
    model = toxicity.Model([t for _, t in rows], y, np.arange(len(rows)) % 3 > 0)
    clean = "thereon ander stiones of the heedan torisat"
    for insult in ("idiot", "IDIOT!!", "i d i o t", "i.d.i.o.t", "id-iot", "idiiot", "worthxless", "pathettic", "scumm"):
        assert model.score(pa.array([f"{clean} {insult} {clean}"]))[0] > 0.5, insult
    assert (model.score(pa.array([clean, "", None, "a t a o n e s " * 30])) < 0.5).all()


def test_odd_rows(spark, sample):
    rows, labels = sample
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, "x" * 30_000), (1004, rows[5][1] + " \x00 " + "the " * 20_000), (None, "idiot " * 5), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, 0.5, True, "en") for i, t in rows + odd], "doc_id long, text string, toxic int, score double, held_out boolean, y string").repartition(4)
    marks = spark.createDataFrame([*[(i, b, 1) for i, b in labels], (None, 1, 1), (7, None, 0), (8, labels[8][1], 0), (5000, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, marks, piece_bytes=20_000).collect()
    assert len(got) == len(rows) + len(odd)
    known = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert known[1000].score == known[1001].score == known[1002].score < 0.5 < known[None].score
    held = [(known[i].predicted, b) for i, b in labels if known[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # Neither held-out labels nor the order of rows are looked at.
    turned = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs.orderBy("text"), turned, piece_bytes=1_000_000).collect()}
    assert all(abs(again[i] - known[i].score) < 1e-9 for i in known)


def test_nothing_to_learn(spark, sample):
    rows, labels = sample
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i, _ in rows[:20]], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, one).collect()} == {1.0}
    assert toxicity.score_documents(docs.limit(0), one).collect() == []


@pytest.mark.skipif(not os.path.exists(TABLES), reason="given tables")
def test_held_out_accuracy_of_the_given_tables(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    got = toxicity.score_documents(docs, labels).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    # Some labels are wrong: of the toxic documents in English, 18 of 279 hold no insult.
    assert len(toxic) > 80 and sum(toxic) / len(toxic) > 0.85
    assert sum(clean) / len(clean) < 0.01
