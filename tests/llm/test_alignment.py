"""Cross-tokenizer alignment against whole texts encoded one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quillspark.llm import alignment

pytest.importorskip("tokenizers")


def plain(rows, v):
    """The contract, text by text, by sets of byte offsets."""
    found, count = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
            whole = (" " + text).encode()
            a_bytes, b_bytes = [v.a_bytes[t].as_py() for t in a], [v.b_bytes[t].as_py() for t in b]
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                ends = [set(), set()]
                for side, cells in enumerate((a_bytes, b_bytes)):
                    at = 0
                    for c in cells:
                        at += len(c)
                        ends[side].add(at)
                shared, x, y, at_a, at_b = ends[0] & ends[1], [], [], 0, 0
                left = list(zip(b, b_bytes, strict=True))
                for t, c in zip(a, a_bytes, strict=True):
                    x.append(t)
                    at_a += len(c)
                    if at_a in shared:
                        while at_b < at_a:
                            u, c = left.pop(0)
                            y.append(u)
                            at_b += len(c)
                        groups.append((x, y))
                        x, y = [], []
                assert not left
        count.update((x[-1], y[-1]) for x, y in groups)
        found.append((i, groups))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((i, *sizes, len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), written))
    return out, count


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    parts = ["the", "tokenisation", "réeux", "naïve", "漢字かな", "don't", "we'll", "12345", "x=1;", "<|endoftext|>", "</s>", "<0x0A>", "a　b", " ", "\xa0", " ", "\x85", "\x1c", "\x00", "…“q”", "🙂🙂", "é", "ﬁ½", "A" * 40]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\n\n  ", " \n ", "\t", "", "\r\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += [None, "", " ", "  ", "a ", " a", "a  ", "\n", "plain ▁ mark", "▁", "x" * 5000, "word " * 4000, "﻿bom", "a\n b", texts[0], texts[0]]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id here"), (3, texts[3])]


@pytest.mark.parametrize("piece", [6_000_000, 2000])
def test_equals_whole_texts(spark, rows, piece):
    v = alignment.vocabularies(alignment.A_FILE, alignment.B_FILE)
    want, count = plain(rows, v)
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, n_a int, groups string").repartition(5)
    done = alignment.Alignment(docs, piece_bytes=piece)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got = [tuple(r[n] for n in names) for r in done.documents(groups=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    hashed = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in want]
    assert sorted((tuple(r[n] for n in (*names[:7], "groups_sha256")) for r in done.documents().collect()), key=repr) == sorted(hashed, key=repr)
    links = done.links().collect()
    assert {(r.a, r.b): r.n for r in links} == dict(count) and len(links) == len(count)
    assert any(r.identity for r in links) and not all(r.identity for r in links)
    assert all((v.a_bytes[r.a] == v.b_bytes[r.b]) == r.identity for r in links)
    zeros = [r for r in want if not r[7]]
    assert {r[0] for r in zeros} >= {300, 301, 308, 309}  # null, empty, two with a mark


def test_segments_alone():
    """Segments together have the groups that each has alone."""
    import pyarrow as pa

    v = alignment.vocabularies(alignment.A_FILE, alignment.B_FILE)
    segments = pa.array([b" the", b" tokenisation", b" ", b"  \n", " réeux".encode()], pa.large_binary())
    g = alignment.Groups(v, segments)
    assert g.whole.all()
    for k, cell in enumerate(segments.to_pylist()):
        one = alignment.Groups(v, pa.array([cell], pa.large_binary()))
        assert (one.n_a[0], one.n_b[0], one.n_groups[0], one.written[0].as_py()) == (g.n_a[k], g.n_b[k], g.n_groups[k], g.written[k].as_py())


def test_empty_table(spark):
    none = alignment.Alignment(spark.createDataFrame([], "doc_id long, text string"))
    assert none.documents().collect() == [] and none.links().collect() == []
