"""Registered queries that SQL cannot express, over whole tables, against plain Python."""

import difflib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from quillspark import catalog
from quillspark.operators import text as op
from quillspark.plans import text as plans
from quillspark.sources.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return lambda name: catalog.queries()[name](spark, FOLDER).collect()


@pytest.fixture(scope="module")
def pages():
    """doc -> its pages of twelve lines, each line a paragraph."""
    out = {}
    for i, t in zip(*(pq.read_table(f"{FOLDER}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True):
        lines = t.split("\n")
        out[i] = ["\n\n".join(lines[k : k + 12]) for k in range(0, len(lines), 12)]
    return out


def passages(pages, target=1400, overlap=200, least=200):
    """(first page, last page, chapter, text) of a document's passages."""
    cleaned = []
    for number, page in enumerate(pages):
        for noise in (r"(?i)Reprint[ \t\n]*20[0-9]{2}[-–][0-9]{2}", r"(?m)^[ \t\n]*[0-9]{1,3}[ \t]*$", r"(?i)Rationalised[ \t\n]+20[0-9]{2}[-–][0-9]{2}"):
            page = re.sub(noise, " ", page)
        page = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", page)).strip()
        if page:
            cleaned.append((number, page))
    held, size, since, chapter = "", 0, 0, None

    def closed(upto):
        nonlocal held, size, since
        body = held.strip()
        if len(body) < least:
            held, size = "", 0
            return []
        made = [(since, upto, chapter, body)]
        held, since = body[-overlap:], upto
        size = len(held)
        return made

    for number, page in cleaned:
        head = re.search(r"(?m)^[ \t]*((?:CHAPTER|Chapter)[ \t]+[0-9]{1,2}(?![A-Za-z0-9])[^\n]{0,80})", page)
        if head:
            if size:
                yield from closed(number)
            chapter, since = re.sub(r"[ \t]+", " ", head.group(1)).strip(), number
        for para in filter(None, (p.strip() for p in re.split(r"\n[ \t]*\n", page))):
            if size and size + len(para) > target:
                yield from closed(number)
            held += ("\n" if held else "") + para
            size += len(para)
    if size:
        yield from closed(cleaned[-1][0])


def test_chunk_corpus(found, pages):
    want = {(doc, seq, *p) for doc, ps in pages.items() for seq, p in enumerate(passages(ps))}
    got = {(r.doc_id, r.seq, r.page_from, r.page_to, r.chapter, r.content) for r in found("t2_chunk_corpus")}
    assert got == want and len(want) > 200


def test_a_document_of_many_pages(spark):
    """A hundred thousand pages of one document beside small ones: the passages of the plain fold."""
    from pyspark.sql import functions as F

    n = 100_000
    words = F.repeat(F.concat(F.lit("page "), F.col("id").cast("string"), F.lit(" has words. ")), (F.col("id") % 9 + 1).cast("int"))
    text = F.concat(F.when(F.col("id") % 700 == 5, F.concat(F.lit("Chapter "), (F.col("id") % 90).cast("string"), F.lit(" Title\n\n"))).otherwise(""), words, F.lit("\n\nSecond paragraph "), F.col("id").cast("string"))
    pages = spark.range(n).select(F.lit("long").alias("doc_id"), F.col("id").cast("int").alias("page"), text.alias("text")).union(spark.createDataFrame([("short", 0, "y" * 300), ("tiny", 0, "z"), (None, 0, "w" * 500)], "doc_id string, page int, text string"))
    got = {(r.seq, r.page_from, r.page_to, r.chapter, r.content) for r in op.chunk_corpus(pages.repartition(7)).filter("doc_id = 'long'").collect()}

    def page(i):
        return (f"Chapter {i % 90} Title\n\n" if i % 700 == 5 else "") + f"page {i} has words. " * (i % 9 + 1) + f"\n\nSecond paragraph {i}"

    want = {(k, *p) for k, p in enumerate(passages(map(page, range(n))))}
    assert got == want and len(want) > 8000
    assert [r.doc_id for r in op.chunk_corpus(pages.filter("doc_id is null or doc_id != 'long'")).collect()] == ["short"]


def test_chunk_pages(found, pages):
    target, want = 1200, set()
    for doc, ps in pages.items():
        for number, page in enumerate(ps):
            units = []
            for p in filter(None, (x.strip(" \t\n") for x in re.split(r"\n[ \t]*\n", page))):
                if len(p) <= target * 1.5:
                    units.append(p + "\n")
                    continue
                for s in re.findall(r"[^.!?।॥]+[.!?।॥]*[ \t\n]*", p):
                    units += [s[k : k + target] for k in range(0, len(s), target)]
            held, out = "", []
            for u in units:
                if held and len(held) + len(u) > target:
                    out.append(held)
                    held = ""
                held += u
            whole = [c.strip(" \t\n") for c in [*out, held]]
            want |= {(doc, number, k, c) for k, c in enumerate(c for c in whole if len(c) >= 40)}
    got = {(r.doc_id, r.page, r.seq, r.content) for r in found("t3_chunk_pages")}
    assert got == want and len(want) > 200


def test_retrieve(spark, found):
    t = Tables(spark, FOLDER)
    asks = {r.query_id: r.text for r in plans._web(t).collect()} | {-1: "zzzz qqqq"}
    chunks = [(r.chunk_id, r.page, r.text.lower()) for r in plans._chunks(t).collect()]
    index = {i: Counter(re.findall("[a-z0-9]+", text)) for i, _, text in chunks}
    worth = lambda n: sum(1 / k**2 for k in range(1, n + 1))

    def search(text, part, n):
        low = text.lower()
        phrases, minus = re.findall('"([^"]+)"', low), re.findall("(?:^| )-([a-z0-9]+)", low)
        terms = list(dict.fromkeys(re.findall("[a-z0-9]+", re.sub("(^| )-[a-z0-9]+", " ", low))))
        hits = [(sum(worth(index[i][w]) for w in terms) / len(terms), i) for i, _, text in part if all(index[i][w] for w in terms) and not any(index[i][w] for w in minus) and all(f" {' '.join(re.findall('[a-z0-9]+', p))} " in f" {' '.join(re.findall('[a-z0-9]+', text))} " for p in phrases)]
        how = "all"
        if not hits:
            terms = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", low) if len(w) >= 3))[:8]
            hits, how = [(sum(worth(index[i][w]) for w in terms) / len(terms), i) for i, _, _ in part if any(index[i][w] for w in terms)], "any"
        return [(how, i) for _, i in sorted(hits, key=lambda x: (-round(x[0], 9), x[1]))[:n]]

    want = set()
    for q, text in asks.items():
        both = [("corpus", *x) for x in search(text, [c for c in chunks if c[1] < 8], 4)] + [("notes", *x) for x in search(text, [c for c in chunks if c[1] >= 8], 2)]
        want |= {(q, k, *x) for k, x in enumerate(both, 1)} or {(q, 0, "none", "nothing found", None)}
    assert {(r.query_id, r.number, r.source, r.method, r.chunk_id) for r in found("t8_retrieve")} == want and (-1, 0, "none", "nothing found", None) in want


def test_repeats(spark):
    rows = defaultdict(list)
    from pyspark.sql import functions as F

    from quillspark.functions import norm_stem

    lines = Tables(spark, FOLDER).docs.filter("doc_id < 25").select("source", F.explode(F.split("text", "\n")).alias("stem")).select("source", norm_stem(F.col("stem")).alias("norm")).filter("char_length(norm) >= 40")
    for r in lines.collect():
        rows[r.norm].append(r.source)
    stems = sorted(rows)
    letters = {s: Counter(s) for s in stems}
    alike, by_length = defaultdict(set), sorted(stems, key=len)
    for k, a in enumerate(by_length):
        for b in by_length[k + 1 :]:
            if 2 * len(a) < 0.82 * (len(a) + len(b)):
                break
            if 2 * (letters[a] & letters[b]).total() >= 0.82 * (len(a) + len(b)) - 1e-9:
                x, y = min(a, b), max(a, b)
                if len(set(rows[x] + rows[y])) > 1 and difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.82:
                    alike[y].add(x)
    want = {}
    for s in stems:
        free = [a for a in alike[s] if not alike[a]]
        anchor = min(free) if free else s
        sittings, n = want.setdefault(anchor, [set(), 0])
        want[anchor] = [sittings | set(rows[s]), n + len(rows[s])]
    got = {r.anchor: (r.sittings, r.questions) for r in op.repeats(lines.select(F.lit(0).alias("question_id"), F.col("source").alias("sitting"), F.col("norm").alias("stem"))).collect()}
    assert got == {a: (len(x - {None}), n) for a, (x, n) in want.items() if len(x - {None}) > 1} and got
