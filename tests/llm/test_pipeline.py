"""The pipeline's stages over the smallest tables."""

import random
import tempfile
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing, ngram_join, quality
from quillspark.llm.base import read, shared_folder, shelf, stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, FOLDER, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "stage")
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    first = kept["quality rules"]
    judged = quality.judge(read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels"))
    assert first.count() == judged.filter("kept").count()
    near = kept["n-gram Jaccard join"]
    assert near.select("doc_id").distinct().count() == near.count() <= first.count()
    secret = kept["secret scans"]
    assert secret.count() == near.count() and secret.filter(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count() == 0
    bins = kept["best-fit packing"]
    assert bins.filter("bin_id is not null").groupBy("bin_id").agg(F.sum("words").alias("w")).filter("w > 2048").count() == 0
    assert bins.agg(F.sum("words")).first()[0] == kept["mixing sources to target weights"].agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert corpus_pipeline.run(spark, FOLDER).count() == bins.count()


def test_tables_of_a_run_go(spark):
    """A shelf leaves nothing in the shared folder, a run of the pipeline its last stage's input and tables."""
    import os

    folder = shared_folder(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    with shelf(spark):
        n = ngram_join.join_documents(read(spark, FOLDER, "documents")).count()
        assert len(set(os.listdir(folder)) - there) > 5
    assert n == 200 and set(os.listdir(folder)) == there
    done = corpus_pipeline.run(spark, FOLDER)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - there}
    assert "mixing-sources-to-target-weights" in left and not left & {"quality-rules", "n-gram-Jaccard-join", "secret-scans", "edges", "labelled", "sized"}
    assert done.count() > 0


WORDS = [f"{a}{b}" for a in "ba de fi go hu ka le mi no pu".split() for b in "r s t n l".split()]


def test_odd_rows(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [prose(rng.randint(60, 200)) for _ in range(40)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in base[:10]]
    texts = [*base, *near, base[0], None, "", "few words", base[3] + " password=abcdEFGH1234"]
    rows = [(i, t, ["en", None][i % 2], ["s", None, "t"][i % 3], len(t or ""), "clash") for i, t in enumerate(texts)]
    rows += [rows[5], (None, base[7], "en", "s", 1, "clash"), (None, base[20] + " x", "en", "s", 1, "clash"), (1, prose(90), "en", "s", 1, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = stored(corpus_pipeline.quality_rules(spark, docs, folder), "one").collect()
    assert sorted((r.text for r in kept)) == sorted(t for _, t, *_ in rows if t and len(t.split()) >= 20)
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4))
    sets = list({shingles(r.text) for r in kept})
    head = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 75 * len(x | y):
                    head[i] = head[j] = min(head[i], head[j])
    one = spark.createDataFrame(kept)
    two = stored(corpus_pipeline.near_duplicates(spark, one, folder), "two")
    left = two.collect()
    assert sorted(head[sets.index(shingles(r.text))] for r in left) == sorted(set(head)) and len(set(head)) < len(kept) - 10
    assert {(r.doc_id, r.text) for r in left} <= {(r.doc_id, r.text) for r in kept}
    three = stored(corpus_pipeline.secret_scans(spark, two, folder), "three")
    masked = lambda t: t.replace("password=abcdEFGH1234", "[SECRET]")
    assert sorted(r.text for r in three.collect()) == sorted(masked(r.text) for r in left)
    four = stored(corpus_pipeline.mixed(spark, three, folder), "four")
    size = lambda rs: {s: sum(len(r.text.split()) for r in rs if r.source == s) for s in ("s", "t", None)}
    has, took = size(three.collect()), size(four.collect())
    want = mixing.quotas({s: n for s, n in has.items() if n})
    assert all(abs(took[s] - want[s]) <= 201 for s in want)
    five = corpus_pipeline.packed(spark, four, folder).collect()
    bins = Counter()
    for r in five:
        bins[r.bin_id] += r.words
    assert max(bins.values()) <= 2048 and sum(bins.values()) == sum(took.values()) and len({(r.bin_id, r.cluster) for r in five}) == len(five)
    nothing = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stored(stage(spark, nothing, folder), "nothing")
        assert nothing.count() == 0
