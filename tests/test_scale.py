"""What must not grow with a table: shuffles, copies of a step, what a task or a batch holds."""

from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.operators import joins, search, text
from quillspark.sources.bindings import Tables, option_list

FOLDER = "/root/testdata/sf0.001"
plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
root = lambda spark: Path(spark.conf.get("spark.checkpoint.dir"))


def test_parsed_papers_are_made_without_joining_options(spark):
    before = set(root(spark).glob("parsed-*"))
    catalog.queries()["s1_parsed_options"](spark, FOLDER)
    (made,) = set(root(spark).glob("parsed-*")) - before
    files = [f.name for f in made.iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)


def test_options_in_a_row_are_the_options(spark):
    t = Tables(spark, FOLDER)
    a = t.questions.select("question_id", "paper_id", F.inline(option_list()))
    assert sorted(map(str, a.collect())) == sorted(map(str, t.options.collect()))


def test_options_are_grouped_where_they_are(spark):
    t = Tables(spark, FOLDER)
    assert plan(t.options.groupBy("question_id").count()).count("Exchange hash") == plan(t.dealt("question_id")).count("Exchange hash")


def test_a_blueprint_is_broadcast(spark):
    q = spark.range(10).select(F.lit("I").alias("part"), F.col("id").alias("number"))
    out = joins.place(q, spark.createDataFrame([("I", "A", 1, 2)], "part string, subject string, first long, last long"))
    assert "strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()


def test_sections_do_not_find_our_answers_anew(spark):
    assert "lineitem" not in plan(catalog.queries()["q17_verify_sections"](spark, FOLDER))


def test_sections_are_identified_where_papers_are_dealt(spark):
    t = Tables(spark, FOLDER)
    assert plan(catalog.queries()["q18_identify_section"](spark, FOLDER)).count("Exchange hash") <= 2 * plan(t.dealt("paper_id")).count("Exchange hash")


def test_an_export_finds_once_what_ships(spark):
    before = set(root(spark).glob("judged-*"))
    catalog.queries()["s5_export_bundle"](spark, FOLDER)
    assert len(set(root(spark).glob("judged-*")) - before) == 1


def test_stems_are_made_normal_once(spark):
    assert "documents" not in plan(catalog.queries()["q4_dup_stems"](spark, FOLDER))


def test_postings_and_runs_are_made_in_pieces():
    texts = [f"word{i} " * 40_000 for i in range(30)] + ["ab", "a", ""]
    ids, zero = pa.array(range(33), pa.int64()), pa.array([0] * 33, pa.int32())
    given = pa.RecordBatch.from_arrays([ids, zero, pa.array(texts), zero], names=["chunk_id", "page", "text", "slice"])
    made = list(search._posted(search.Words())([given]))
    assert len(made) > 5 and sum(sum(b.column("tf").to_pylist()) for b in made) == 30 * 40_000 + 2
    hay = pa.RecordBatch.from_arrays([pa.array(map(str, range(33))), zero, pa.array(texts)], names=["item_id", "slice", "hay"])
    made = list(search._grams([hay]))
    got = {(i, g) for b in made for g, items in zip(b.column("gram").to_pylist(), b.column("items").to_pylist(), strict=True) for i in items}
    assert len(made) > 5 and got == {(str(i), x[k : k + n]) for i, t in enumerate(texts) for x in [t[:40]] for n in (1, 2, 3) for k in range(len(x) - n + 1)}


def test_an_index_is_written_where_its_chunks_are_read(spark):
    texts = spark.createDataFrame([(i, 0, f"the word{i} the") for i in range(12)], "chunk_id long, page int, text string").repartition(3)
    index = search.build_index(texts.persist(), search.Words())
    held = spark.read.parquet(f"{index.path}/postings").filter("term = 'the'").groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(held) >= 3 and sum(r["count"] for r in held) == 12
    asked = search._few(search.written(spark.createDataFrame([(1, "the")], "query_id int, term string"), "asked"))
    assert "Exchange hash" not in plan(index.entries(asked)) and index.entries(asked).count() == 12


def test_citations_and_refusals_do_not_search_twice(spark):
    assert "postings" not in plan(catalog.queries()["t8_retrieve"](spark, FOLDER))


def test_searches_meet_an_index_by_shuffle_beyond_few_rows(spark, monkeypatch):
    pages = [(i, i % 4, f"red ring {i % 3} of the small lamp " + "the " * (i % 5)) for i in range(40)]
    index = search.build_index(spark.createDataFrame(pages, "chunk_id long, page int, text string"), search.Words())
    asks = spark.createDataFrame([(1, '"red ring" lamp'), (2, "lamp -1"), (3, "ring 2 absent"), (4, '"ring red"'), (5, "the small the")], "query_id int, text string")
    found = lambda: [sorted(map(str, f(asks, i).collect())) for f in (search.strict_search, search.loose_search, search.ranked_search) for i in (index, index.only("page < 2"))]
    few = found()
    monkeypatch.setattr(search, "FEW", -1)
    assert found() == few and {s[13] for s in few[0]} == {"1", "2", "5"}


def test_a_catalogue_is_written_where_its_items_are_read(spark, monkeypatch):
    things = spark.createDataFrame([(f"id{i}", f"ring {i % 7}", f"red lamp {i} " + "x" * (i % 40)) for i in range(900)], "item_id string, name string, text string").repartition(3)
    index = search.build_catalogue(things.persist())
    files = index.table("grams").filter("gram = 'red'").groupBy(F.input_file_name().alias("file")).agg(F.sum(F.size("items")).alias("n")).collect()
    assert len(files) >= 3 and sum(r["n"] for r in files) == 900
    asks = spark.createDataFrame([(1, "id12"), (2, "lamp ring"), (3, "red 77"), (4, "ring 3 red lamp 10 xx"), (5, "absent"), (6, "p 1"), (7, " "), (8, "--")], "query_id int, query string")
    out = search.tier_search(asks, index)
    # Texts are not dealt anew to be compared.
    assert "hay" not in "".join(x for x in plan(out).splitlines() if "Exchange hash" in x) and "SortMergeJoin" not in plan(out)
    found = sorted(map(str, out.collect()))
    monkeypatch.setattr(search, "FEW", -1)
    monkeypatch.setattr(search, "LISTS", -1)
    assert sorted(map(str, search.tier_search(asks, index).collect())) == found
    want = set()
    for q, text in [(1, "id12"), (2, "lamp ring"), (3, "red 77"), (4, "ring 3 red lamp 10 xx"), (6, "p 1")]:
        tiers = []
        for i in range(900):
            key, words = f"id{i}", text.split()
            hay = f"{key} ring {i % 7} red lamp {i} " + "x" * (i % 40)
            tier = 0 if key == text else 1 if text in key else (2 if any(w in key for w in words) else 3) if all(w in hay for w in words) else 4 if text in hay else None
            tiers += [(tier, len(key), key)] if tier is not None else []
        want |= {(q, k, t, r + 1) for r, (t, _, k) in enumerate(sorted(tiers)[:25])}
    assert {(r.query_id, r.item_id, r.tier, r["rank"]) for r in out.collect()} == want


def test_stems_are_stored_once_and_paired_as_they_are_read(spark, monkeypatch):
    from difflib import SequenceMatcher

    monkeypatch.setattr(text, "STEM_BLOCK", 5)
    monkeypatch.setattr(text, "BLOCK_BYTES", 600)
    monkeypatch.setattr(text, "PART_BYTES", 3000)
    stems = [" ".join(f"{'abcdefgh'[(i * k) % 8]}{(i + k) % 5}word" for k in range(6 + i % 9)) for i in range(40)]
    stems += [x.replace("word", "wxrd", 2) for x in stems[::3]] + [f"{x} z" for x in stems[::5]]
    sitting = {x: (None, "2023", "2024")[i % 3] for i, x in enumerate(dict.fromkeys(stems))}
    rows = spark.createDataFrame([(x, y, y) for x, y in sitting.items()], "norm string, lo string, hi string")
    out = text.repeat_candidates(rows)
    alike = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.82
    want = {(a, b) for a in sitting for b in sitting if a < b and alike(a, b) and sitting[a] != sitting[b]}
    got = [(r.a, r.b) for r in out.collect()]
    assert len(got) == len(set(got)) and want and want <= set(got) and all(a < b and sitting[a] != sitting[b] for a, b in got)
    assert "CoGroup" not in plan(out)
    every = [(r.a, r.b) for r in text.repeat_candidates(rows.select("norm")).collect()]
    assert len(every) == len(set(every)) and {(a, b) for a in sitting for b in sitting if a < b and alike(a, b)} <= set(every)
