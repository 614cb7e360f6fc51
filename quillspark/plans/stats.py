"""Aggregations and windows over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import accepted, half_up
from quillspark.operators import statistics as op
from quillspark.operators import windows as win
from quillspark.plans import query


@query("a1_review_stats", "SELECT paper_id, count(*) AS total, count(*) FILTER (WHERE review_status = 'approved') AS approved, count(*) FILTER (WHERE review_status = 'rejected') AS rejected, count(*) FILTER (WHERE review_status = 'pending') AS pending, count(*) FILTER (WHERE n_warnings > 0) AS flagged FROM questions GROUP BY paper_id")
def a1(t):
    return op.review_stats(t.questions)


@query("a1_by_status", "SELECT review_status, count(*) AS n FROM papers GROUP BY 1")
def a1_status(t):
    return op.count_by(t.papers, "review_status")


@query("a2_corpus_stats", "SELECT lang, source, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM docs GROUP BY ROLLUP (lang, source)")
def a2(t):
    return op.corpus_stats(t.docs.withColumn("chars", F.char_length("text").cast("long")), "lang", "source")


@query("a3_run_stats", "SELECT lang, count(*) AS runs, count(*) FILTER (WHERE quality = 1) AS verified, count(*) FILTER (WHERE quality <> 1) AS unverified, count(*) FILTER (WHERE toxic = 1) AS single_stage FROM documents JOIN labels USING (doc_id) GROUP BY lang", prelude=False)
def a3(t):
    runs = t.raw("documents").join(t.raw("labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "single").otherwise("two").alias("mode"))
    return op.run_stats(runs)


@query("a4_topic_counts", "SELECT topic_id, count(*) AS n FROM questions WHERE topic_id IS NOT NULL GROUP BY 1")
def a4(t):
    return op.topic_counts(t.questions)


@query("a4_subject_counts", "SELECT coalesce(subject, 'Part ' || part) AS label, count(*) AS n FROM questions GROUP BY 1")
def a4_subjects(t):
    return op.subject_counts(t.questions)


@query("a5_topic_frequency", "SELECT topic_id, count(*) AS questions, count(DISTINCT strftime(held_on, '%Y-%m')) AS sittings FROM questions JOIN papers USING (paper_id) WHERE topic_id IS NOT NULL GROUP BY 1 ORDER BY sittings DESC, questions DESC, topic_id LIMIT 10")
def a5(t):
    return op.topic_frequency(t.questions, t.papers.withColumn("sitting", F.date_format("held_on", "yyyy-MM")), 10)


@query("a6_strand_share", ", s AS (SELECT topic_id, CASE WHEN length(topic_id) = 7 THEN 'short' ELSE 'long' END AS strand FROM questions WHERE topic_id IS NOT NULL) SELECT strand, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM s) AS share FROM s GROUP BY 1")
def a6(t):
    topics = t.raw("part").select(F.col("p_brand").alias("topic_id")).distinct().withColumn("strand", F.when(F.char_length("topic_id") == 7, "short").otherwise("long"))
    return op.strand_share(t.questions, topics)


@query(
    "a7_answer_spread",
    """, r AS (SELECT paper_id % 100 AS set_id, label, count(*) AS n FROM options WHERE is_correct GROUP BY 1, 2),
p AS (SELECT set_id, coalesce(sum(n) FILTER (WHERE label = 'A'), 0) AS a, coalesce(sum(n) FILTER (WHERE label = 'B'), 0) AS b, coalesce(sum(n) FILTER (WHERE label = 'C'), 0) AS c, coalesce(sum(n) FILTER (WHERE label = 'D'), 0) AS d FROM r GROUP BY 1)
SELECT set_id, CAST(a AS BIGINT) AS "A", CAST(b AS BIGINT) AS "B", CAST(c AS BIGINT) AS "C", CAST(d AS BIGINT) AS "D", CAST(greatest(a, b, c, d) AS DOUBLE) / CAST(a + b + c + d AS DOUBLE) AS max_share, CAST(greatest(a, b, c, d) AS DOUBLE) / CAST(a + b + c + d AS DOUBLE) > 0.4 AS skewed FROM p""",
)
def a7(t):
    sets = t.questions.select((F.col("paper_id") % 100).alias("set_id"), "question_id")
    return op.answer_spread(sets, t.options, ["A", "B", "C", "D"])


_DETAIL = ", detail AS (SELECT m.*, p_type AS subject, p_brand AS topic_id FROM mistakes m JOIN part ON p_partkey = question_no)"


def _detail(t):
    from quillspark.operators.joins import mistake_detail

    return mistake_detail(t.mistakes, t.raw("part").select(F.col("p_partkey").alias("question_no"), F.col("p_type").alias("subject"), F.col("p_brand").alias("topic_id")))


@query("a8_weaknesses", _DETAIL + " SELECT user_id, subject, topic_id, count(*) AS n, max(created_ms) AS latest_ms, string_agg(CAST(mistake_id AS VARCHAR), ',' ORDER BY CAST(mistake_id AS VARCHAR)) AS items FROM detail GROUP BY 1, 2, 3")
def a8(t):
    return op.weaknesses(_detail(t))


@query("a9_mistake_types", "SELECT coalesce(mistake_type, 'untagged') AS type, count(*) AS n FROM mistakes GROUP BY 1")
def a9(t):
    return op.mistake_types(t.mistakes)


@query("a10_repeat_offenders", ", e AS (SELECT user_id, question_no, count(*) AS misses, max(created_ms) AS latest_ms FROM mistakes WHERE resolved_ms IS NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY misses DESC, latest_ms DESC, question_no) AS place FROM e) SELECT * FROM r WHERE place <= 5")
def a10(t):
    return op.repeat_offenders(t.mistakes, 5)


@query("a11_subject_share", _DETAIL + ", e AS (SELECT user_id, subject, count(*) AS n FROM detail GROUP BY 1, 2) SELECT user_id, subject, n, CAST(floor(CAST(n * 100 AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) + 0.5) AS BIGINT) AS pct FROM e")
def a11(t):
    return op.subject_share(_detail(t))


_SCORED = """, sheet AS (SELECT attempt_id, question_no, CASE WHEN question_no % 11 = 10 THEN 'Z' WHEN question_no % 11 < 4 THEN CAST(question_no % 11 + 1 AS VARCHAR) ELSE substr('ABCDEF', CAST(question_no % 11 - 3 AS BIGINT), 1) END AS key_raw
  FROM (SELECT DISTINCT attempt_id, user_id FROM responses) CROSS JOIN (SELECT unnest(range(100)) AS question_no) WHERE (question_no + user_id) % 4 = 0),
exams AS (SELECT DISTINCT attempt_id, CASE user_id % 3 WHEN 0 THEN 'CTET' WHEN 1 THEN 'NEET' ELSE 'OTHER' END AS exam FROM responses),
outcomes AS (
  SELECT s.attempt_id, s.question_no, nullif(r.raw_chosen, '') AS chosen, exam,
    CASE WHEN nullif(r.raw_chosen, '') IS NULL THEN 'unattempted' WHEN s.key_raw = 'Z' THEN 'bonus' WHEN contains(accepted, r.raw_chosen) THEN 'correct' ELSE 'incorrect' END AS outcome
  FROM sheet s JOIN legend USING (key_raw) JOIN exams USING (attempt_id) LEFT JOIN responses r ON r.attempt_id = s.attempt_id AND r.question_no = s.question_no),
marked AS (SELECT *, CASE WHEN outcome IN ('bonus', 'correct') THEN CASE WHEN exam = 'NEET' THEN 4 ELSE 1 END WHEN outcome = 'incorrect' AND exam = 'NEET' THEN -1 ELSE 0 END AS marks FROM outcomes)
"""


def sheet(t):
    """A question sheet for each attempt: every fourth question, by user."""
    who = t.responses.select("attempt_id", "user_id").distinct()
    n = F.col("question_no")
    rows = who.withColumn("question_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long")))).filter((n + F.col("user_id")) % 4 == 0)
    m = n % 11
    key = F.when(m == 10, "Z").when(m < 4, (m + 1).cast("string")).otherwise(F.substr(F.lit("ABCDEF"), (m - 3).cast("int"), F.lit(1)))
    questions = rows.select("attempt_id", "question_no", accepted(key).alias("accepted"), F.when(key == "Z", "bonus").otherwise("ok").alias("status"))
    exams = who.select("attempt_id", F.when(F.col("user_id") % 3 == 0, "CTET").when(F.col("user_id") % 3 == 1, "NEET").otherwise("OTHER").alias("exam"))
    return exams, questions, t.responses.select("attempt_id", "question_no", F.nullif("raw_chosen", F.lit("")).alias("chosen"))


@query("a12_score_outcomes", _SCORED + "SELECT attempt_id, question_no, chosen, outcome, marks FROM marked")
def a12(t):
    return op.score(*sheet(t))[0]


@query(
    "a12_score_totals",
    _SCORED
    + "SELECT attempt_id, CAST(sum(marks) AS BIGINT) AS score, CAST(sum(CASE WHEN exam = 'NEET' THEN 4 ELSE 1 END) AS BIGINT) AS max_score, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'incorrect') AS incorrect, count(*) FILTER (WHERE outcome = 'unattempted') AS unattempted, count(*) FILTER (WHERE outcome = 'bonus') AS bonus FROM marked GROUP BY 1",
)
def a12_totals(t):
    return op.score(*sheet(t))[1]


#: Whole sums for each maximum over a common denominator: a mean of ratios that is exact, halves up.
EXACT_PCT = """m AS (SELECT user_id, max_score, CAST(sum(coalesce(score, 0)) AS HUGEINT) AS s, count(*) AS n FROM {0} WHERE max_score > 0 GROUP BY 1, 2),
l AS (SELECT user_id, CAST(list_reduce(list(CAST(max_score AS BIGINT)), lambda a, b: lcm(a, b)) AS HUGEINT) AS l, CAST(sum(n) AS HUGEINT) AS n FROM m GROUP BY 1),
pct AS (SELECT user_id, CAST(floor((200 * sum(s * (l // max_score)) + any_value(l * l.n)) // any_value(2 * l * l.n)) AS BIGINT) AS mean_pct, CAST(any_value(l.n) AS BIGINT) AS scored FROM m JOIN l USING (user_id) GROUP BY 1)"""


@query("a13_accuracy", ", " + EXACT_PCT.format("attempts") + " SELECT user_id, mean_pct, best_pct, scored FROM pct JOIN (SELECT user_id, CAST(max((200 * score + max_score) // (2 * max_score)) AS BIGINT) AS best_pct FROM attempts WHERE max_score > 0 GROUP BY 1) USING (user_id)")
def a13(t):
    return op.accuracy(t.attempts)


@query("a13_best_attempt", ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, paper_type ORDER BY CAST(score AS DOUBLE) / max_score DESC, attempt_id) AS rn FROM attempts WHERE max_score > 0) SELECT user_id, paper_type, attempt_id FROM r WHERE rn = 1")
def a13_best(t):
    return op.best_attempt(t.attempts, "user_id", "paper_type")


@query(
    "a14_palette",
    _SCORED
    + """, st AS (SELECT s.attempt_id, CASE WHEN coalesce(r.visited, 0) = 0 THEN 'notVisited' WHEN r.marked = 1 AND nullif(r.raw_chosen, '') IS NOT NULL THEN 'answeredMarked' WHEN r.marked = 1 THEN 'marked' WHEN nullif(r.raw_chosen, '') IS NOT NULL THEN 'answered' ELSE 'notAnswered' END AS state
  FROM sheet s LEFT JOIN responses r ON r.attempt_id = s.attempt_id AND r.question_no = s.question_no)
SELECT attempt_id, count(*) FILTER (WHERE state = 'notVisited') AS "notVisited", count(*) FILTER (WHERE state = 'answeredMarked') AS "answeredMarked", count(*) FILTER (WHERE state = 'marked') AS marked, count(*) FILTER (WHERE state = 'answered') AS answered, count(*) FILTER (WHERE state = 'notAnswered') AS "notAnswered" FROM st GROUP BY 1""",
)
def a14(t):
    _, questions, responses = sheet(t)
    state = t.responses.select("attempt_id", "question_no", "visited", "marked")
    return op.palette(questions.select("attempt_id", "question_no").join(responses, ["attempt_id", "question_no"], "left").join(state, ["attempt_id", "question_no"], "left"))


@query("a15_latency", "SELECT event_type AS stage, list_sort(list(time_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, count(*) AS n, CAST(sum(time_ms) AS BIGINT) AS total FROM commands GROUP BY 1")
def a15(t):
    return op.latency(t.commands.withColumnRenamed("event_type", "stage"), "stage", "time_ms")


@query("a16_reasons", ", m AS (SELECT unnest(CASE WHEN n_warnings = 0 THEN ['clean'] WHEN n_warnings = 1 THEN ['warning: ' || key_raw, 'seen (' || part || ')'] ELSE ['warning: twice', 'gap — ' || key_raw] END) AS m FROM questions) SELECT trim(split_part(split_part(split_part(m, ':', 1), '(', 1), ' — ', 1)) AS reason, count(*) AS n FROM m GROUP BY 1")
def a16(t):
    k, p = F.col("key_raw"), F.col("part")
    messages = F.when(F.col("n_warnings") == 0, F.array(F.lit("clean"))).when(F.col("n_warnings") == 1, F.array(F.concat(F.lit("warning: "), k), F.concat(F.lit("seen ("), p, F.lit(")")))).otherwise(F.array(F.lit("warning: twice"), F.concat(F.lit("gap — "), k)))
    return op.reason_histogram(t.questions.withColumn("m", messages), "m")


@query("a17_content_counts", "SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM papers WHERE exam_code = 'FURNITURE') AS visible_papers, (SELECT count(*) FROM questions) AS questions, (SELECT count(*) FROM questions WHERE paper_id IN (SELECT paper_id FROM papers WHERE exam_code = 'FURNITURE')) AS visible_questions")
def a17(t):
    return op.content_counts(t.papers, t.questions, "FURNITURE")


@query("w1_one_per_sitting", ", k AS (SELECT p.paper_id, user_id, paper_type, strftime(held_on, '%Y') AS month, count(question_id) AS keyed FROM papers p LEFT JOIN questions q ON q.paper_id = p.paper_id AND key_raw <> 'Z' GROUP BY ALL) SELECT paper_id, keyed, row_number() OVER (PARTITION BY user_id, paper_type, month ORDER BY keyed DESC, paper_id) = 1 AS kept FROM k")
def w1(t):
    keyed = t.questions.filter("key_raw != 'Z'").groupBy("paper_id").agg(F.count(F.lit(1)).alias("keyed"))
    rows = t.papers.join(keyed, "paper_id", "left").select("paper_id", "user_id", "paper_type", F.date_format("held_on", "yyyy").alias("month"), F.coalesce("keyed", F.lit(0)).cast("long").alias("keyed"))
    return win.one_per_sitting(rows).select("paper_id", "keyed", "kept")


@query("w2_resumable", ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, paper_type ORDER BY started_ms DESC, attempt_id DESC) AS rn FROM attempts WHERE submitted_ms IS NULL) SELECT user_id, paper_type, attempt_id FROM r WHERE rn = 1")
def w2(t):
    return win.resumable(t.attempts).select("user_id", "paper_type", "attempt_id")


@query("w3_resume_index", _SCORED + ", pl AS (SELECT attempt_id, question_no, row_number() OVER (PARTITION BY attempt_id ORDER BY question_no) - 1 AS place FROM sheet) SELECT attempt_id, coalesce(min(place) FILTER (WHERE chosen IS NULL), 0) AS resume_at FROM pl JOIN outcomes USING (attempt_id, question_no) GROUP BY 1")
def w3(t):
    from pyspark.sql import Window

    _, questions, responses = sheet(t)
    placed = questions.withColumn("place", (F.row_number().over(Window.partitionBy("attempt_id").orderBy("question_no")) - 1).cast("long"))
    return win.resume_index(placed, responses)


@query("w4_islands", ", p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS spot FROM commands), n AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY spot) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM p), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY spot) AS island FROM n) SELECT user_id, event_type, min(spot) AS first_at, max(spot) AS last_at FROM g GROUP BY user_id, island, event_type")
def w4(t):
    return win.islands(t.commands, "user_id", ["ms", "event_id"], "event_type")


@query(
    "w5_split_on_reset",
    """, o AS (SELECT l_suppkey, l_orderkey, l_linenumber AS number, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_shipdate, l_extendedprice, l_partkey) AS n FROM lineitem),
c AS (SELECT *, CASE WHEN number <= lag(number) OVER (PARTITION BY l_suppkey ORDER BY n) THEN 1 ELSE 0 END AS new FROM o),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY l_suppkey ORDER BY n) + 1 AS BIGINT) AS paper_no FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, paper_no, number ORDER BY n) AS rn FROM g) SELECT l_suppkey, paper_no, number, l_orderkey FROM f WHERE rn = 1""",
)
def w5(t):
    rows = t.raw("lineitem").withColumnRenamed("l_linenumber", "number")
    return win.split_on_reset(rows, "l_suppkey", ["l_orderkey", "l_shipdate", "l_extendedprice", "l_partkey"], "number").select("l_suppkey", "paper_no", "number", "l_orderkey")


@query("w6_trend", ", d AS (SELECT *, CAST(floor(CAST(score * 100 AS DOUBLE) / max_score + 0.5) AS BIGINT) AS pct FROM attempts WHERE submitted_ms IS NOT NULL AND max_score > 0), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY submitted_ms DESC, attempt_id DESC) AS back, max(pct) OVER (PARTITION BY user_id) AS best FROM d) SELECT user_id, attempt_id, pct, back, best FROM p WHERE back <= 6")
def w6(t):
    return win.trend(t.attempts).select("user_id", "attempt_id", "pct", "back", "best")


@query("w9_latest_per_set", ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, paper_no ORDER BY started_ms DESC, attempt_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, paper_no) AS times FROM attempts) SELECT user_id, paper_no, attempt_id, times FROM r WHERE rn = 1")
def w9(t):
    return win.latest_per_set(t.attempts)


@query(
    "w11_session_digest",
    """WITH d AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '[ \\t\\r\\n]+', ' ', 'g')) AS t, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN length(t) > 42 THEN substr(t, 1, 42) || '…' ELSE t END AS title, turns, least(turns, 50) AS kept, last_turn FROM d""",
    prelude=False,
)
def w11(t):
    return win.session_digest(t.raw("conversations"))


@query(
    "w12_budget_fill",
    """WITH RECURSIVE items AS (SELECT o_custkey AS user_id, CAST(o_orderkey AS VARCHAR) AS id, floor(o_totalprice / 10000) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
f AS (SELECT user_id, rn, CAST(cost AS DOUBLE) AS spent, id AS taken FROM items WHERE rn = 1 UNION ALL SELECT i.user_id, i.rn, CASE WHEN f.spent + i.cost <= 60 THEN f.spent + i.cost ELSE f.spent END, CASE WHEN f.spent + i.cost <= 60 THEN f.taken || ',' || i.id ELSE f.taken END FROM f JOIN items i ON i.user_id = f.user_id AND i.rn = f.rn + 1)
SELECT user_id, arg_max(taken, rn) AS taken, max(spent) AS spent FROM f GROUP BY 1""",
    prelude=False,
)
def w12(t):
    items = t.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("id"), (F.floor(F.col("o_totalprice") / 10000)).cast("double").alias("cost"), F.lit(60.0).alias("budget"))
    return win.budget_fill(items, "user_id", "budget")
