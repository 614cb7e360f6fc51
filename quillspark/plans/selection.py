"""Filters and top-k over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import selection as op
from quillspark.plans import query


@query("f1_opt_filter", "SELECT paper_id, exam_code, paper_type FROM papers WHERE exam_code = 'MACHINERY' AND review_status = 'approved'")
def f1(t):
    return op.opt_filter(t.papers, exam_code="MACHINERY", paper_type=None, review_status="approved").select("paper_id", "exam_code", "paper_type")


@query("f2_scope", "SELECT question_id, paper_id FROM questions WHERE paper_id IN (SELECT paper_id FROM papers WHERE exam_code = 'BUILDING' AND paper_type = '1-URGENT')")
def f2(t):
    return op.scope(t.questions, t.papers, "BUILDING", "1-URGENT").select("question_id", "paper_id")


@query("f2_scope_absent", "SELECT question_id, paper_id FROM questions WHERE paper_id IN (SELECT paper_id FROM papers WHERE exam_code = 'ABSENT')")
def f2_absent(t):
    return op.scope(t.questions, t.papers, "ABSENT").select("question_id", "paper_id")


@query("f3_gate", "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def f3(t):
    rows = t.raw("documents").join(t.raw("labels"), "doc_id").withColumn("review_status", F.when(F.col("quality") == 1, "approved").otherwise("pending"))
    return op.gate(rows).select("doc_id", "lang")


@query(
    "f4_readmit",
    """SELECT doc_id, CASE WHEN quality = 1 THEN toxic END AS toxic, quality FROM labels WHERE quality = 1 OR doc_id % 3 = 0""",
    prelude=False,
)
def f4(t):
    rows = t.raw("labels").withColumns({"review_status": F.when(F.col("quality") == 1, "approved").otherwise("pending"), "review_note": F.when(F.col("doc_id") % 3 == 0, "explanation added").otherwise("other")})
    return op.readmit(rows, "explanation added", ["toxic"]).select("doc_id", "toxic", "quality")


@query("f5_light_pool", "SELECT question_id, subject, topic_id, stem FROM questions WHERE review_status = 'approved'")
def f5(t):
    return op.light_pool(op.gate(t.questions))


@query("f5_load_by_ids", "SELECT q.question_id, q.paper_id, q.stem, q.key_raw, q.pos + 100 AS place FROM questions q WHERE q.part_key % 50 = 0")
def f5_load(t):
    ids = t.questions.filter(F.col("part_key") % 50 == 0).select("question_id", (F.col("pos") + 100).alias("place"))
    return op.load_by_ids(ids, t.questions).select("question_id", "paper_id", "stem", "key_raw", "place")


@query(
    "f6_usable",
    """SELECT question_id FROM questions WHERE trim(stem) <> '' AND question_id IN (
  SELECT question_id FROM options GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (WHERE is_correct) > 0 AND count(DISTINCT lower(trim(text))) = count(*))""",
)
def f6(t):
    return op.usable(t.questions, t.options).select("question_id")


@query("f7_worklist", "SELECT question_id, review_status FROM questions WHERE (coalesce(trim(stem), '') = '' OR coalesce(trim(subject), '') = '') AND review_status = 'approved'")
def f7(t):
    return op.worklist(t.questions, ["stem", "subject"], "approved").select("question_id", "review_status")


_BY_SOURCE = """, texts AS (SELECT source AS question_id, min(CASE WHEN lang = 'en' THEN text END) AS stem_en, min(CASE WHEN lang = 'fr' AND doc_id % 4 = 0 THEN text END) AS stem_fr FROM documents GROUP BY 1)"""


def _by_source(t):
    return t.docs.groupBy(F.col("source").alias("question_id")).agg(F.min(F.when(F.col("lang") == "en", F.col("text"))).alias("stem_en"), F.min(F.when((F.col("lang") == "fr") & (F.col("doc_id") % 4 == 0), F.col("text"))).alias("stem_fr"))


@query("f8_localise", _BY_SOURCE + " SELECT question_id, coalesce(nullif(trim(stem_fr), ''), stem_en) AS stem, CASE WHEN nullif(trim(stem_fr), '') IS NULL THEN 'en' ELSE 'fr' END AS used_lang, nullif(trim(stem_fr), '') IS NULL AS fell_back FROM texts")
def f8(t):
    return op.localise(_by_source(t), "stem", "fr").select("question_id", "stem", "used_lang", "fell_back")


@query(
    "f9_available_langs",
    _BY_SOURCE
    + """, opts AS (SELECT source AS question_id, bool_and(coalesce(trim(text), '') <> '') AS o_en, bool_and(coalesce(CASE WHEN doc_id % 97 <> 0 THEN trim(text) END, '') <> '') AS o_fr FROM documents GROUP BY 1)
SELECT question_id, array_to_string(list_filter([CASE WHEN coalesce(trim(stem_en), '') <> '' AND o_en THEN 'en' END, CASE WHEN coalesce(trim(stem_fr), '') <> '' AND o_fr THEN 'fr' END], lambda x: x IS NOT NULL), ',') AS langs FROM texts JOIN opts USING (question_id)""",
)
def f9(t):
    options = t.docs.select(F.col("source").alias("question_id"), F.col("text").alias("text_en"), F.when(F.col("doc_id") % 97 != 0, F.col("text")).alias("text_fr"))
    return op.available_langs(_by_source(t), options, ["en", "fr"])


@query("k1_review_queue", ", c AS (SELECT *, round(1e0 - 0.25e0 * n_warnings - part_key % 4 * 0.1e0, 3) AS confidence FROM questions) SELECT question_id, confidence FROM c ORDER BY confidence, paper_id, number, question_id LIMIT 500")
def k1(t):
    rows = t.questions.withColumn("confidence", F.round(F.lit(1.0) - F.col("n_warnings") * 0.25 - F.col("part_key") % 4 * 0.1, 3))
    return op.review_queue(rows, 500).select("question_id", "confidence")


@query(
    "k3_quick_set",
    """, users AS (SELECT DISTINCT user_id, CASE WHEN user_id % 9 = 0 THEN 'NOTHING' WHEN user_id % 2 = 0 THEN 'ECONOMY' ELSE 'PROMO' END AS subject, CAST(user_id % 5 AS VARCHAR) AS seed FROM events),
missed AS (SELECT DISTINCT user_id, CAST(question_no AS VARCHAR) AS question_id FROM mistakes WHERE user_id % 3 = 0),
own AS (SELECT user_id, question_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(seed || ':' || question_id), question_id) AS rn FROM missed JOIN users USING (user_id)),
rest AS (SELECT * FROM users WHERE user_id NOT IN (SELECT user_id FROM missed)),
draw AS (SELECT u.user_id, p.question_id, row_number() OVER (PARTITION BY u.user_id ORDER BY md5(u.seed || ':' || p.question_id), p.question_id) AS rn, 'subject' AS origin FROM rest u JOIN pool p USING (subject)),
other AS (SELECT u.user_id, p.question_id, row_number() OVER (PARTITION BY u.user_id ORDER BY md5(u.seed || ':' || p.question_id), p.question_id) AS rn FROM rest u CROSS JOIN pool p WHERE u.subject NOT IN (SELECT subject FROM pool))
SELECT user_id, 'missed' AS origin, question_id, rn FROM own WHERE rn <= 12 UNION ALL SELECT user_id, origin, question_id, rn FROM draw WHERE rn <= 12 UNION ALL SELECT user_id, 'exam', question_id, rn FROM other WHERE rn <= 12""",
)
def k3(t):
    u = F.col("user_id")
    users = t.raw("events").select("user_id").distinct().select("user_id", F.when(u % 9 == 0, "NOTHING").when(u % 2 == 0, "ECONOMY").otherwise("PROMO").alias("subject"), (u % 5).cast("string").alias("seed"))
    missed = t.mistakes.filter(u % 3 == 0).select("user_id", F.col("question_no").cast("string").alias("question_id"))
    return op.quick_set(users, missed, t.pool)


@query(
    "k4_priority_pool",
    """, ranks AS (SELECT topic_id, row_number() OVER (ORDER BY count(*) DESC, topic_id) - 1 AS rank FROM questions WHERE topic_id IS NOT NULL GROUP BY topic_id),
held AS (SELECT pool.*, rank, row_number() OVER (PARTITION BY subject ORDER BY rank, question_id) AS place FROM pool JOIN ranks USING (topic_id) WHERE rank < 12),
drawn AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('1:' || question_id), question_id) AS rn FROM held WHERE place <= 60)
SELECT subject, question_id, topic_id, place, rn FROM drawn WHERE rn <= 20""",
)
def k4(t):
    ranks = op.top_topics(t.questions)
    return op.priority_pool(t.pool, ranks).select("subject", "question_id", "topic_id", "place", "rn")


@query("k5_paused", "SELECT attempt_id, coalesce(paused_ms, started_ms) AS since_ms FROM attempts WHERE submitted_ms IS NULL ORDER BY since_ms DESC, attempt_id LIMIT 50")
def k5(t):
    return op.paused(t.attempts).select("attempt_id", F.coalesce("paused_ms", "started_ms").alias("since_ms"))
