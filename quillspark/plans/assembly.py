"""Practice sets and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import assembly as op
from quillspark.plans import query
from quillspark.plans.stats import EXACT_PCT

_BLUE = ", blueprint(section, subject, wanted) AS (VALUES (1, 'ECONOMY', 30), (2, 'PROMO', 20), (3, 'SMALL', 25), (4, 'ABSENT', 5)), seeds(seed) AS (VALUES ('1'), ('2'), ('3'))"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(stem), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^(which (one )?of the following|read the following|consider the following)', ''), '[^a-z0-9 ]', '', 'g'))"
_SETS = (
    _BLUE
    + f""", need AS (SELECT question_id, section, wanted, {_NORM} AS fp FROM pool JOIN blueprint USING (subject)), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY section, question_id) AS rn FROM need) WHERE rn = 1 OR fp = ''),
drawn AS (SELECT * FROM (SELECT seed, section, wanted, question_id, row_number() OVER (PARTITION BY seed, section ORDER BY md5(seed || ':' || question_id), question_id) AS rn FROM once CROSS JOIN seeds) WHERE rn <= wanted),
sets AS (SELECT seed, section, question_id, row_number() OVER (PARTITION BY seed ORDER BY section, rn) AS number FROM drawn)"""
)
#: i2 counts what a set holds: the same for any draw.
_RUNS = (
    _BLUE
    + f""", need AS (SELECT question_id, section, wanted, {_NORM} AS fp FROM pool JOIN blueprint USING (subject)), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY section, question_id) AS rn FROM need) WHERE rn = 1 OR fp = ''),
placed AS (SELECT section, wanted, question_id, row_number() OVER (PARTITION BY section ORDER BY md5(question_id), question_id) - 1 AS place, count(*) OVER (PARTITION BY section) AS size FROM once),
drawn AS (SELECT seed, section, question_id FROM placed CROSS JOIN seeds WHERE (place - CAST('0x' || substr(md5(seed || ':' || CAST(section AS VARCHAR)), 1, 12) AS BIGINT) % size + size) % size < wanted),
sets AS (SELECT seed, section, question_id, row_number() OVER (PARTITION BY seed ORDER BY section, md5(seed || ':' || question_id), question_id) AS number FROM drawn)"""
)


def _blueprint(t):
    return t.spark.createDataFrame([(1, "ECONOMY", 30), (2, "PROMO", 20), (3, "SMALL", 25), (4, "ABSENT", 5)], "section int, subject string, wanted int")


def _seeds(t):
    return t.spark.createDataFrame([("1",), ("2",), ("3",)], "seed string")


@query("i1_build_sets", _SETS + " SELECT seed, section, question_id, number FROM sets")
def i1(t):
    return op.build_sets(t.pool, _blueprint(t), _seeds(t))


@query("i1_set_ids", _SETS + " SELECT seed, sha1('full|' || seed || '|' || string_agg(question_id, ',' ORDER BY number)) AS set_id, count(*) AS questions FROM sets GROUP BY seed")
def i1_ids(t):
    return op.set_ids(op.build_sets(t.pool, _blueprint(t), _seeds(t)), "full")


@query("i2_set_report", _RUNS + ", g AS (SELECT seed, section, count(*) AS got FROM sets GROUP BY 1, 2) SELECT s.seed, b.section, CAST(wanted AS BIGINT) AS wanted, coalesce(got, 0) AS got, greatest(CAST(0 AS BIGINT), wanted - coalesce(got, 0)) AS short_by FROM seeds s CROSS JOIN blueprint b LEFT JOIN g ON g.seed = s.seed AND g.section = b.section")
def i2(t):
    return op.set_report(op.build_sets(t.pool, _blueprint(t), _seeds(t)), _blueprint(t), _seeds(t))


@query("i3_drill_topic", f", o AS (SELECT question_id, row_number() OVER (PARTITION BY {_NORM} ORDER BY question_id) AS rn FROM pool WHERE topic_id = 'Brand#7'), d AS (SELECT question_id, row_number() OVER (ORDER BY md5('topic:Brand#7:5:' || question_id), question_id) AS number FROM o WHERE rn = 1) SELECT question_id, number FROM d WHERE number <= 20")
def i3(t):
    return op.build_drill(t.pool, "topic", "Brand#7", "5")


@query("i3_drill_weak", f", o AS (SELECT question_id, row_number() OVER (PARTITION BY {_NORM} ORDER BY question_id) AS rn FROM pool WHERE topic_id IN (SELECT p_brand FROM mistakes JOIN part ON p_partkey = question_no WHERE user_id = 3)), d AS (SELECT question_id, row_number() OVER (ORDER BY md5('weak::5:' || question_id), question_id) AS number FROM o WHERE rn = 1) SELECT question_id, number FROM d WHERE number <= 20")
def i3_weak(t):
    weak = t.mistakes.filter("user_id = 3").join(t.raw("part").select(F.col("p_partkey").alias("question_no"), F.col("p_brand").alias("topic_id")), "question_no")
    return op.build_drill(t.pool, "weak", "", "5", weak=weak)


@query(
    "i5_describe_set",
    """, s AS (SELECT CASE CAST(question_id AS BIGINT) % 5 WHEN 0 THEN question_id WHEN 1 THEN 'mock:section:' || subject || ':' || question_id WHEN 2 THEN 'mock:topic:' || topic_id || ':' || question_id WHEN 3 THEN 'mock:weak::' || question_id ELSE 'mock:other:x:' || question_id END AS set_id, size AS questions, CASE WHEN size % 2 = 0 THEN 30 END AS section_minutes FROM pool),
m AS (SELECT *, CASE WHEN starts_with(set_id, 'mock:') AND split_part(set_id, ':', 2) IN ('section', 'topic', 'priority', 'weak') THEN split_part(set_id, ':', 2) ELSE 'full' END AS mode, split_part(set_id, ':', 3) AS param FROM s)
SELECT set_id, mode, CASE WHEN mode = 'full' THEN 'Full mock' ELSE upper(substr(mode, 1, 1)) || substr(mode, 2) || CASE WHEN param = '' THEN '' ELSE ': ' || param END END AS label, CAST(CASE mode WHEN 'full' THEN 150 WHEN 'section' THEN coalesce(section_minutes, questions) ELSE questions END AS BIGINT) AS minutes FROM m""",
)
def i5(t):
    q, k = F.col("question_id"), F.col("question_id").cast("long") % 5
    ids = F.when(k == 0, q).when(k == 1, F.concat(F.lit("mock:section:"), "subject", F.lit(":"), q)).when(k == 2, F.concat(F.lit("mock:topic:"), "topic_id", F.lit(":"), q)).when(k == 3, F.concat(F.lit("mock:weak::"), q)).otherwise(F.concat(F.lit("mock:other:x:"), q))
    return op.describe_set(t.pool.select(ids.alias("set_id"), F.col("size").alias("questions"), F.when(F.col("size") % 2 == 0, 30).alias("section_minutes")))


#: User -1 has sat every paper and made no mistake.
def _plan(t):
    u = F.col("user_id")
    users = t.raw("events").select("user_id").distinct().union(t.spark.createDataFrame([(-1,)], "user_id long")).withColumn("budget", F.when(u % 5 != 0, (F.lit(15) + u % 4 * 15).cast("double")))
    n = F.col("paper_no")
    papers = t.attempts.select("paper_no").distinct().select("paper_no", F.concat(F.lit("PAPER_"), n.cast("string")).alias("paper_type"), ((n % 3 + 1) * 10).alias("duration"), (n % 7 + 20).alias("total_questions"))
    whole = papers.select(F.lit(-1).cast("long"), "paper_no", F.lit(None).cast("long"), F.lit(None).cast("int"))
    q = F.col("question_no")
    detail = t.mistakes.filter("user_id % 3 != 0").join(t.raw("part").select(F.col("p_partkey").alias("question_no"), F.col("p_type").alias("type"), F.col("p_brand").alias("topic_id")), "question_no")
    detail = detail.select("user_id", F.when(q % 5 != 0, F.col("type")).alias("subject"), F.when(q % 3 != 0, "I").alias("part"), "topic_id", "created_ms")
    subjects = t.pool.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("I"))
    return users, papers, t.attempts.select("user_id", "paper_no", "score", "max_score").union(whole), detail, subjects


_ITEMS = """, users AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN CAST(15 + user_id % 4 * 15 AS DOUBLE) END AS budget FROM (SELECT DISTINCT user_id FROM events UNION ALL SELECT -1)), bank AS (SELECT DISTINCT paper_no, (paper_no % 3 + 1) * 10 AS duration FROM attempts), sat AS (SELECT user_id, paper_no, score, max_score FROM attempts UNION ALL SELECT -1, paper_no, NULL, NULL FROM bank),
d AS (SELECT m.user_id, coalesce(CASE WHEN question_no % 5 <> 0 THEN p_type END, 'Part ' || CASE WHEN question_no % 3 <> 0 THEN 'I' END, 'Unsorted') AS subject, p_brand AS topic_id, created_ms FROM mistakes m JOIN part ON p_partkey = question_no WHERE m.user_id % 3 <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, latest DESC, subject, topic_id) AS spot FROM (SELECT user_id, subject, topic_id, count(*) AS n, max(created_ms) AS latest FROM d GROUP BY 1, 2, 3)),
tt AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS every_n, CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS again, max(n) AS most, arg_min(subject, spot) AS worst FROM g GROUP BY 1),
s AS (SELECT user_id, subject, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, subject) AS rn, CAST(floor(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY user_id) + 0.5e0) AS BIGINT) AS pct FROM d GROUP BY 1, 2),
f AS (SELECT user_id, min(paper_no) AS paper_no FROM users CROSS JOIN bank b WHERE NOT EXISTS (SELECT 1 FROM sat a WHERE a.user_id = users.user_id AND a.paper_no = b.paper_no) GROUP BY 1),
cand AS (SELECT tt.user_id, 1 AS place, CASE WHEN again > 0 THEN 'fix-repeated' ELSE 'fix-recent' END AS id, 'fix' AS kind, CAST(CASE WHEN again > 0 THEN least(15, greatest(5, floor(CAST(again * 45 AS DOUBLE) / 60 / 5 + 0.5) * 5)) ELSE least(10, greatest(5, floor(CAST(every_n * 45 AS DOUBLE) / 60 / 5 + 0.5) * 5)) END AS DOUBLE) AS cost,
  worst AS title, CAST(CASE WHEN again > 0 THEN again ELSE every_n END AS VARCHAR) AS detail, CASE WHEN again > 0 THEN 'MISSED_TWICE' ELSE 'RECENT_MISTAKE' END AS code, CASE WHEN again > 0 THEN most END AS param FROM tt JOIN users USING (user_id)
UNION ALL SELECT user_id, CAST(rn + 1 AS INTEGER), 'practice-' || subject, 'practice', 15e0, subject, '12', 'HIGH_WEIGHTAGE', pct FROM s JOIN users USING (user_id) WHERE rn <= 2
UNION ALL SELECT user_id, 4, 'paper-' || CAST(paper_no AS VARCHAR), 'practice', CAST(duration AS DOUBLE), 'PAPER ' || CAST(paper_no AS VARCHAR), CAST(paper_no % 7 + 20 AS VARCHAR), 'NEVER_SEEN', NULL FROM f JOIN bank USING (paper_no)),
learn AS (SELECT subject, count(*) AS n FROM pool GROUP BY 1 ORDER BY 1 LIMIT 1),
items AS (SELECT * FROM cand UNION ALL SELECT user_id, 5, 'learn-first', 'learn', 15e0, subject, CAST(n AS VARCHAR), 'NEVER_SEEN', NULL FROM users CROSS JOIN learn WHERE user_id NOT IN (SELECT user_id FROM cand))"""


@query("p1_plan_items", _ITEMS + " SELECT user_id, place, id, kind, cost, title, detail, code, param FROM items")
def p1(t):
    return op.plan_items(*_plan(t))


@query(
    "p1_daily_plan",
    _ITEMS
    # Five items at most: the fill, one item after the other.
    + """, o AS (SELECT user_id, id, cost, coalesce(budget, 30) AS budget, row_number() OVER (PARTITION BY user_id ORDER BY place, id) AS rn FROM items JOIN users USING (user_id)),
f1 AS (SELECT user_id, budget, cost AS spent, id AS taken FROM o WHERE rn = 1), """
    + ", ".join(
        f"f{n} AS (SELECT f.user_id, f.budget, CASE WHEN f.spent + o.cost <= f.budget THEN f.spent + o.cost ELSE f.spent END AS spent, CASE WHEN f.spent + o.cost <= f.budget THEN f.taken || ',' || o.id ELSE f.taken END AS taken FROM f{n - 1} f LEFT JOIN o ON o.user_id = f.user_id AND o.rn = {n})"
        for n in range(2, 6)
    )
    + """, wk AS (SELECT user_id, string_agg(subject || ':' || CAST(n AS VARCHAR), '|' ORDER BY spot) FILTER (WHERE spot <= 3) AS weak_areas, CAST(sum(n) AS BIGINT) AS mistakes FROM g GROUP BY 1),
"""
    + EXACT_PCT.format("sat")
    + """, sc AS (SELECT user_id, mean_pct AS overall_pct, scored AS attempts FROM pct)
SELECT user_id, coalesce(spent, 0e0) AS minutes, coalesce(taken, '') AS items, coalesce(weak_areas, '') AS weak_areas, overall_pct, coalesce(attempts, 0) AS attempts, coalesce(mistakes, 0) AS mistakes FROM users LEFT JOIN f5 USING (user_id) LEFT JOIN wk USING (user_id) LEFT JOIN sc USING (user_id)""",
)
def p1_plan(t):
    return op.daily_plan(*_plan(t))
