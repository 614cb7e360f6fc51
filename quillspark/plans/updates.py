"""Merges and decisions over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import updates as op
from quillspark.plans import query

_OLD = """WITH prior AS (SELECT doc_id AS id, text AS stem, doc_id % 4 AS correct, CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review_status, 'r' || CAST(doc_id % 7 AS VARCHAR) AS reviewer, CASE WHEN doc_id % 2 = 0 THEN 'seen' END AS note, 't' || CAST(doc_id % 5 AS VARCHAR) AS topic_id FROM documents WHERE doc_id % 10 <> 9),
incoming AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 'changed' ELSE text END AS stem, CASE WHEN doc_id % 11 = 0 THEN 9 ELSE doc_id % 4 END AS correct FROM documents WHERE doc_id % 10 <> 8),
m AS (SELECT i.*, p.stem AS p_stem, p.correct AS p_correct, p.review_status, p.reviewer, p.note, p.topic_id, p.review_status IS NULL AS fresh, coalesce((i.stem IS DISTINCT FROM p.stem OR i.correct IS DISTINCT FROM p.correct) AND p.review_status <> 'pending', false) AS undone FROM incoming i LEFT JOIN prior p USING (id)) """


def _versions(t):
    d = F.col("doc_id")
    base = t.docs.select(d, F.col("text").alias("stem"), (d % 4).alias("correct"))
    prior = base.filter(d % 10 != 9).select(d.alias("id"), "stem", "correct", F.when(d % 3 == 0, "approved").when(d % 3 == 1, "rejected").otherwise("pending").alias("review_status"), F.concat(F.lit("r"), (d % 7).cast("string")).alias("reviewer"), F.when(d % 2 == 0, "seen").alias("note"), F.concat(F.lit("t"), (d % 5).cast("string")).alias("topic_id"))
    incoming = base.filter(d % 10 != 8).select(d.alias("id"), F.when(d % 8 == 0, "changed").otherwise(F.col("stem")).alias("stem"), F.when(d % 11 == 0, 9).otherwise(F.col("correct")).alias("correct"))
    return prior, incoming


@query("m1_remerge", _OLD + "SELECT id, stem, correct, CASE WHEN undone OR fresh THEN 'pending' ELSE review_status END AS review_status, CASE WHEN NOT (undone OR fresh) THEN reviewer END AS reviewer, CASE WHEN undone THEN 'source changed after review' WHEN NOT fresh THEN note END AS note, topic_id FROM m", prelude=False)
def m1(t):
    return op.remerge(*_versions(t))[0]


@query("m1_remerge_audits", _OLD + "SELECT id, 'invalidated' AS action, 'review_status' AS field, review_status AS old_value, 'pending' AS new_value FROM m WHERE undone", prelude=False)
def m1_audits(t):
    return op.remerge(*_versions(t))[1]


def _review(t):
    q = F.col("part_key")
    rows = t.questions.select(F.col("question_id").alias("id"), "review_status", (F.col("subject") == "ECONOMY").alias("in_scope")).fillna({"in_scope": False})
    problems = t.questions.select(F.col("question_id").alias("id"), F.array_compact(F.array(F.when(q % 6 == 0, "no key"), F.when(q % 10 == 0, "empty stem"))).alias("problems"))
    return rows, problems


_REVIEW = ", r AS (SELECT question_id AS id, review_status, coalesce(subject = 'ECONOMY', false) AS in_scope, part_key % 6 = 0 AS p1, part_key % 10 = 0 AS p2, part_key FROM questions)"


@query("m2_bulk_approve", _REVIEW + " SELECT id, in_scope, CASE WHEN review_status = 'pending' AND in_scope AND NOT p1 AND NOT p2 THEN 'approved' ELSE review_status END AS review_status FROM r")
def m2(t):
    return op.bulk_approve(*_review(t), "auto")[0]


@query("m2_bulk_audits", _REVIEW + " SELECT id, 'approved' AS action, 'pending' AS old_value, 'auto' AS actor FROM r WHERE review_status = 'pending' AND in_scope AND NOT p1 AND NOT p2")
def m2_audits(t):
    return op.bulk_approve(*_review(t), "auto")[1]


@query("m2_held_back", _REVIEW + ", x AS (SELECT unnest(list_filter([CASE WHEN p1 THEN 'no key' END, CASE WHEN p2 THEN 'empty stem' END], lambda v: v IS NOT NULL)) AS reason FROM r WHERE review_status = 'pending' AND in_scope) SELECT reason, count(*) AS n FROM x GROUP BY 1")
def m2_held(t):
    return op.bulk_approve(*_review(t), "auto", dry_run=True)[2]


def _decisions(t):
    q = F.col("part_key")
    return t.questions.filter(q % 4 == 0).select(F.col("question_id").alias("id"), F.when(q % 3 == 0, "approve").when(q % 3 == 1, "reject").otherwise("reset").alias("action"), (q % 5 == 0).alias("override"), F.when(q % 2 == 0, "checked").alias("note"))


_DECIDED = _REVIEW + ", d AS (SELECT *, CASE WHEN part_key % 4 = 0 THEN CASE part_key % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'reset' END END AS action, part_key % 5 = 0 AND part_key % 2 = 0 AS pass FROM r), e AS (SELECT *, coalesce(action = 'approve' AND (p1 OR p2) AND NOT pass, false) AS refused FROM d)"


@query("m3_apply_decisions", _DECIDED + " SELECT id, CASE WHEN refused OR action IS NULL THEN review_status WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE 'pending' END AS review_status FROM e")
def m3(t):
    rows, problems = _review(t)
    return op.apply_decisions(rows.drop("in_scope"), problems, _decisions(t))[0]


@query("m3_refused", _DECIDED + " SELECT id, action FROM e WHERE refused")
def m3_refused(t):
    rows, problems = _review(t)
    return op.apply_decisions(rows.drop("in_scope"), problems, _decisions(t))[1]


def _edited(t):
    k = F.col("o_orderkey")
    old = t.raw("orders").filter(k % 20 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = t.raw("orders").select(k.alias("id"), F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("priority"))
    return old, new


_EDITED = """WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderkey % 20 = 0 AS fresh, o_orderstatus, o_orderpriority FROM orders),
u AS (SELECT id, 'status' AS field, fresh, CASE WHEN NOT fresh THEN o_orderstatus END AS old_value, status AS new_value FROM n UNION ALL SELECT id, 'priority', fresh, CASE WHEN NOT fresh THEN o_orderpriority END, priority FROM n),
audit AS (SELECT id, field, CASE WHEN fresh THEN 'created' ELSE 'edited' END AS action, old_value, new_value FROM u WHERE old_value IS DISTINCT FROM new_value) """


@query("m4_diff_audit", _EDITED + "SELECT * FROM audit", prelude=False)
def m4(t):
    return op.diff_audit(*_edited(t), "id", ["status", "priority"])


def _explained(t):
    d = F.col("doc_id")
    rows = t.docs.select(d.alias("id"), F.when(d % 3 == 0, "old").alias("explanation"), F.when(d % 2 == 0, "approved").otherwise("pending").alias("review_status"))
    runs = t.raw("events").select((F.col("event_id") % 1500).alias("id"), (F.col("event_type") != "error").alias("passed"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"), F.col("event_id").alias("at"))
    return rows, runs


_EXPLAINED = "WITH rows_ AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS explanation, CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'pending' END AS review_status FROM documents), last AS (SELECT event_id % 1500 AS id, 'text ' || CAST(max(event_id) AS VARCHAR) AS txt FROM events WHERE event_type <> 'error' GROUP BY 1) "


@query("m5_apply_explanations", _EXPLAINED + "SELECT id, coalesce(txt, explanation) AS explanation, CASE WHEN txt IS NOT NULL AND review_status = 'approved' THEN 'pending' ELSE review_status END AS review_status FROM rows_ LEFT JOIN last USING (id)", prelude=False)
def m5(t):
    return op.apply_explanations(*_explained(t))[0]


@query("m5_explanation_audits", _EXPLAINED + "SELECT id, 'explanation added' AS action, 'approved' AS old_value FROM rows_ JOIN last USING (id) WHERE review_status = 'approved'", prelude=False)
def m5_audits(t):
    return op.apply_explanations(*_explained(t))[1]


def _snapshots(t):
    u = F.col("user_id")
    count = lambda c: [F.count_if(F.col("event_type") == "click").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("mistakes"), F.sum(c).alias("payload")]
    e = t.raw("events")
    stored = e.filter((F.col("event_id") % 2 == 0) & (u % 5 != 0)).groupBy(u.alias("account")).agg(*count("event_id"))
    incoming = e.filter((F.col("event_id") % 2 == 1) & (u % 7 != 0)).groupBy(u.alias("account")).agg(*count("event_id")).withColumn("forced", F.col("account") % 11 == 0)
    return stored, incoming


_SNAP = """WITH o AS (SELECT user_id AS account, count(*) FILTER (WHERE event_type = 'click') AS attempts, count(*) FILTER (WHERE event_type = 'error') AS mistakes, CAST(sum(event_id) AS BIGINT) AS payload FROM events WHERE event_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY 1),
n AS (SELECT user_id AS account, count(*) FILTER (WHERE event_type = 'click') AS attempts, count(*) FILTER (WHERE event_type = 'error') AS mistakes, CAST(sum(event_id) AS BIGINT) AS payload FROM events WHERE event_id % 2 = 1 AND user_id % 7 <> 0 GROUP BY 1),
b AS (SELECT coalesce(n.account, o.account) AS account, n.attempts AS na, o.attempts AS oa, n.mistakes AS nm, o.mistakes AS om, n.payload AS np, o.payload AS op, coalesce(n.attempts < o.attempts OR n.mistakes < o.mistakes, false) AND NOT coalesce(n.account % 11 = 0, false) AS shrinks FROM n FULL JOIN o ON n.account = o.account) """


@query("m6_push_snapshots", _SNAP + "SELECT account, CASE WHEN shrinks OR na IS NULL THEN op ELSE np END AS payload, CASE WHEN shrinks OR na IS NULL THEN oa ELSE na END AS attempts, CASE WHEN shrinks OR na IS NULL THEN om ELSE nm END AS mistakes FROM b", prelude=False)
def m6(t):
    return op.push_snapshots(*_snapshots(t))[0]


@query("m6_refused", _SNAP + "SELECT account, na AS offered, oa AS held FROM b WHERE shrinks", prelude=False)
def m6_refused(t):
    return op.push_snapshots(*_snapshots(t))[1]


@query(
    "m7_mistake_cmds",
    """, c AS (SELECT event_id - event_id % 3 AS mistake_id, CASE event_id % 4 WHEN 0 THEN 'resolve' WHEN 1 THEN 'unresolve' ELSE 'retag' END AS cmd, 'tag' || CAST(event_id % 5 AS VARCHAR) AS arg, event_id AS spot FROM commands),
l AS (SELECT mistake_id, arg_max(cmd, spot) FILTER (WHERE cmd IN ('resolve', 'unresolve')) AS solve, max(spot) FILTER (WHERE cmd IN ('resolve', 'unresolve')) AS solved, arg_max(arg, spot) FILTER (WHERE cmd = 'retag') AS tag FROM c GROUP BY 1)
SELECT mistake_id, CASE WHEN solve = 'resolve' THEN solved WHEN solve = 'unresolve' THEN NULL ELSE resolved_ms END AS resolved_ms, coalesce(tag, mistake_type) AS mistake_type FROM mistakes LEFT JOIN l USING (mistake_id)""",
)
def m7(t):
    e = F.col("event_id")
    cmds = t.commands.select((e - e % 3).alias("mistake_id"), F.when(e % 4 == 0, "resolve").when(e % 4 == 1, "unresolve").otherwise("retag").alias("cmd"), F.concat(F.lit("tag"), (e % 5).cast("string")).alias("arg"), e.alias("at"))
    return op.apply_mistake_cmds(t.mistakes, cmds).select("mistake_id", "resolved_ms", "mistake_type")


@query("m8_replay", _EDITED + ", log AS (SELECT id % 500 AS id, field, new_value, id AS spot FROM audit) SELECT id, field, arg_max(coalesce(new_value, '-'), spot) AS value, count(*) AS changes FROM log GROUP BY 1, 2", prelude=False)
def m8(t):
    audits = op.diff_audit(*_edited(t), "id", ["status", "priority"])
    log = audits.select((F.col("id") % 500).alias("id"), "field", F.coalesce("new_value", F.lit("-")).alias("new_value"), F.col("id").alias("at"))
    return op.replay(log)
