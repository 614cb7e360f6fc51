"""Streams over the events, run to their end; each has a twin at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import streaming as op
from quillspark.plans import query
from quillspark.sources.bindings import commands


def _stream(t):
    return commands(op.open_stream(t.spark, f"{t.folder}/events.parquet*", t.raw("events").schema))


_RESPONSES = "SELECT attempt_id, question_no, user_id, raw_chosen, visited, marked, time_ms, last_ms FROM responses"


@query("st1_fold_responses", _RESPONSES)
def st1(t):
    return op.stream_responses(_stream(t))


@query("st1_fold_responses_at_rest", _RESPONSES)
def st1_rest(t):
    return t.responses


_TIME = """, g AS (SELECT attempt_id, ms, event_id, event_type, ms - lag(ms) OVER (PARTITION BY attempt_id ORDER BY ms, event_id) AS gap FROM commands),
c AS (SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type IN ('error', 'submit') THEN 0 WHEN gap > 2592000000 THEN 0 END AS sign FROM g),
s AS (SELECT *, last_value(sign IGNORE NULLS) OVER (PARTITION BY attempt_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM c)
SELECT attempt_id, CAST(sum(CASE WHEN state = 1 AND gap <= 2592000000 THEN gap ELSE 0 END) AS BIGINT) AS active_ms, max(ms) AS last_ms FROM s GROUP BY 1"""


@query("st2_fold_time", _TIME)
def st2(t):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name, None)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return op.times(op.settle(op.stream_time(_stream(t)), ["attempt_id", "spell"], "time"))
    finally:
        t.spark.conf.set(name, before) if before else t.spark.conf.unset(name)


@query("st2_fold_time_at_rest", _TIME)
def st2_rest(t):
    return op.fold_time(t.commands)


@query("st3_mistake_sink", "SELECT DISTINCT substr(sha1(attempt_id || '|' || CAST(question_no AS VARCHAR) || '|' || CAST(ms AS VARCHAR)), 1, 12) AS mistake_id, user_id, question_no FROM commands WHERE event_type IN ('error', 'purchase')")
def st3(t):
    twice = _stream(t).union(_stream(t))
    return op.settle(op.mistake_sink(twice), ["mistake_id"], "mistakes", "append").select("mistake_id", "user_id", "question_no")


@query("st4_weakness", "SELECT user_id, event_type AS subject, ms - ms % 86400000 AS day_ms, count(*) AS n FROM commands WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2, 3")
def st4(t):
    mistakes = _stream(t).filter(F.col("event_type").isin("error", "purchase")).withColumn("subject", F.col("event_type"))
    return op.settle(op.weakness_counts(mistakes), ["user_id", "subject", "day_ms"], "weakness")
