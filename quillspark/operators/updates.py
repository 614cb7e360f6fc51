"""State changes on tables: merges, transitions, decisions, diffs, replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remerge(prior: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, audits) after reading a source again. Both: id, stem, correct; prior also review_status, reviewer, note, topic_id.

    Unchanged content keeps its decision; changed content of a reviewed row goes back to pending with an audit row; a prior
    topic stays; rows gone from the source go. One join gives both results."""
    old = prior.select("id", *[F.col(c).alias(f"_{c}") for c in ("stem", "correct", "review_status", "reviewer", "note", "topic_id")])
    both = incoming.join(old, "id", "left")
    known = F.col("_review_status").isNotNull()
    changed = known & (~F.col("stem").eqNullSafe(F.col("_stem")) | ~F.col("correct").eqNullSafe(F.col("_correct")))
    undone = changed & (F.col("_review_status") != "pending")
    both = both.withColumns({"_undone": F.coalesce(undone, F.lit(False)), "_new": ~known})
    kept = lambda c: F.when(F.col("_undone") | F.col("_new"), F.lit(None)).otherwise(F.col(c))
    rows = both.select("id", "stem", "correct", F.when(F.col("_undone") | F.col("_new"), "pending").otherwise(F.col("_review_status")).alias("review_status"), kept("_reviewer").alias("reviewer"), F.when(F.col("_undone"), "source changed after review").when(~F.col("_new"), F.col("_note")).alias("note"), F.col("_topic_id").alias("topic_id"))
    audits = both.filter("_undone").select("id", F.lit("invalidated").alias("action"), F.lit("review_status").alias("field"), F.col("_review_status").alias("old_value"), F.lit("pending").alias("new_value"))
    return rows, audits


def bulk_approve(rows: DataFrame, problems: DataFrame, actor: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, audits, held-back histogram): pending rows in scope (column in_scope) without problems are approved."""
    held = problems.filter(F.size("problems") > 0).select("id", "problems")
    both = rows.join(held, "id", "left")
    open_ = (F.col("review_status") == "pending") & F.col("in_scope")
    ready = open_ & F.col("problems").isNull()
    after = both.withColumn("review_status", F.when(ready & F.lit(not dry_run), "approved").otherwise(F.col("review_status"))).drop("problems")
    audits = both.filter(ready).select("id", F.lit("approved").alias("action"), F.lit("pending").alias("old_value"), F.lit(actor).alias("actor"))
    back = both.filter(open_ & F.col("problems").isNotNull()).select(F.explode("problems").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return after, audits, back


def apply_decisions(rows: DataFrame, problems: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): approve (refused on problems unless overridden with a note), reject, reset. decisions: id, action, override, note."""
    held = problems.filter(F.size("problems") > 0).select("id", F.lit(True).alias("_held"))
    both = rows.join(decisions, "id", "left").join(held, "id", "left")
    noted = F.coalesce(F.trim("note"), F.lit("")) != ""
    refused = (F.col("action") == "approve") & F.coalesce("_held", F.lit(False)) & ~(F.coalesce("override", F.lit(False)) & noted)
    both = both.withColumn("_refused", F.coalesce(refused, F.lit(False)))
    status = F.when(F.col("_refused") | F.col("action").isNull(), F.col("review_status")).when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("pending")
    return both.select("id", status.alias("review_status")), both.filter("_refused").select("id", "action")


def diff_audit(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, action, old_value, new_value for every field that differs; a row without a predecessor is created."""
    text = lambda df: df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "field", "value")
    a, b = text(old).withColumnRenamed("value", "old_value"), text(new).withColumnRenamed("value", "new_value")
    was = old.select(key, F.lit(True).alias("_was"))
    both = b.join(a, [key, "field"], "left").join(was, key, "left")
    changed = both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return changed.select(key, "field", F.when(F.col("_was").isNull(), "created").otherwise("edited").alias("action"), "old_value", "new_value")


def apply_explanations(rows: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, audits): the latest passing run's text is written; an approved row goes back to pending. runs: id, passed, text, at."""
    last = runs.filter("passed").groupBy("id").agg(F.max_by("text", "at").alias("_text"))
    both = rows.join(last, "id", "left")
    back = F.col("_text").isNotNull() & (F.col("review_status") == "approved")
    after = both.select("id", F.coalesce("_text", "explanation").alias("explanation"), F.when(back, "pending").otherwise(F.col("review_status")).alias("review_status"))
    return after, both.filter(back).select("id", F.lit("explanation added").alias("action"), F.lit("approved").alias("old_value"))


def push_snapshots(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted table, refused accounts): a snapshot replaces the stored one unless it has fewer attempts or mistakes and is not forced."""
    old = stored.select("account", *[F.col(c).alias(f"_{c}") for c in ("payload", "attempts", "mistakes")])
    both = incoming.join(old, "account", "full")
    shrinks = F.coalesce((F.col("attempts") < F.col("_attempts")) | (F.col("mistakes") < F.col("_mistakes")), F.lit(False)) & ~F.coalesce("forced", F.lit(False))
    keep_old = shrinks | F.col("attempts").isNull()
    take = lambda c: F.when(keep_old, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("account", take("payload"), take("attempts"), take("mistakes")), both.filter(shrinks).select("account", F.col("attempts").alias("offered"), F.col("_attempts").alias("held"))


def apply_mistake_cmds(mistakes: DataFrame, commands: DataFrame) -> DataFrame:
    """Mistakes after resolve, unresolve and retag commands; of each kind the last wins. commands: mistake_id, cmd, arg, at."""
    solve = F.col("cmd").isin("resolve", "unresolve")
    last = commands.groupBy("mistake_id").agg(F.max_by("cmd", F.when(solve, F.col("at"))).alias("_solve"), F.max(F.when(solve, F.col("at"))).alias("_at"), F.max_by("arg", F.when(F.col("cmd") == "retag", F.col("at"))).alias("_tag"))
    both = mistakes.join(last, "mistake_id", "left")
    return both.withColumns({"resolved_ms": F.when(F.col("_solve") == "resolve", F.col("_at")).when(F.col("_solve") == "unresolve", F.lit(None)).otherwise(F.col("resolved_ms")), "mistake_type": F.coalesce("_tag", "mistake_type")}).drop("_solve", "_at", "_tag")


def replay(audits: DataFrame) -> DataFrame:
    """Current value of each row's field: the newest entry of the log. audits: id, field, new_value, at."""
    return audits.groupBy("id", "field").agg(F.max_by("new_value", "at").alias("value"), F.count(F.lit(1)).alias("changes"))
