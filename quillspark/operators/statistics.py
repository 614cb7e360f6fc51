"""Aggregations: review, corpus, topics, mistakes, scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.functions import MARKS, half_up, half_up_quotient, whole


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def review_stats(questions: DataFrame) -> DataFrame:
    """For each paper: total, approved, rejected, pending, flagged."""
    is_ = lambda s: F.count_if(F.col("review_status") == s)
    return questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("total"), is_("approved").alias("approved"), is_("rejected").alias("rejected"), is_("pending").alias("pending"), F.count_if(F.col("n_warnings") > 0).alias("flagged"))


def corpus_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    """Chunks and characters for each combination of keys, with totals."""
    return chunks.rollup(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"))


def run_stats(runs: DataFrame) -> DataFrame:
    """For each language: runs, passed, failed, of one stage only."""
    return runs.groupBy("lang").agg(F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("verified"), F.count_if(~F.col("passed")).alias("unverified"), F.count_if(F.col("mode") == "single").alias("single_stage"))


def topic_counts(questions: DataFrame) -> DataFrame:
    return count_by(questions.filter("topic_id is not null"), "topic_id")


def subject_counts(questions: DataFrame) -> DataFrame:
    """Subject, or "Part n" where there is none; rows with neither are left out."""
    label = F.coalesce("subject", F.concat(F.lit("Part "), F.col("part")))
    return count_by(questions.withColumn("label", label).filter("label is not null"), "label")


def topic_frequency(questions: DataFrame, papers: DataFrame, n: int | None = None) -> DataFrame:
    """Questions and distinct sittings of each topic, ranked by sittings, questions, then name."""
    both = questions.filter("topic_id is not null").join(papers.select("paper_id", "sitting"), "paper_id")
    out = both.groupBy("topic_id").agg(F.count(F.lit(1)).alias("questions"), F.count_distinct("sitting").alias("sittings"))
    out = out.orderBy(F.col("sittings").desc(), F.col("questions").desc(), "topic_id")
    return out.limit(n) if n is not None else out


def strand_share(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """Share of the tagged rows that each strand holds."""
    by = count_by(questions.join(topics, "topic_id"), "strand")
    return by.join(by.agg(F.sum("n").alias("all"))).select("strand", "n", (F.col("n") / F.col("all")).alias("share"))


def answer_spread(sets: DataFrame, options: DataFrame, labels: list[str]) -> DataFrame:
    """For each set: count of each correct label, the largest share, and whether it is over 0.4."""
    right = sets.join(options.filter("is_correct"), "question_id").groupBy("set_id").pivot("label", labels).count().na.fill(0)
    total = sum((F.col(x) for x in labels), F.lit(0))
    return right.withColumn("max_share", F.greatest(*labels) / total).withColumn("skewed", F.col("max_share") > 0.4)


def weaknesses(mistakes: DataFrame) -> DataFrame:
    """Groups of a user's mistakes by subject and topic, with count and latest."""
    return mistakes.groupBy("user_id", "subject", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_ms").alias("latest_ms"), F.array_join(F.sort_array(F.collect_list(F.col("mistake_id").cast("string"))), ",").alias("items"))


def mistake_types(mistakes: DataFrame) -> DataFrame:
    return count_by(mistakes.withColumn("type", F.coalesce("mistake_type", F.lit("untagged"))), "type")


def repeat_offenders(mistakes: DataFrame, n: int = 200) -> DataFrame:
    """A user's unresolved mistakes by question, most often first, then latest."""
    each = mistakes.filter("resolved_ms is null").groupBy("user_id", "question_no").agg(F.count(F.lit(1)).alias("misses"), F.max("created_ms").alias("latest_ms"))
    order = Window.partitionBy("user_id").orderBy(F.col("misses").desc(), F.col("latest_ms").desc(), "question_no")
    return each.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def subject_share(mistakes: DataFrame) -> DataFrame:
    """Share of a user's mistakes in each subject, in whole percent."""
    each = count_by(mistakes, "user_id", "subject")
    return each.withColumn("pct", half_up(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("user_id"))))


def score(attempts: DataFrame, papers_questions: DataFrame, responses: DataFrame, rules: dict = MARKS) -> tuple[DataFrame, DataFrame]:
    """(outcome of each question, totals of each attempt).

    attempts: attempt_id, exam; papers_questions: attempt_id, question_no, accepted, status; responses: attempt_id, question_no, chosen.
    A bonus scores for any answer, not for a blank; exams without rules follow the first rule."""
    first = next(iter(rules.values()))
    right, wrong, blank = ((lambda i: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("exam")), F.lit(first[i])))(i) for i in range(3))
    rows = papers_questions.join(attempts, "attempt_id").join(responses, ["attempt_id", "question_no"], "left")
    chosen = F.col("chosen")
    outcome = F.when(chosen.isNull(), "unattempted").when(F.col("status") == "bonus", "bonus").when(F.array_contains("accepted", chosen), "correct").otherwise("incorrect")
    rows = rows.withColumn("outcome", outcome).withColumn("marks", F.when(F.col("outcome").isin("bonus", "correct"), right).when(F.col("outcome") == "incorrect", wrong).otherwise(blank))
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    totals = rows.withColumn("most", right).groupBy("attempt_id").agg(F.sum("marks").alias("score"), F.sum("most").alias("max_score"), n("correct"), n("incorrect"), n("unattempted"), n("bonus"))
    return rows.select("attempt_id", "question_no", "chosen", "outcome", "marks"), totals


@F.pandas_udf(LongType())
def _mean_percent(sums: pd.Series, n: pd.Series) -> pd.Series:
    """Mean of ratios in percent, exact, halves up. sums: for each maximum, the sum of its scores."""
    from fractions import Fraction

    def one(parts, count) -> int:
        mean = sum((Fraction(int(p["score"]), int(p["most"])) for p in parts), Fraction(0)) * 100 / int(count)
        return (mean + Fraction(1, 2)).__floor__()

    return pd.Series([one(p, c) for p, c in zip(sums, n, strict=True)], dtype="int64")


def accuracy(attempts: DataFrame, key: str = "user_id") -> DataFrame:
    """For each user: mean percent (of attempts with a maximum), best percent, number of scored attempts.

    Exact, whatever the order of rows: scores are summed for each maximum as whole numbers, and a mean of ratios is rounded as
    a fraction. A null score counts as 0."""
    most, score = whole(F.col("max_score")), F.coalesce(whole(F.col("score")), F.lit(0))
    scored = attempts.select(key, most.alias("most"), score.alias("score")).filter("most > 0")
    by = scored.groupBy(key, "most").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"), F.max(half_up_quotient(F.col("score") * 100, F.col("most"))).alias("best"))
    own = by.groupBy(key).agg(F.collect_list(F.struct("most", "score")).alias("sums"), F.sum("n").alias("scored"), F.max("best").alias("best_pct"))
    return own.select(key, _mean_percent("sums", "scored").alias("mean_pct"), "best_pct", "scored")


def best_attempt(attempts: DataFrame, *keys: str) -> DataFrame:
    """The attempt of the best ratio, the earlier on ties."""
    order = F.struct(F.col("score") / F.col("max_score"), -F.col("attempt_id"))
    return attempts.filter("max_score > 0").groupBy(*keys).agg(F.max_by("attempt_id", order).alias("attempt_id"))


STATES = ["notVisited", "answeredMarked", "marked", "answered", "notAnswered"]


def palette(rows: DataFrame) -> DataFrame:
    """For each attempt: how many questions are in each state of visiting, answering and marking."""
    answered = F.col("chosen").isNotNull()
    state = F.when(F.coalesce("visited", F.lit(0)) == 0, "notVisited").when((F.col("marked") == 1) & answered, "answeredMarked").when(F.col("marked") == 1, "marked").when(answered, "answered").otherwise("notAnswered")
    return rows.withColumn("state", state).groupBy("attempt_id").pivot("state", STATES).count().na.fill(0)


def latency(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Upper median by counting each distinct value, so no group's values meet in one task; totals and mean."""
    by = runs.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = by.withColumn("upto", F.sum("c").over(run)).withColumn("all", F.sum("c").over(Window.partitionBy(key)))
    middle = F.floor(F.col("all") / 2)
    return placed.groupBy(key).agg(F.min(F.when(F.col("upto") > middle, F.col(value))).alias("median"), F.sum("c").alias("n"), F.sum(F.col(value) * F.col("c")).alias("total"))


def reason_histogram(rows: DataFrame, messages: str) -> DataFrame:
    """Messages cut at the first colon, bracket or dash, counted."""
    each = rows.select(F.explode(messages).alias("m")).select(F.trim(F.substring_index(F.substring_index(F.substring_index("m", ":", 1), "(", 1), " — ", 1)).alias("reason"))
    return count_by(each, "reason")


def content_counts(papers: DataFrame, questions: DataFrame, exam: str) -> DataFrame:
    """Papers and questions in all, and those an exam sees."""
    visible = papers.filter(F.col("exam_code") == exam).select("paper_id")
    a = papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("exam_code") == exam).alias("visible_papers"))
    b = questions.agg(F.count(F.lit(1)).alias("questions"))
    c = questions.join(visible, "paper_id", "left_semi").agg(F.count(F.lit(1)).alias("visible_questions"))
    return a.join(b).join(c)
