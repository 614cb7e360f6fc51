"""Filters, projections and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def opt_filter(df: DataFrame, **equal) -> DataFrame:
    """Keep rows whose columns equal the values given; None is no filter."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def scope(detail: DataFrame, papers: DataFrame, exam: str, paper_type: str | None = None) -> DataFrame:
    """Detail rows whose paper belongs to the exam; an exam without papers has none."""
    return detail.join(opt_filter(papers, exam_code=exam, paper_type=paper_type).select("paper_id"), "paper_id", "left_semi")


def gate(rows: DataFrame) -> DataFrame:
    """Approved rows only."""
    return rows.filter(F.col("review_status") == "approved")


def readmit(rows: DataFrame, note: str, unreviewed: list[str]) -> DataFrame:
    """Approved rows, and those pending only because of the change the note names, with the unreviewed columns nulled."""
    back = rows.filter((F.col("review_status") == "pending") & (F.col("review_note") == note)).withColumns({c: F.lit(None).cast(dict(rows.dtypes)[c]) for c in unreviewed})
    return gate(rows).unionByName(back)


def light_pool(questions: DataFrame) -> DataFrame:
    """What selection needs, and no more."""
    return questions.select("question_id", "subject", "topic_id", "stem")


def load_by_ids(ids: DataFrame, questions: DataFrame) -> DataFrame:
    """Full rows of the ids, with the place asked for (pos)."""
    return questions.join(ids, "question_id")


def usable(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Questions that stand alone: a stem, two options or more, one correct, no two texts alike but for case and blanks."""
    text = F.lower(F.trim("text"))
    good = options.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("right"), F.count_distinct(text).alias("texts")).filter("n >= 2 and right > 0 and texts = n")
    return questions.filter(F.trim("stem") != "").join(good.select("question_id"), "question_id", "left_semi")


def worklist(rows: DataFrame, columns: list[str], status: str | None = None, limit: int | None = None, order: str = "question_id") -> DataFrame:
    """Rows that lack any of the columns."""
    lacking = reduce(Column.__or__, [F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in columns])
    out = opt_filter(rows.filter(lacking), review_status=status)
    return out.orderBy(order).limit(limit) if limit is not None else out


def localise(rows: DataFrame, field: str, lang: str, fallback: str = "en") -> DataFrame:
    """The field in a language, else in English, with the language used and whether it fell back."""
    own, other = F.nullif(F.trim(f"{field}_{lang}"), F.lit("")), F.col(f"{field}_{fallback}")
    return rows.withColumns({field: F.coalesce(own, other), "used_lang": F.when(own.isNotNull(), lang).otherwise(fallback), "fell_back": own.isNull()})


def available_langs(questions: DataFrame, options: DataFrame, langs: list[str]) -> DataFrame:
    """Languages in which a question and all its options exist."""
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    whole = options.groupBy("question_id").agg(*[F.bool_and(has(f"text_{x}")).alias(f"_{x}") for x in langs])
    found = F.array_compact(F.array(*[F.when(has(f"stem_{x}") & F.col(f"_{x}"), x) for x in langs]))
    return questions.join(whole, "question_id").select("question_id", F.array_join(found, ",").alias("langs"))


def review_queue(questions: DataFrame, limit: int = 200) -> DataFrame:
    """The least certain first."""
    return questions.orderBy("confidence", "paper_id", "number", "question_id").limit(min(limit, 2000))


def seeded(seed: str, key: str = "question_id") -> Column:
    """An order that depends on seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def first_per(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)


def quick_set(users: DataFrame, missed: DataFrame, pool: DataFrame, n: int = 12) -> DataFrame:
    """For each user (user_id, subject, seed): questions missed before, else a seeded draw of the subject, else of everything.

    The draw for a (subject, seed) is made once and shared by the users that ask for it; each orders all of the subject's questions
    anew, and tasks keep ``n`` of them before they are shuffled."""
    own = first_per(missed.select("user_id", "question_id").distinct().join(users.select("user_id", "seed"), "user_id").withColumn("at", F.md5(F.concat_ws(":", "seed", "question_id"))), ["user_id"], ["at", "question_id"], n)
    rest = users.join(missed.select("user_id").distinct(), "user_id", "left_anti")
    asks = rest.select("subject", "seed").distinct()
    drawn = first_per(pool.select("subject", "question_id").join(F.broadcast(asks), "subject").withColumn("at", F.md5(F.concat_ws(":", "seed", "question_id"))), ["subject", "seed"], ["at", "question_id"], n)
    part = rest.join(drawn.select("subject", "seed", "question_id", "rn"), ["subject", "seed"])
    other = rest.join(pool.select("subject").distinct(), "subject", "left_anti")
    every = first_per(pool.select("question_id").crossJoin(F.broadcast(other.select("seed").distinct())).withColumn("at", F.md5(F.concat_ws(":", "seed", "question_id"))), ["seed"], ["at", "question_id"], n)
    last = other.join(every.select("seed", "question_id", "rn"), "seed")
    out = [x.select("user_id", F.lit(s).alias("origin"), "question_id", "rn") for x, s in ((own, "missed"), (part, "subject"), (last, "exam"))]
    return out[0].union(out[1]).union(out[2])


def top_topics(questions: DataFrame, most: int = 12) -> DataFrame:
    """topic_id, count and rank (from 0) of the topics asked most; rows without a topic count for none."""
    counts = questions.filter("topic_id is not null").groupBy("topic_id").count().orderBy(F.col("count").desc(), "topic_id").limit(most)
    # ``most`` rows.
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("count").desc(), "topic_id")) - 1)


def priority_pool(pool: DataFrame, ranks: DataFrame, most_rank: int = 12, top: int = 60, draw: int = 20, seed: str = "1") -> DataFrame:
    """Of each subject: questions on the hardest-hitting topics, the first ``top`` of them, and a seeded draw from those."""
    held = pool.join(ranks.filter(F.col("rank") < most_rank).select("topic_id", "rank"), "topic_id")
    head = first_per(held, ["subject"], ["rank", "question_id"], top, "place")
    return first_per(head.withColumn("_at", seeded(seed)), ["subject"], ["_at", "question_id"], draw).drop("_at")


def paused(attempts: DataFrame, limit: int = 50) -> DataFrame:
    """Attempts left open, the latest first."""
    return attempts.filter("submitted_ms is null").orderBy(F.coalesce("paused_ms", "started_ms").desc(), "attempt_id").limit(limit)
