"""Practice sets: blueprint fills for many seeds, reports, drills, descriptors, daily plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import half_up, norm_stem
from quillspark.operators.numbering import numbered
from quillspark.operators.statistics import accuracy
from quillspark.operators.windows import budget_fill_few, dedupe_stems


def _ticket() -> Column:
    return F.md5(F.concat_ws(":", "seed", "question_id"))


def build_sets(pool: DataFrame, blueprint: DataFrame, seeds: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """seed, section, question_id, number: each section's wanted count in seeded order, numbered through.

    pool: question_id, subject, stem; blueprint: section (order), subject, wanted; seeds: seed. Stems repeated in any section
    count once, at the first section that has them. Short sections are never padded."""
    need = pool.join(blueprint.select("subject", "section", "wanted"), "subject")
    if exclude is not None:
        need = need.join(exclude.select("question_id"), "question_id", "left_anti")
    once = dedupe_stems(need, norm_stem(F.col("stem")), ["section", "question_id"]).select("question_id", "section", "wanted")
    w = Window.partitionBy("seed", "section").orderBy("_t", "question_id")
    most = int(blueprint.agg(F.max("wanted")).first()[0] or 0)
    # Seeds are a stated list; each draws from the pruned pool, and tasks keep ``most`` rows of a section before they are shuffled.
    drawn = once.crossJoin(F.broadcast(seeds.select("seed"))).withColumn("_t", _ticket()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).filter(F.col("_rn") <= F.col("wanted"))
    order = Window.partitionBy("seed").orderBy("section", "_rn")
    return drawn.withColumn("number", F.row_number().over(order).cast("long")).select("seed", "section", "question_id", "number")


def set_ids(sets: DataFrame, kind: str) -> DataFrame:
    """seed, set_id (of type, seed and questions in order), questions."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "question_id"))), lambda x: x["question_id"]), ",")
    return sets.groupBy("seed").agg(F.sha1(F.concat_ws("|", F.lit(kind), F.col("seed"), ids)).alias("set_id"), F.count(F.lit(1)).alias("questions"))


def set_report(sets: DataFrame, blueprint: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each seed and section: wanted, got, how many short."""
    got = sets.groupBy("seed", "section").agg(F.count(F.lit(1)).alias("got"))
    every = seeds.select("seed").crossJoin(blueprint.select("section", "wanted"))
    return every.join(got, ["seed", "section"], "left").select("seed", "section", F.col("wanted").cast("long").alias("wanted"), F.coalesce("got", F.lit(0)).alias("got"), F.greatest(F.lit(0).cast("long"), F.col("wanted") - F.coalesce("got", F.lit(0))).alias("short_by"))


def build_drill(pool: DataFrame, mode: str, param: str, seed: str, size: int = 20, weak: DataFrame | None = None) -> DataFrame:
    """question_id, number of a drill: a section, a topic, or the weak topics given; the seed includes mode and parameter."""
    rows = pool.filter(F.col("subject") == param) if mode == "section" else pool.filter(F.col("topic_id") == param) if mode == "topic" else pool.join(weak.select("topic_id").distinct(), "topic_id", "left_semi")
    once = dedupe_stems(rows, norm_stem(F.col("stem")), ["question_id"]).select("question_id")
    drawn = once.withColumn("_t", F.md5(F.concat(F.lit(f"{mode}:{param}:{seed}:"), "question_id"))).orderBy("_t", "question_id").limit(size)
    at = Window.partitionBy(F.lit(0)).orderBy("_t", "question_id")  # at most ``size`` rows
    return drawn.withColumn("number", F.row_number().over(at).cast("long")).drop("_t")


def describe_set(sets: DataFrame) -> DataFrame:
    """Label and minutes of a set id mock:<mode>:<param>:<seed>; a bare seed is a full paper, as is an unknown mode.

    sets: set_id, questions, section_minutes (null unless a section)."""
    parts = F.split("set_id", ":")
    named = F.startswith("set_id", F.lit("mock:")) & (F.size(parts) >= 4)
    mode = F.when(named & F.get(parts, F.lit(1)).isin("section", "topic", "priority", "weak"), F.get(parts, F.lit(1))).otherwise("full")
    param = F.when(named, F.get(parts, F.lit(2))).otherwise("")
    minutes = F.when(mode == "full", 150).when(mode == "section", F.coalesce("section_minutes", "questions")).otherwise(F.col("questions"))
    label = F.when(mode == "full", F.lit("Full mock")).when(param == "", F.initcap(mode)).otherwise(F.concat(F.initcap(mode), F.lit(": "), param))
    return sets.select("set_id", mode.alias("mode"), label.alias("label"), minutes.cast("long").alias("minutes"))


def minutes_for(n: Column) -> Column:
    """Time for n questions at 45 seconds, in steps of five minutes, five at least."""
    return F.greatest(F.lit(5).cast("long"), half_up(n * 45 / 60 / 5) * 5)


def plan_items(users: DataFrame, papers: DataFrame, attempts: DataFrame, mistakes: DataFrame, subjects: DataFrame) -> DataFrame:
    """user_id, place, id, kind, cost (minutes), title, detail, code and param (its number): what each user might do today, in order of worth.

    users: user_id; papers: paper_no, paper_type, duration, total_questions, numbered once for all users;
    attempts: user_id, paper_no; mistakes: user_id, subject, part, topic_id, created_ms; subjects: subject, part, n, of which the first is
    learnt by a user with nothing else to do."""
    groups = _weak_groups(mistakes)
    total = groups.groupBy("user_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("again"), F.max_by("subject", -F.col("at")).alias("worst"), F.max("n").alias("most"))
    twice = F.col("again") > 0
    fix = total.select(
        "user_id",
        F.lit(1).alias("place"),
        F.when(twice, "fix-repeated").otherwise("fix-recent").alias("id"),
        F.lit("fix").alias("kind"),
        F.when(twice, F.least(F.lit(15), minutes_for(F.col("again")))).otherwise(F.least(F.lit(10), minutes_for(F.col("all")))).cast("double").alias("cost"),
        F.col("worst").alias("title"),
        F.when(twice, F.col("again")).otherwise(F.col("all")).cast("string").alias("detail"),
        F.when(twice, "MISSED_TWICE").otherwise("RECENT_MISTAKE").alias("code"),
        F.when(twice, F.col("most")).alias("param"),
    )
    by = groups.groupBy("user_id", "subject").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("user_id")
    weak = by.withColumns({"rn": F.row_number().over(w.orderBy(F.col("n").desc(), "subject")), "all": F.sum("n").over(w)}).filter("rn <= 2")
    weak = weak.select("user_id", F.col("rn") + 1, F.concat(F.lit("practice-"), "subject"), F.lit("practice"), F.lit(15.0), "subject", F.lit("12"), F.lit("HIGH_WEIGHTAGE"), half_up(F.col("n") * 100 / F.col("all")))
    # The first paper never sat: the smallest number that is missing among a user's papers, by counting up.
    order = Window.partitionBy("user_id").orderBy("paper_no")
    known = numbered(papers, ["paper_no"], "at")
    sat = attempts.select("user_id", "paper_no").distinct().join(known.select("paper_no", "at"), "paper_no").withColumn("rn", F.row_number().over(order))
    upto = sat.filter("rn = at").groupBy("user_id").agg(F.max("at").alias("run"))
    fresh = users.select("user_id").join(upto, "user_id", "left").withColumn("next", F.coalesce("run", F.lit(0)) + 1).join(known.withColumnRenamed("at", "next"), "next")
    none = F.lit(None).cast("long")
    paper = fresh.select("user_id", F.lit(4), F.concat(F.lit("paper-"), F.col("paper_no").cast("string")), F.lit("practice"), F.col("duration").cast("double"), F.replace("paper_type", F.lit("_"), F.lit(" ")), F.col("total_questions").cast("string"), F.lit("NEVER_SEEN"), none)
    some = fix.union(weak).union(paper).join(users.select("user_id"), "user_id", "left_semi")
    first = subjects.orderBy("part", "subject").limit(1).select(F.coalesce("subject", F.concat(F.lit("Part "), F.col("part"))).alias("title"), F.col("n").cast("string").alias("detail"))
    idle = users.select("user_id").join(some.select("user_id").distinct(), "user_id", "left_anti").join(F.broadcast(first)).join(F.broadcast(papers.select("paper_no").limit(1).select(F.lit(1).alias("_any"))))
    return some.union(idle.select("user_id", F.lit(5), F.lit("learn-first"), F.lit("learn"), F.lit(15.0), "title", "detail", F.lit("NEVER_SEEN"), none))


def _weak_groups(mistakes: DataFrame) -> DataFrame:
    """A user's mistakes by subject (else "Part n", else "Unsorted") and topic: count, latest, and place (from 1), most and latest first."""
    named = mistakes.withColumn("subject", F.coalesce("subject", F.concat(F.lit("Part "), F.col("part")), F.lit("Unsorted")))
    groups = named.groupBy("user_id", "subject", "topic_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_ms").alias("latest"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("latest").desc(), "subject", "topic_id")
    return groups.withColumn("at", F.row_number().over(w).cast("long"))


def daily_plan(users: DataFrame, papers: DataFrame, attempts: DataFrame, mistakes: DataFrame, subjects: DataFrame) -> DataFrame:
    """For each user: minutes, items (ids in order) that fit the budget (30 if null), the three weakest areas, overall percent, attempts scored, mistakes.

    users: user_id, budget; attempts: user_id, paper_no, score, max_score; the others as in plan_items()."""
    items = plan_items(users, papers, attempts, mistakes, subjects)
    own = users.select("user_id", F.coalesce("budget", F.lit(30.0)).alias("budget"))
    # Five items at most for each user.
    filled = budget_fill_few(items.join(own, "user_id"), "user_id", "budget")
    groups = _weak_groups(mistakes)
    weak = groups.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= 3, F.struct("at", "subject", "n")))), lambda x: F.concat_ws(":", x["subject"], x["n"].cast("string"))), "|").alias("weak_areas"), F.sum("n").alias("mistakes"))
    scored = accuracy(attempts).select("user_id", F.col("mean_pct").alias("overall_pct"), F.col("scored").alias("attempts"))
    out = own.select("user_id").join(filled, "user_id", "left").join(weak, "user_id", "left").join(scored, "user_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("user_id", F.coalesce("spent", F.lit(0.0)).alias("minutes"), F.coalesce("taken", F.lit("")).alias("items"), F.coalesce("weak_areas", F.lit("")).alias("weak_areas"), "overall_pct", F.coalesce("attempts", zero).alias("attempts"), F.coalesce("mistakes", zero).alias("mistakes"))
