"""Joins: keys, blueprints, passages, assembly, coverage, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import accepted


def mistake_detail(mistakes: DataFrame, questions: DataFrame) -> DataFrame:
    """Mistakes with their question; those whose question is gone are dropped."""
    return mistakes.join(questions, "question_no")


def overlay_keys(main: DataFrame, language: DataFrame) -> DataFrame:
    """One key for each (paper, number): the language section's where it has one."""
    both = main.withColumn("_at", F.lit(0)).unionByName(language.withColumn("_at", F.lit(1)))
    return both.groupBy("paper_id", "number").agg(F.max_by("raw", F.struct("_at", "raw")).alias("raw"))


def join_key(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Questions with their key, its labels, whether bonus or multiple, and a warning where none matched."""
    out = questions.join(key, ["paper_id", "number"], "left")
    labels = accepted(F.col("raw"))
    return out.withColumns({"labels": F.array_join(labels, ""), "bonus": F.coalesce(F.col("raw") == "Z", F.lit(False)), "multi": F.coalesce(F.size(labels) > 1, F.lit(False)), "warning": F.when(F.col("raw").isNull(), "no key")})


def decode_key(rows: DataFrame) -> DataFrame:
    labels = accepted(F.col("key_raw"))
    return rows.withColumns({"labels": F.array_join(labels, ","), "status": F.when(F.col("key_raw") == "Z", "bonus").otherwise("ok"), "multi_key": F.size(labels) > 1})


def place(questions: DataFrame, blueprint: DataFrame) -> DataFrame:
    """The blueprint's subject for a question's part and number; null where none covers it. Blueprints are configuration."""
    b = blueprint.select(F.col("part").alias("_part"), "first", "last", F.col("subject").alias("placed"))
    return questions.join(F.broadcast(b), (F.col("part") == F.col("_part")) & F.col("number").between(F.col("first"), F.col("last")), "left").drop("_part", "first", "last")


def placement_conflicts(questions: DataFrame, blueprint: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Questions whose own banner, by its alias, differs from the blueprint's subject, or that none covers."""
    names = F.create_map(*[x for kv in aliases.items() for x in map(F.lit, kv)])
    placed = place(questions, blueprint).withColumn("banner", F.coalesce(F.try_element_at(names, F.col("subject")), F.col("subject")))
    problem = F.when(F.col("placed").isNull(), "unplaced").when(F.col("banner") != F.col("placed"), "conflict")
    return placed.withColumn("problem", problem).filter("problem is not null")


def attach_passages(questions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Questions with the passage of the range that covers their number; a range without text warns."""
    each = ranges.select("paper_id", "passage", F.explode(F.sequence("low", "high")).alias("number"), F.lit(True).alias("_covered"))
    out = questions.join(each, ["paper_id", "number"], "left")
    return out.withColumn("warning", F.when(F.col("_covered") & F.col("passage").isNull(), "passage missing")).drop("_covered")


def assemble(papers: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Nested documents: each paper with its questions, each with its options, in order.

    Questions and options meet by grouping, both by paper first: tables that are dealt by paper are not shuffled again."""
    q, o = F.struct("pos", "stem"), F.struct("label", "text", "is_correct")
    keys = ["paper_id", "question_id"]
    rows = questions.select(*keys, q.alias("q")).unionByName(options.select(*keys, o.alias("o")), allowMissingColumns=True)
    each = rows.groupBy(*keys).agg(F.collect_list("q").alias("qs"), F.array_sort(F.collect_list("o")).alias("options"))
    each = each.select(*keys, F.explode("qs").alias("q"), F.when(F.size("options") > 0, F.col("options")).alias("options"))
    q = each.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("q.pos", "question_id", "q.stem", "options"))).alias("questions"))
    return papers.join(q, "paper_id", "left")


def open_failures(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Failed runs without a passing run of the same keys."""
    return runs.filter(~F.col("passed")).join(runs.filter("passed").select(*keys).distinct(), keys, "left_anti")


def coverage(names: DataFrame, aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """(state, item): covered targets, missing ones, aliases that lead nowhere (dead), names without an alias (unmapped)."""
    mapped = names.join(aliases, "name")
    hit = mapped.join(targets, "target", "left_semi")
    out = [
        (hit.select("target").distinct(), "covered", "target"),
        (targets.join(mapped.select("target").distinct(), "target", "left_anti"), "missing", "target"),
        (aliases.join(targets, "target", "left_anti").select("name").distinct(), "dead", "name"),
        (names.join(aliases.select("name").distinct(), "name", "left_anti"), "unmapped", "name"),
    ]
    frames = [f.select(F.lit(s).alias("state"), F.col(c).alias("item")) for f, s, c in out]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


def fill_gaps(base: DataFrame, external: DataFrame, key: str, column: str, domain: DataFrame, least: int = 1) -> DataFrame:
    """External values only where ours is null and only from the domain; with the origin. Fewer than ``least`` of them are refused."""
    good = external.filter(F.col(column).isNotNull()).join(domain, column, "left_semi").select(key, F.col(column).alias("_ext"))
    enough = good.agg((F.count(F.lit(1)) >= least).alias("_ok"))
    out = base.join(good, key, "left").join(enough)
    value = F.coalesce(F.col(column), F.when(F.col("_ok"), F.col("_ext")))
    origin = F.when(F.col(column).isNotNull(), "own").when(F.col("_ok") & F.col("_ext").isNotNull(), "filled").otherwise("empty")
    return out.withColumns({"origin": origin, column: value}).drop("_ext", "_ok")


def glossary(terms: DataFrame, lang: str, subject: str, most: int = 60) -> DataFrame:
    """Terms with a value in the language: of the subject or of none; all of them if there are none; at most ``most``."""
    have = terms.filter(F.col(f"term_{lang}").isNotNull())
    fit = have.withColumn("_fit", F.col("subject").isNull() | (F.col("subject") == subject))
    some = fit.agg(F.max("_fit").alias("_any"))
    return fit.join(some).filter(F.col("_fit") | ~F.col("_any")).orderBy("term_en").limit(most).drop("_fit", "_any")
