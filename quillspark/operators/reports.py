"""Shares and report parts over what other operators found, and keys whose sections are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, keys: list[str], value: str, none: str = "none") -> DataFrame:
    """keys, value, n and share: how often each group has each value; a null value is ``none``."""
    by = rows.withColumn(value, F.coalesce(F.col(value), F.lit(none))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # One row for each value of a group.
    total = F.sum("n").over(Window.partitionBy(*keys))
    return by.withColumn("share", F.round(F.col("n") / total, 6))


def output_rates(parsed: DataFrame, producer: str) -> DataFrame:
    """producer, outputs, failed and rate of failure; parsed has ok, as parse_outputs() gives it."""
    by = parsed.groupBy(producer).agg(F.count(F.lit(1)).alias("outputs"), F.count_if(~F.col("ok")).alias("failed"))
    return by.withColumn("rate", F.round(F.col("failed") / F.col("outputs"), 6))


def method_counts(questions: DataFrame, langs: list[str]) -> DataFrame:
    """lang, method, n: how each language's text was extracted (columns extraction_<lang>); missing is ``none``."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.coalesce(F.col(f"extraction_{x}"), F.lit("none")).alias("method")) for x in langs])).alias("m")
    return questions.select(each).groupBy("m.lang", "m.method").agg(F.count(F.lit(1)).alias("n"))


def verdict_counts(rows: DataFrame, key: str, translated: Column) -> DataFrame:
    """For each key, and TOTAL: verdicts of each kind, rows without a translation, and percent that pass (halves up)."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    agg = rows.withColumn("_t", F.coalesce(translated, F.lit(False))).rollup(key).agg(F.grouping_id().alias("_g"), n("PASS"), n("JUDGE"), n("BLOCK"), F.count_if(~F.col("_t")).alias("untranslated"), F.count(F.lit(1)).alias("rows"))
    return agg.filter("rows > 0").select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.coalesce(F.col(key), F.lit("none"))).alias(key), "pass", "judge", "block", "untranslated", F.floor(F.col("pass") * 100 / F.col("rows") + 0.5).cast("long").alias("pass_pct"))


def newest_sessions(digest: DataFrame, order: list[str], most: int = 50, owner: str | None = None) -> DataFrame:
    """The ``most`` newest sessions, of each owner if there is one; order: columns, the last session has the largest."""
    keys = [F.desc(c) for c in order]
    if owner is None:
        return digest.orderBy(*keys).limit(most)
    return digest.withColumn("_rn", F.row_number().over(Window.partitionBy(owner).orderBy(*keys))).filter(F.col("_rn") <= most).drop("_rn")


#: What a paper type's core section is called, and its numeral.
SECTIONS = {"CTET_P1": ("PAPER-I", ("MAIN",)), "CTET_P2_MATHSCI": ("PAPER-II", ("MATH",)), "CTET_P2_SOCSCI": ("PAPER-II", ("SOCIAL", "SOS"))}
#: A section of a language has a number of two digits and its name.
LANGUAGE_SECTION = r"[0-9]{2}[- \t]+([A-Z]+)"


def label_sections(official: DataFrame) -> DataFrame:
    """official (set_code, section, number, official) with paper_type (the core section's, whatever its spelling) or lang (a language's).

    Labels that are neither have neither. Paper I never takes a section of Paper II."""
    head = F.upper("section")
    numeral = F.regexp_extract(head, r"^[ ]*(PAPER-II?)", 1)
    lang = F.nullif(F.regexp_extract(head, LANGUAGE_SECTION, 1), F.lit(""))
    named = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(head, w))
    types = [F.when((numeral == n) & lang.isNull() & named(ws), t) for t, (n, ws) in SECTIONS.items()]
    return official.withColumns({"paper_types": F.array_compact(F.array(*types)), "lang": lang})


def verify_sections(ours: DataFrame, official: DataFrame, least: float = 0.95) -> DataFrame:
    """For each paper: answers checked, that differ, without an official one, and the language section that was recognised.

    ours: paper_id, paper_type, set_code, number, ours; official: set_code, section, number, official. Core answers come from the core
    section of the paper's set and type; the others from the language section that agrees best, if it does in ``least`` of the
    shared answers (ties to the smaller name), else they stay unmatched. Answers of ours that are blank are not looked at."""
    mine = ours.filter(F.trim("ours") != "")
    known = label_sections(official)
    core = known.select("set_code", "number", F.explode("paper_types").alias("paper_type"), "section", "official").groupBy("set_code", "paper_type", "number").agg(F.max_by("official", "section").alias("core"))
    first = mine.join(core, ["set_code", "paper_type", "number"], "left")
    rest = first.filter("core is null").select("paper_id", "set_code", "number", "ours")
    langs = known.filter("lang is not null").groupBy("set_code", "lang", "number").agg(F.max_by("official", "section").alias("theirs"))
    agree = rest.join(langs, ["set_code", "number"]).groupBy("paper_id", "set_code", "lang").agg(F.count_if(F.col("ours") == F.col("theirs")).alias("same"), F.count(F.lit(1)).alias("n"))
    fit = agree.filter(F.col("same") >= F.col("n") * least).groupBy("paper_id", "set_code").agg(F.min_by("lang", F.struct(-F.col("same") / F.col("n"), F.col("lang"))).alias("lang"))
    spoken = fit.join(langs, ["set_code", "lang"]).select("paper_id", "set_code", "number", "theirs", "lang")
    both = first.join(spoken, ["paper_id", "set_code", "number"], "left").withColumn("official", F.coalesce("core", "theirs"))
    return both.groupBy("paper_id").agg(F.count_if(F.col("official").isNotNull()).alias("checked"), F.count_if(F.col("official") != F.col("ours")).alias("mismatched"), F.count_if(F.col("official").isNull()).alias("unmatched"), F.max("lang").alias("lang"))


def fill_report(base: DataFrame, external: DataFrame, key: str, column: str, domain: DataFrame, least: int = 1) -> DataFrame:
    """set_code, filled, kept, rejected, refused: what filling gaps of each set does, and why a set is refused.

    base and external: set_code, key, column. External values go only to base rows of the same set (a set without external rows
    is refused as absent), fill only what is null, and count as rejected outside the domain; fewer than ``least`` good
    values of a set refuse it as partial. An external set that base lacks fills nothing."""
    own = external.filter(F.col(column).isNotNull())
    good = own.join(domain.select(column).distinct(), column, "left_semi").select("set_code", key, F.col(column).alias("_ext"))
    offered = own.groupBy("set_code").agg(F.count(F.lit(1)).alias("_all")).join(good.groupBy("set_code").agg(F.count(F.lit(1)).alias("_good")), "set_code", "left")
    both = base.join(good, ["set_code", key], "left")
    n = both.groupBy("set_code").agg(F.count_if(F.col(column).isNull() & F.col("_ext").isNotNull()).alias("fill"), F.count_if(F.col(column).isNotNull()).alias("kept"))
    out = n.join(offered, "set_code", "left").withColumns({"_all": F.coalesce("_all", F.lit(0)), "_good": F.coalesce("_good", F.lit(0))})
    refused = F.when(F.col("_all") == 0, "absent").when(F.col("_good") < least, "partial")
    return out.select("set_code", F.when(refused.isNull(), F.col("fill")).otherwise(F.lit(0)).cast("long").alias("filled"), "kept", (F.col("_all") - F.col("_good")).alias("rejected"), refused.alias("refused"))
