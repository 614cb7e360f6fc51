"""Keyed windows: newest, resumable, islands, resets, trends, sessions, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import half_up
from quillspark.sources.folders import written


def one_per_sitting(papers: DataFrame) -> DataFrame:
    """Of each (user, type, date): the paper of most keyed questions, ties by id; the others are marked dropped."""
    order = Window.partitionBy("user_id", "paper_type", "month").orderBy(F.col("keyed").desc(), "paper_id")
    return papers.withColumn("kept", F.row_number().over(order) == 1)


def newest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def resumable(attempts: DataFrame) -> DataFrame:
    return newest(attempts.filter("submitted_ms is null"), ["user_id", "paper_type"], "started_ms", "attempt_id")


def resume_index(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """First unanswered place (from 0) of each attempt, else 0."""
    rows = questions.join(responses, ["attempt_id", "question_no"], "left")
    return rows.groupBy("attempt_id").agg(F.coalesce(F.min(F.when(F.col("chosen").isNull(), F.col("place"))), F.lit(0)).cast("long").alias("resume_at"))


def pieced(rows: DataFrame, key: str, order: list[str], pieces: int | None = None) -> DataFrame:
    """rows as a table with _piece: ranges of (key, order), so that a key of very many rows is several pieces in a row."""
    keys = [key, *order]
    dealt = rows.repartitionByRange(pieces, *keys) if pieces else rows.repartitionByRange(*keys)
    return written(dealt.withColumn("_piece", F.spark_partition_id()), "pieced")


def _met(rows: DataFrame, borders: DataFrame, key: str) -> DataFrame:
    """rows with what is known of their piece. borders: key, _piece and others."""
    other = borders.withColumnsRenamed({key: "_key", "_piece": "_at"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at"))).drop("_key", "_at")


def islands(rows: DataFrame, key: str, order: list[str], value: str, pieces: int | None = None) -> DataFrame:
    """Contiguous runs of one value: value, first and last place (from 0).

    Runs are found in each piece of a key; a run at a piece's start goes on from the pieces before if they end with its value.
    Only a piece's first and last value and its counts meet in one window."""
    held = pieced(rows.select(key, *[c for c in order if c != value], value), key, order, pieces)
    by = Window.partitionBy(key, "_piece").orderBy(*order)
    placed = held.select(key, "_piece", value, (F.row_number().over(by) - 1).cast("long").alias("at"), F.when(F.lag(F.struct(value)).over(by).eqNullSafe(F.struct(value)), 0).otherwise(1).alias("new"))
    numbered_ = placed.withColumn("run", F.sum("new").over(Window.partitionBy(key, "_piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(numbered_.groupBy(key, "_piece", "run").agg(F.first(F.struct(value)).alias("v"), F.min("at").alias("first"), F.max("at").alias("last")), "runs")
    ends = runs.groupBy(key, "_piece").agg((F.max("last") + 1).alias("n"), F.min_by("v", "run").alias("opens"), F.max_by("v", "run").alias("closes"), F.max("run").alias("runs"), F.max("first").alias("last_start"))
    across = Window.partitionBy(key).orderBy("_piece")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    known = ends.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "joined": F.lag("closes").over(across).eqNullSafe(F.col("opens"))})
    # Where the run that a piece ends with began, unless the piece is all of one run from before.
    began = F.when(~((F.col("runs") == 1) & F.col("joined")), F.col("base") + F.col("last_start"))
    known = known.withColumn("since", F.last(began, ignorenulls=True).over(before)).select(key, "_piece", "base", "joined", "since")
    whole = _met(runs, known, key).withColumn("first_at", F.when((F.col("run") == 1) & F.col("joined"), F.col("since")).otherwise(F.col("base") + F.col("first")))
    return whole.groupBy(key, "first_at").agg(F.first(f"v.{value}").alias(value), F.max(F.col("base") + F.col("last")).alias("last_at")).select(key, value, "first_at", "last_at")


def split_on_reset(rows: DataFrame, key: str, order: list[str], number: str, pieces: int | None = None) -> DataFrame:
    """Numbered rows cut into papers where the number does not advance; the first reading of a number wins.

    Cuts are counted in each piece of a key and added up over pieces; a piece's first number is compared with the last of the piece before."""
    held = pieced(rows, key, order, pieces)
    by = Window.partitionBy(key, "_piece").orderBy(*order)
    cut = held.withColumn("_n", F.row_number().over(by)).withColumn("_new", F.when(F.col(number) <= F.lag(number).over(by), 1).otherwise(0))
    cut = cut.withColumn("_cuts", F.sum("_new").over(Window.partitionBy(key, "_piece").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    ends = held.groupBy(key, "_piece").agg(F.min_by(F.struct(number), F.struct(*order)).alias("opens"), F.max_by(F.struct(number), F.struct(*order)).alias("closes"))
    ends = _met(ends, cut.groupBy(key, "_piece").agg(F.max("_cuts").alias("cuts")), key)
    across = Window.partitionBy(key).orderBy("_piece")
    border = F.when(F.col(f"opens.{number}") <= F.lag(f"closes.{number}").over(across), 1).otherwise(0)
    known = ends.withColumn("border", border).withColumn("base", F.sum("border").over(across) + F.coalesce(F.sum("cuts").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(key, "_piece", "base")
    run = _met(cut, known, key).withColumn("paper_no", (F.col("_cuts") + F.col("base") + 1).cast("long"))
    first = Window.partitionBy(key, "paper_no", number).orderBy("_piece", "_n")
    return run.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_n", "_new", "_first", "_piece", "_cuts", "base")


def trend(attempts: DataFrame, last: int = 6) -> DataFrame:
    """A user's latest submitted attempts, oldest first, with percent, and the best so far among all."""
    done = attempts.filter("submitted_ms is not null and max_score > 0").withColumn("pct", half_up(F.col("score") * 100 / F.col("max_score")))
    w = Window.partitionBy("user_id")
    placed = done.withColumn("back", F.row_number().over(w.orderBy(F.col("submitted_ms").desc(), F.col("attempt_id").desc())).cast("long")).withColumn("best", F.max("pct").over(w))
    return placed.filter(F.col("back") <= last)


def dedupe_stems(rows: DataFrame, fingerprint, order: list[str]) -> DataFrame:
    """The first row of each fingerprint; rows with an empty one all stay.

    A grouped minimum, so a stem that very many rows share is reduced before rows are shuffled."""
    held = rows.withColumn("_fp", fingerprint)
    first = held.filter("_fp != ''").groupBy("_fp").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return first.unionByName(held.filter("_fp = ''").drop("_fp"))


def latest_per_set(attempts: DataFrame) -> DataFrame:
    """The newest attempt of each user and set."""
    return attempts.groupBy("user_id", "paper_no").agg(F.max_by("attempt_id", F.struct("started_ms", "attempt_id")).alias("attempt_id"), F.count(F.lit(1)).alias("times"))


def session_digest(turns: DataFrame, keep: int = 50) -> DataFrame:
    """Of each session: title from the first user line, number of turns, place of the oldest turn kept."""
    title = F.trim(F.regexp_replace(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), r"[ \t\r\n]+", " "))
    out = turns.groupBy("conv_id").agg(title.alias("t"), F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"))
    return out.select("conv_id", F.when(F.char_length("t") > 42, F.concat(F.substring("t", 1, 42), F.lit("…"))).otherwise(F.col("t")).alias("title"), "turns", F.least("turns", F.lit(keep)).cast("long").alias("kept"), "last_turn")


def budget_fill(items: DataFrame, key: str, budget: str) -> DataFrame:
    """Items (key, place, id, cost) in order of place while the budget lasts: what overflows is skipped, the first is always taken.

    A key's items are read in order and never held together, however many there are."""
    import pandas as pd

    def fold(batches):
        now, spent, ids = None, 0.0, []
        for b in batches:
            out = []
            for k, left, name, cost in zip(b["k"], b["left"], b["id"], b["cost"], strict=True):
                if k != now:
                    if ids:
                        out.append((now, ",".join(ids), spent))
                    now, spent, ids = k, 0.0, []
                if not ids or spent + cost <= left:
                    spent += cost
                    ids.append(name)
            yield pd.DataFrame(out, columns=["k", "taken", "spent"])
        if ids:
            yield pd.DataFrame([(now, ",".join(ids), spent)], columns=["k", "taken", "spent"])

    rows = items.select(F.col(key).alias("k"), "place", F.col("id").cast("string").alias("id"), F.col("cost").cast("double").alias("cost"), F.col(budget).cast("double").alias("left")).filter("k is not null")
    sorted_ = rows.repartition("k").sortWithinPartitions("k", "place", "id")
    return sorted_.mapInPandas(fold, f"k {items.schema[key].dataType.simpleString()}, taken string, spent double").withColumnRenamed("k", key)


def budget_fill_few(items: DataFrame, key: str, budget: str) -> DataFrame:
    """The same for keys of a few items each (a day's plan): a key is one row, folded without Python. A key has one budget."""
    own = F.struct("place", F.col("id").cast("string").alias("id"), F.col("cost").cast("double").alias("cost"))
    by = items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(own)).alias("xs"), F.max(F.col(budget).cast("double")).alias("left"))
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<string>").alias("ids"))

    def step(acc, x):
        fits = (F.size(acc["ids"]) == 0) | (acc["spent"] + x["cost"] <= F.col("left"))
        return F.when(fits, F.struct((acc["spent"] + x["cost"]).alias("spent"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc)

    return by.withColumn("_f", F.aggregate("xs", start, step)).select(key, F.array_join("_f.ids", ",").alias("taken"), F.col("_f.spent").alias("spent"))
