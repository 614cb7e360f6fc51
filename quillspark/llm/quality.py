"""Quality rules: fixed ones, and thresholds whose false rejections are bounded on labelled holdouts.

Each measure (symbols, repeated lines, repeated words, length of words) has a fixed grid of cutoffs; a rule is a cutoff or
none for each measure, and rejects what is over any of them. In each stratum (language) k of the n labelled good documents would
be rejected by a rule. A rule is safe when the exact (Clopper-Pearson) upper bound on its rate of false rejections is at
most ``risk``: when a binomial of n trials at ``risk`` gives k or fewer with probability ``level`` / number of tests (Bonferroni over
strata and rules). So the bound holds for the whole rule, whichever is chosen: the safe one that catches most labelled bad
documents, if at a higher rate than good ones may be rejected; of equals the one that rejects fewest good ones, then the one
of higher cutoffs. Without enough labels nothing is rejected beyond the fixed rules.

All in DataFrame expressions; texts are measured once. Null texts have no words and fail the fixed rules; rows with a null
language form a stratum of their own. An id repeated in ``labels`` counts once, as bad if any of its labels is; rows that
share an id count once in each stratum, at their highest measures. Null ids have no labels. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import BLANK, stored

SYMBOLS = "#*$%&|<>"
#: Per mille of word characters, of lines, of words, of words; hundredths of characters a word.
GRIDS = {
    "symbols": [20, 50, 100, 150, 200, 300],
    "dup_lines": [50, 100, 200, 300, 500],
    "repeats": [20, 50, 100, 150, 200, 250],
    "long_words": [800, 1000, 1200, 1500, 2000],
}
WINDOW = 8


def _measured(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumn("_t", whole).withColumn("_words", F.filter(F.split("_t", BLANK, -1), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.regexp_replace("_t", BLANK, "")).cast("long"),
            "n_symbols": (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_t", "_words")
    # Windows of 2, 4 and 8 words, each from two of half its length.
    three = two.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    for half in (1, 2, 4):
        tail = F.slice("_hash", half + 1, F.greatest(F.size("_hash"), F.lit(1)))
        head = F.slice("_hash", 1, F.greatest(F.size("_hash") - half, F.lit(0)))
        three = three.withColumn("_hash", F.zip_with(head, tail, lambda a, b: F.xxhash64(a, b)))
    four = three.withColumn("_twice", F.size(F.array_distinct("_hash")) < F.size("_hash"))
    placed = F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = four.withColumn("_placed", F.when(F.col("_twice"), placed)).drop("_hash")
    n = F.size("_placed")
    same = F.zip_with(F.slice("_placed", 1, F.greatest(n - 1, F.lit(0))), F.slice("_placed", 2, F.greatest(n, F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    five = four.withColumn("_at", F.when(F.col("_twice"), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))).drop("_placed")
    steps = F.zip_with(F.col("_at"), F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return five.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")).drop("_at", "_twice")


def measures() -> dict[str, Column]:
    """Each measure, a whole number, from the columns of measured()."""
    per = lambda a, b, k: F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"symbols": per("n_symbols", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000), "long_words": per("word_chars", "n_words", 100)}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed; inputs of those names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = _measured(docs.drop(*[c for c in names if c in docs.columns and c != text]), text)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k by Stirling's series, exact to 1e-9 from small numbers on."""

    def log_gamma(x: Column) -> Column:  # ln x!, shifted by 8 so that the series holds for 0 as well
        z = x + 9.0
        series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (z * 12) - 1 / (z * z * z * 360) + 1 / (z * z * z * z * z * 1260)
        return series - sum((F.ln(x + float(i)) for i in range(1, 9)), F.lit(0.0))

    return log_gamma(n) - log_gamma(k) - log_gamma(n - k)


def tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) of a binomial of n trials at risk: terms from k downwards until they no longer count, the rest bounded from above.

    From the mean on it is a half or more, too much for any level, and given as 1."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_choose(n, k) + k * math.log(risk) + (n - k) * math.log1p(-risk))
    odds = (1 - risk) / risk
    steps = F.sequence(F.lit(0), F.least(k, F.floor(F.sqrt(n) * 12) + 30).cast("int"))
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("sum"), k.alias("j"))
    add = lambda acc, _: F.struct((acc["term"] * acc["j"] / (n - acc["j"] + 1) * odds).alias("term"), (acc["sum"] + acc["term"]).alias("sum"), (acc["j"] - 1).alias("j"))
    return F.when(k > n * risk, F.lit(1.0)).otherwise(F.aggregate(steps, zero, add, lambda acc: F.least(F.lit(1.0), acc["sum"] + F.when(acc["j"] >= 0, acc["term"] * F.greatest(F.lit(1.0), acc["j"])).otherwise(0.0))))


def stratum_of(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c.cast("string")))


def levels() -> dict[str, Column]:
    """How many of its cutoffs each measure exceeds."""
    return {m: sum(((F.col(m) > c).cast("int") for c in cs), F.lit(0)) for m, cs in GRIDS.items()}


def rules(rated: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """(stratum, a cutoff or null for each measure): the safe rule of each stratum that has one. rated: stratum, good boolean and each measure's level, a row for each labelled document.

    Tables have a row for each stratum and rule at most, however many documents are labelled."""
    names = list(GRIDS)
    cells = rated.groupBy("stratum", *names).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    every = cells.select("stratum").distinct()
    for m, cs in GRIDS.items():
        every = every.withColumn(m, F.explode(F.sequence(F.lit(0), F.lit(len(cs)))))
    zero = F.lit(0).cast("long")
    below = every.select("stratum", *names, zero.alias("good"), zero.alias("bad")).union(cells.select("stratum", *names, "good", "bad")).groupBy("stratum", *names).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    for m in names:  # documents at or under a rule's cutoffs: sums along one measure after the other
        run = Window.partitionBy("stratum", *[x for x in names if x != m]).orderBy(m).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        below = below.select("stratum", *names, F.sum("good").over(run).alias("good"), F.sum("bad").over(run).alias("bad"))
    all_ = cells.groupBy("stratum").agg(F.sum("good").alias("n"), F.sum("bad").alias("all_bad"))
    counted = below.join(all_, "stratum").withColumns({"k": F.col("n") - F.col("good"), "caught": F.col("all_bad") - F.col("bad")})
    tests = all_.agg((F.count(F.lit(1)) * math.prod(len(cs) + 1 for cs in GRIDS.values())).alias("tests"))
    safe = counted.join(F.broadcast(tests)).filter("n > 0").filter((F.col("caught") > F.col("all_bad") * risk) & (tail(F.col("n"), F.col("k"), risk) * F.col("tests") <= level))
    best = Window.partitionBy("stratum").orderBy(F.col("caught").desc(), "k", *[F.col(m).desc() for m in names])
    chosen = safe.withColumn("_at", F.row_number().over(best)).filter("_at = 1")
    return chosen.select("stratum", *[F.get(F.array(*[F.lit(c).cast("long") for c in GRIDS[m]]), F.col(m)).alias(m) for m in names])


def judge_measured(rated: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """rated, as measured() makes it, with kept: false for what the fixed rules or its stratum's safe rule rejects."""
    names = measures()
    table = stored(rated, "measured")
    label = labels.groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("good")).filter("_id is not null and good is not null")
    small = table.select(F.col(doc_id).alias("_key"), stratum_of(F.col(stratum)).alias("stratum"), *[c.alias(m) for m, c in names.items()])
    known = small.join(label, F.col("_key") == F.col("_id")).select("_key", "stratum", "good", *[c.alias(m) for m, c in levels().items()])
    once = known.groupBy("_key", "stratum").agg(F.first("good").alias("good"), *[F.max(m).alias(m) for m in names])
    limits = stored(rules(once, risk, level).select(F.col("stratum").alias("_s"), *[F.col(m).alias(f"_max_{m}") for m in names]), "rules")
    over = F.lit(False)
    for m, c in names.items():
        over = over | F.coalesce(c > F.col(f"_max_{m}"), F.lit(False))
    # A stratum needs hundreds of labels to have a rule; many strata meet by shuffle.
    limits = F.broadcast(limits) if limits.count() <= 10_000 else limits
    out = table.withColumn("_stratum", stratum_of(F.col(stratum))).join(limits, F.col("_stratum") == F.col("_s"), "left")
    # One expression over both sides: a filter on it stays above the join.
    return out.drop("kept").withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~over)).drop("_stratum", "_s", *[f"_max_{m}" for m in names])


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """measured(docs) with kept, as judge_measured() tells."""
    return judge_measured(measured(docs, text), labels, doc_id, stratum, risk, level)
