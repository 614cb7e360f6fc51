"""Secret scans: fixed patterns, and strings that a character Markov model finds likelier to be random than ordinary.

Two first-order character chains are trained on labelled samples. Strings labelled random: the values that the
fixed patterns find, and the base64 and hexadecimal digests of the sampled rows' ids. Strings labelled ordinary: the
words of the sampled documents of five or more letters that no pattern covers, their tokens of an identifier's shape, and
identifiers (camel case, capitals, snake case, paths, with digits) of those words and of VOCABULARY. A token is reported
when the log-likelihood ratio, summed over its transitions, is high enough in total and per transition: not under the given
limits, and not under the limit for a transition that errs least on a fifth of the labelled strings, held out of training.

The training sample is the documents of the ``sample_docs`` smallest hashed ids (a documented bound; repeated rows count
once); the scan covers every document and its whole text. Everything is DataFrame expressions. A null text counts as empty: no spans. Repeated
rows are scanned each on its own, null ids are ids like others; an empty table gives an empty result; other columns of the input
are not looked at. Places of matches are sums in blocks, so the work for a text grows about with its length and matches.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

KINDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: The group whose length counts, the least length, and a cheap pattern that every kept match meets.
LEAST = {"assign": (2, 8, KINDS["assign"]), "access": (0, 16, r"AKIA[A-Z0-9]{12}"), "hex": (0, 32, r"[0-9a-f]{32}")}
TOKEN = r"[A-Za-z0-9+/_=-]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Words that identifiers are made of, beside the documents' own.
VOCABULARY = (
    "access account action address agent alert amount answer array attribute author average batch before binary block body boolean bottom bound branch broker buffer build button bytes cache "
    "callback catalog category channel character check child circle class clean client clock cluster code collection color column command comment commit config connect constant container "
    "content context control convert copy count country create credit cursor customer daily data date debug decimal default delete delivery depth description device dialog digest directory "
    "disable discount display document domain double download draft driver dynamic editor element empty enable encode engine entry error event example exchange execute export factory failure "
    "feature field file filter final find first flag float folder format forward frame function gateway generate global graph group handler hash header height helper hidden history host http "
    "identifier image import index info init input insert instance integer interface internal invalid invoice item iterator job join json key kernel label language last layer layout length level "
    "library limit line link list listener load local location lock logger long lookup machine manager map mark match matrix max member memory menu merge message method metric middle min mode "
    "model module monitor month move multiple name native network next node notify null number object offset open option order output owner package page panel parent parse partition patch path "
    "pattern payment pending percent period permission phone pixel plugin point policy pool port position post prefix previous price primary print priority process product profile project "
    "property protocol provider proxy publish query queue quick random range rate raw reader record redirect reference refresh region register release remote remove render replace report "
    "request reset resource response result retry return right role rollback root route row rule runtime sample save schedule schema scope screen script search second section select sender "
    "sequence server service session setting shadow shape shard share shift signal simple single size skip snapshot socket sort source stage start state static status step storage store stream "
    "string style subject submit success suffix summary support switch symbol sync system table target task template temporary test text theme thread threshold time timeout timestamp title "
    "total trace track transaction transfer transform tree trigger type unique unit update upload user utility valid value vector version video view visible volume wait warning watch weight "
    "widget width window worker wrapper write xml year zone"
).split()
SHAPES = r"[a-z]+(?:[A-Z][a-z]+)+|(?:[A-Z][a-z]+){2,}|[A-Z]{5,}|[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+(?:-[a-z]+)+|[A-Za-z]*(?:/[A-Za-z_-]+)+"
SPAN = "array<struct<start:int,end:int,kind:int,text:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(numbers: Column, join) -> Column:
    """For each of some whole numbers, all before it joined to one (0: none). In blocks of about the root of their count, so long arrays cost little more than short ones."""
    numbers_type, kept = "array<int>", "struct<at:int,out:array<int>>"
    start = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast(numbers_type).alias("out")).cast(kept)
    step = lambda acc, x: F.struct(join(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(kept)
    run = lambda xs, at: F.aggregate(xs, start(at), step, lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1)), lambda i: i * width < F.size(xs))
        return F.transform(at, lambda i: F.slice(xs, i * width + 1, width))

    whole = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: join(acc, x).cast("int"))
    return _let(numbers, lambda xs: _let(blocks(xs), lambda bs: F.flatten(F.zip_with(bs, run(F.transform(bs, whole), F.lit(0)), run))))


def _starts(pieces: Column, found: Column) -> Column:
    """From the pieces between matches and the matches themselves: where each match starts and ends."""
    pairs = F.filter(F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("p"), F.char_length(m).alias("m"), m.alias("text"))), lambda x: x["m"].isNotNull())
    placed = lambda x, at: F.struct((at + x["p"]).alias("start"), (at + x["p"] + x["m"]).alias("end"), x["text"].alias("text"))
    return _let(pairs, lambda ps: F.zip_with(ps, _before(F.transform(ps, lambda x: x["p"] + x["m"]), lambda a, b: a + b), placed))


def _spans(text: Column, kind: str) -> Column:
    """Kept matches of one kind. A run of one class is as long as it can be, so runs under the least length never split others."""
    group, least, sure = LEAST[kind]
    pattern = KINDS[kind]
    if kind == "hex":
        pattern = f"[0-9a-f]{{{least},}}"
    number = list(KINDS).index(kind)
    found = _starts(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kept = F.filter(F.arrays_zip(found.alias("f"), sizes.alias("g")), lambda x: F.char_length(x["g"]) >= least)
    out = F.transform(kept, lambda x: F.struct(x["f"]["start"].alias("start"), x["f"]["end"].alias("end"), F.lit(number).alias("kind"), x["f"]["text"].alias("text")))
    return F.when(F.coalesce(text.rlike(sure), F.lit(False)), out.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _codes(token: Column) -> Column:
    """Each character's place in the alphabet, from 1; 0 for any other."""
    return F.transform(F.filter(F.split(token, "", -1), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _transitions(tokens: DataFrame, token: str) -> DataFrame:
    codes = tokens.select(_codes(F.col(token)).alias("codes"))
    pairs = codes.select(F.explode(F.zip_with(F.slice(F.col("codes"), 1, F.greatest(F.size("codes") - 1, F.lit(0))), F.slice(F.col("codes"), 2, F.greatest(F.size("codes"), F.lit(1))), lambda a, b: a * SIZE + b)).alias("pair"))
    return pairs.groupBy("pair").count()


def _identifiers(words: Column) -> Column:
    """Identifiers of three words in lower case, in each usual style."""
    a, b, c = (F.get(words, F.lit(i)) for i in range(3))
    number = F.pmod(F.xxhash64(a, b, c), F.lit(2000)).cast("string")
    join = lambda sep: F.concat_ws(sep, a, b, c)
    return F.array(
        F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c)), F.upper(join("")), F.upper(join("_")), join("_"), join("-"), F.concat(F.lit("/"), join("/")), join("/"),
        F.concat(a, F.initcap(b), number, F.initcap(c)), F.concat(F.upper(F.concat_ws("_", a, b)), F.lit("_"), number), F.concat(a, F.lit("/"), b, F.lit("-"), number, F.lit("/"), c),
    )


def labelled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = 1000) -> DataFrame:
    """Labelled strings of the sample: token, random (1 or 0), held (a fifth by hash, kept out of training)."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("at", F.xxhash64("id"))
    # The bound is found on hashes alone, so no task gathers texts.
    bound = rows.select("at").distinct().orderBy("at").limit(sample_docs).agg(F.max("at").alias("at")).first()["at"]
    sample = rows.filter(F.col("at") <= F.lit(bound)).dropDuplicates(["id", "text"]).select("id", "text")
    base = F.concat(*[_spans(F.col("text"), k) for k in KINDS])
    sample = sample.withColumn("spans", base)
    found = sample.select(F.explode(F.transform("spans", lambda s: F.regexp_extract(s["text"], r"[A-Za-z0-9+/_=-]+$", 0))).alias("token"))
    digest = F.sha2(F.coalesce(F.col("id"), F.lit("")), 256)
    made = sample.select(F.explode(F.array(F.base64(F.unhex(digest)), F.regexp_replace(F.base64(F.unhex(F.sha1(F.concat(F.lit("x"), F.coalesce("id", F.lit("")))))), "=", ""), F.substring(digest, 1, 40))).alias("token"))
    clean = sample.filter(F.size("spans") == 0)
    whole = lambda p: F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z0-9+/_=-])(?:{p})(?![A-Za-z0-9+/_=-])"), F.lit(0))
    words = clean.select(whole(r"[A-Za-z][a-z]{4,}").alias("words"), whole(SHAPES).alias("shaped"))
    plain = words.select(F.explode(F.concat("words", "shaped")).alias("token"))
    pick = random.Random(1)
    fixed = docs.sparkSession.createDataFrame([(pick.sample(VOCABULARY, 3),) for _ in range(2000)], "three array<string>")
    threes = F.transform(F.filter(F.sequence(F.lit(1), F.size("words"), F.lit(3)), lambda i: i + 2 <= F.size("words")), lambda i: F.transform(F.slice("words", i, F.lit(3)), F.lower))
    named = words.filter(F.size("words") >= 3).select(F.explode(threes).alias("three")).union(fixed).select(F.explode(_identifiers(F.col("three"))).alias("token"))
    both = found.union(made).withColumn("random", F.lit(1)).union(plain.union(named).withColumn("random", F.lit(0)))
    return both.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(5)) == 0)


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character transition, random against ordinary: SIZE * SIZE numbers, whatever the input's size."""
    kept = strings.filter("not held")
    rows = _transitions(kept.filter("random = 1"), "token").withColumn("random", F.lit(1)).union(_transitions(kept.filter("random = 0"), "token").withColumn("random", F.lit(0))).collect()
    counts = [[0.0] * (SIZE * SIZE), [0.0] * (SIZE * SIZE)]
    for r in rows:
        counts[r["random"]][r["pair"]] = float(r["count"])
    out = [0.0] * (SIZE * SIZE)
    for a in range(SIZE):
        sums = [sum(c[a * SIZE : (a + 1) * SIZE]) for c in counts]
        for b in range(SIZE):
            p = [(counts[k][a * SIZE + b] + 0.5) / (sums[k] + 0.5 * SIZE) for k in (0, 1)]
            out[a * SIZE + b] = math.log(p[1] / p[0])
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Summed log-likelihood ratio of a token's transitions, in nats."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = _codes(token)
    pairs = F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))), lambda a, b: a * SIZE + b)
    return F.aggregate(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0.0), lambda acc, p: acc + F.get(table, p))


def limit(strings: DataFrame, model: list[float], least: int) -> float:
    """The ratio for a transition, in twentieths, at which the shares of held-out strings of each class that err sum to least; the higher of equals."""
    long = strings.filter(F.col("held") & (F.char_length("token") >= least))
    step = F.floor(ratio(F.col("token"), model) / (F.char_length("token") - 1) * 20).cast("int")
    bins = [(r["step"], r["random"], r["count"]) for r in long.groupBy(step.alias("step"), "random").count().collect()]
    sums = [max(1, sum(n for _, k, n in bins if k == kind)) for kind in (0, 1)]
    wrong = lambda cut: sum(n / sums[kind] for at, kind, n in bins if (at >= cut) == (kind == 0))
    if len({kind for _, kind, _ in bins}) < 2:
        return -math.inf
    return max(range(min(bins)[0], max(bins)[0] + 1), key=lambda cut: (-wrong(cut), cut)) / 20


def _apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others: of the others that start before a span's end, none ends after its start."""
    event = lambda s, at, last, order: F.struct(at.alias("at"), F.lit(order).alias("order"), last.alias("last"), s.alias("span"))
    zero = F.lit(0)
    events = F.array_sort(F.concat(F.transform(spans, lambda s: event(s, s["end"], zero, 0)), F.transform(others, lambda s: event(s, s["start"], s["end"], 1))))

    def kept(es: Column) -> Column:
        reach = _before(F.transform(es, lambda e: e["last"]), lambda a, b: F.greatest(a, b))
        pairs = F.zip_with(es, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r")))
        return F.transform(F.filter(pairs, lambda p: (p["e"]["order"] == 0) & (p["r"] <= p["e"]["span"]["start"])), lambda p: p["e"]["span"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(_let(events, kept))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 20, nats: float = 12.0, per_step: float = 0.4, sample_docs: int = 1000) -> DataFrame:
    """docs with the column ``secret_spans``: array of (start, end, kind number, text), by start and kind; code points, end exclusive.

    Kind numbers follow KINDS, then 3 for strings the model finds (``least`` characters or more, none overlapping a base span)."""
    strings = stored(labelled(docs, text, doc_id, sample_docs), "labelled")
    model = train(strings)
    per_step = max(per_step, limit(strings, model, least))
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumn("_base", F.concat(*[_spans(whole, k) for k in KINDS]))
    pattern = TOKEN[:-1] + f"{{{least},}}"
    found = _starts(F.split(whole, pattern, -1), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)))
    likely = F.filter(found, lambda t: (lambda r: (r >= nats) & (r >= per_step * (F.char_length(t["text"]) - 1)))(ratio(t["text"], model)))
    shaped = F.transform(likely, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(3).alias("kind"), t["text"].alias("text"))).cast(SPAN)
    tokens = F.when(F.coalesce(whole.rlike(pattern), F.lit(False)), shaped).otherwise(F.array().cast(SPAN))
    both = base.withColumn("_model", tokens)
    free = _apart(F.col("_model"), F.col("_base"))
    return both.withColumn("secret_spans", F.array_sort(F.concat("_base", free), lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1).when((a["start"] == b["start"]) & (a["kind"] == b["kind"]), 0).otherwise(1))).drop("_base", "_model")


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a block of text, from which pieces are cut without counting from the text's start.
WIDTH = 2048


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each span replaced; spans that overlap are replaced together."""

    def cut(blocks: Column, at: Column, size: Column) -> Column:
        first = F.floor(at / WIDTH).cast("int")
        held = F.slice(blocks, first + 1, F.floor((at + size) / WIDTH).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), at - first * WIDTH + 1, size)

    def masked(blocks: Column) -> Column:
        kept = lambda s, at: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"] - at), F.lit(mask))).otherwise("")
        ends = F.transform(spans, lambda s: s["end"])
        last = F.coalesce(F.array_max(ends), F.lit(0))
        pieces = F.zip_with(spans, _before(ends, lambda a, b: F.greatest(a, b)), kept)
        return F.concat(F.array_join(pieces, ""), cut(blocks, last, F.char_length(text) - last))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0)), masked)


def digest_columns(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col(doc_id).alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(described(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        described(spans).alias("spans"),
        count(3).alias("n_markov"),
    )
