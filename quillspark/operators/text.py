"""Text: chunks, search, repeats, tagging, registers, web pages, model outputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions import clean_page, norm_stem
from quillspark.llm.batches import pieces
from quillspark.sources.folders import written

#: Words too common to tell chunks apart, in three registers.
STOP = (
    "the a an and or of in on to is are was were be been for with as at by it its this that these those from but not what which who how why when where do does did can could should would "
    "me my you your i we us about please explain tell kya hai hain ka ki ke ko se mein aur par bhi ye yeh wo woh mujhe samjhao batao karo kaise kyu kyun chhe che ane pan shu su kem mane maru aa "
    "का की के है हैं में और से को यह वह क्या कैसे क्यों हो था थी છે અને માં થી ને આ તે શું કેમ હતું"
).split()
#: Marks of romanised Hindi.
HINGLISH = (
    "hai hain he tha thi the hoga hogi hota hoti kya kyu kyun kyon kaise kaisa kaisi kab kahan kaun kitna kitne kitni konsa kaunsa nahi nahin nai mat mujhe muje mera meri mere tum tumhe aap aapko hum hume humein "
    "aur lekin par phir abhi yeh ye woh wo vah batao bata samjhao samjha chahiye karo karna karta karti hona raha rahi rahe liye wala wali sakta sakte bohot bahut thoda acha accha theek thik kuch sab bhi toh to se "
    "ka ki ke ko me mein bhai yaar matlab samajh padhai sawal jawab prashn"
).split()
#: Marks of romanised Gujarati.
GUJLISH = (
    "chhe che chho chu chhu hatu hati hase thay thase shu su kem kya kyare kon ketlu ketla kevu kevi nathi nai mane maru mari mara tame tamne ame amne ane pan pachi ave aa ae tya ahi kaho samjavo joie karo karvu "
    "karta hovu rahyu badhu thodu saru barabar kai badha bhai matlab samaj abhyas prashna javab"
).split()
#: Marks that are common English words as well.
AMBIGUOUS = "to me he the par se aa ae pan kya".split()
#: Question words that carry no topic.
SCAFFOLD = (
    "what which who why how when where is are was were the a an of in on for and or please explain tell give describe define about some any do does did can could would should i you it this that these those with from into "
    "detail simple example answer question mean meaning arg args value values key keys assistant system user think thought tool tools function json output response query search terms keywords result results"
).split()
#: Runs of word characters in the scripts read here.
WORD_CLASS = "[a-z0-9À-ɏऀ-ॿ઀-૿]+"


def fixed(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def tokens(text: Column) -> Column:
    """Words of a text as search sees them: no single Latin characters, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD_CLASS), F.lit(0))
    return F.filter(found, lambda w: ~(w.rlike("^[a-z0-9]$")) & ~w.isin(STOP))


def postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tf: chunk, term, tf; df: term, df; lengths: chunk, length)."""
    each = chunks.select("chunk_id", tokens(F.col("text")).alias("ws"))
    # Words are left out as rows, which is compiled, unlike a function over an array.
    found = chunks.select("chunk_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_CLASS), F.lit(0))).alias("term"))
    tf = found.filter(~F.col("term").rlike("^[a-z0-9]$") & ~F.col("term").isin(STOP)).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), each.select("chunk_id", F.size("ws").cast("long").alias("length"))


def _strip(c: Column) -> Column:
    """Without blanks and line ends on either side."""
    return F.regexp_replace(c, r"^[ \t\n]+|[ \t\n]+$", "")


def _passages(target: int, overlap: int, least: int):
    """The fold of sorted paragraphs: what is held is the passage that is being filled, whatever a document's length."""

    def fold(batches):
        doc, number, held, size, since, chapter, last = None, 0, "", 0, 0, None, None
        begun = False

        def closed(page):
            nonlocal held, size, since, number
            body = held.strip(" \t\n")
            if len(body) < least:
                held, size = "", 0
                return
            yield doc, number, since, page, chapter, body
            held, since, number = body[-overlap:], page, number + 1
            size = len(held)

        for b in batches:
            out = []
            for d, page, text, head in zip(b["doc_id"], b["page"], b["p"], b["head"], strict=True):
                if not begun or d != doc:
                    if begun and size:
                        out += closed(last)
                    doc, number, held, size, since, chapter, begun = d, 0, "", 0, 0, None, True
                if head and size:
                    out += closed(page)
                if head:
                    chapter, since = head, page
                if size and size + len(text) > target:
                    out += closed(page)
                held, size, last = held + ("\n" if held else "") + text, size + len(text), page
            yield pd.DataFrame(out, columns=["doc_id", "seq", "page_from", "page_to", "chapter", "content"])
        if begun and size:
            yield pd.DataFrame(list(closed(last)), columns=["doc_id", "seq", "page_from", "page_to", "chapter", "content"])

    return fold


def chunk_corpus(pages: DataFrame, target: int = 1400, overlap: int = 200, least: int = 200) -> DataFrame:
    """doc_id, seq, page_from, page_to, chapter, content: passages of whole paragraphs, each opening with the end of the one before.

    pages: doc_id, page, text. A chapter heading closes a passage; bodies under ``least`` characters are dropped with their
    carried end. Paragraphs are rows, read in order; a document is never one row, however many pages it has. Pages of no
    document stay out."""
    cleaned = pages.filter("doc_id is not null").withColumn("text", clean_page(F.col("text"))).filter("text != ''")
    chapter = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?m)^[ \t]*((?:CHAPTER|Chapter)[ \t]+[0-9]{1,2}(?![A-Za-z0-9])[^\n]{0,80})", 1), r"[ \t]+", " "))
    paras = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: _strip(p)), lambda p: p != "")
    rows = cleaned.select("doc_id", F.col("page").cast("int").alias("page"), F.posexplode(F.transform(paras, lambda p, i: F.struct(p.alias("p"), F.when(i == 0, chapter).otherwise("").alias("head")))))
    ordered = rows.select("doc_id", "page", "pos", "col.p", "col.head").repartition("doc_id").sortWithinPartitions("doc_id", "page", "pos")
    kind = pages.schema["doc_id"].dataType.simpleString()
    return ordered.mapInPandas(_passages(target, overlap, least), f"doc_id {kind}, seq int, page_from int, page_to int, chapter string, content string")


def chunk_pages(pages: DataFrame, target: int = 1200, least: int = 40) -> DataFrame:
    """doc_id, page, seq, content: passages that never leave a page; long paragraphs are cut at ends of sentences."""
    paras = F.filter(F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: _strip(p)), lambda p: p != "")
    sentences = lambda p: F.regexp_extract_all(p, F.lit(r"[^.!?।॥]+[.!?।॥]*[ \t\n]*"), F.lit(0))
    hard = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.char_length(s) - 1) / target).cast("int"))), lambda i: F.substring(s, i * target + 1, F.lit(target)))
    units = F.flatten(F.transform(paras, lambda p: F.when(F.char_length(p) > target * 1.5, F.flatten(F.transform(sentences(p), hard))).otherwise(F.array(F.concat(p, F.lit("\n"))))))
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, u: Column) -> Column:
        full = (F.char_length(a["buf"]) + F.char_length(u) > target) & (a["buf"] != "")
        return F.when(full, F.struct(u.alias("buf"), F.concat(a["out"], F.array(_strip(a["buf"]))).alias("out"))).otherwise(F.struct(F.concat(a["buf"], u).alias("buf"), a["out"].alias("out")))

    folded = pages.withColumn("_f", F.aggregate(units, start, step))
    every = F.filter(F.concat("_f.out", F.array(_strip(F.col("_f.buf")))), lambda c: F.char_length(c) >= least)
    return folded.select("doc_id", "page", F.posexplode(every).alias("seq", "content"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


#: Stems and characters of a block, at most (or one longer stem); blocks of lengths that can meet are compared, one pair at a time.
STEM_BLOCK, BLOCK_BYTES = 1000, 1 << 16
#: Characters of stems in a part of the blocks, about.
PART_BYTES = 1 << 24
_LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"


def common_lengths(b: str, stems: list[str], bits: list[dict[str, bytes]]) -> list[int]:
    """Length of the longest common subsequence of b with each stem, all in one run over b: a lane of bits for each stem.

    bits: for each stem, where each of its characters stands; a lane ends with a spare byte that takes the carry."""
    wide = [len(x) // 8 + 1 for x in stems]
    lanes = int.from_bytes(b"".join(((1 << len(x)) - 1).to_bytes(n, "little") for x, n in zip(stems, wide, strict=True)), "little")
    blank = [bytes(n) for n in wide]
    masks = {c: int.from_bytes(b"".join([m.get(c, z) for m, z in zip(bits, blank, strict=True)]), "little") for c in set(b)}
    v = lanes
    for c in b:
        u = v & masks[c]
        v = ((v + u) | (v ^ u)) & lanes
    raw, at, out = v.to_bytes(sum(wide), "little"), 0, []
    for x, n in zip(stems, wide, strict=True):
        out.append(len(x) - int.from_bytes(raw[at : at + n], "little").bit_count())
        at += n
    return out


def _packed(stems: int, size: int):
    """Rows of up to so many stems and bytes of neighbouring lengths: least, most, stems and the sitting of each that has one alone."""

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            for cut in pieces((b.slice(at, stems) for at in range(0, len(b), stems)), size, "norm"):
                n = cut.column("n").to_pylist()
                cells = [[min(n)], [max(n)], [cut.column("norm").to_pylist()], [cut.column("alone").to_pylist()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], names=["least", "most", "stems", "alone"])

    return packed


def _alike(threshold: float):
    def alike(same: bool, xs: list[str], x_alone: list, ys: list[str], y_alone: list) -> list[tuple[str, str]]:
        import numpy as np

        counts = lambda zs: np.array([[z.count(c) for c in _LETTERS] for z in zs], np.int32)
        hx, hy = counts(xs), counts(ys)
        nx, ny = hx.sum(1), hy.sum(1)
        bits = []
        for x in xs:
            m = {}
            for c in set(x):
                m[c] = int(x[::-1].translate({ord(k): "1" if k == c else "0" for k in set(x)}), 2).to_bytes(len(x) // 8 + 1, "little")
            bits.append(m)
        out = []
        for y, alone, h, n in zip(ys, y_alone, hy, ny, strict=True):
            near = np.flatnonzero(2 * np.minimum(hx, h).sum(1) >= threshold * (nx + n) - 1e-9).tolist()
            near = [i for i in near if (alone is None or x_alone[i] != alone) and (not same or xs[i] < y)]
            # A ratio counts characters of a common subsequence, so the longest bounds it.
            for at in range(0, len(near), 200):
                part = near[at : at + 200]
                for i, common in zip(part, common_lengths(y, [xs[i] for i in part], [bits[i] for i in part]), strict=True):
                    if 2 * common >= threshold * (nx[i] + n) - 1e-9:
                        out.append((min(xs[i], y), max(xs[i], y)))
        return out

    return F.udf(alike, "array<struct<a string, b string>>", useArrow=False)


def repeat_candidates(rows: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Every pair of distinct stems whose difflib ratio can reach the threshold: (a, b), a < b. rows: norm, and lo and hi (first and
    last sitting) where pairs of stems that both are of one sitting alone do not count.

    Lengths, counts of characters and the longest common subsequence each bound the ratio from above, so no pair is lost.
    Stems are dealt by length and stored once, in rows of STEM_BLOCK; rows of lengths that can meet are paired as they are read, so
    disk grows with the stems, not with their pairs, and a task holds a part of the rows.
    No index of pieces or q-grams can do better at such thresholds. With T characters in both stems at most 0.18 T stay unmatched,
    so there are up to 0.18 T + 1 matching blocks, of 2.3 characters on average: pieces that must survive have two or three
    characters, and only 0.05 T - 2 common runs of three are certain, of about T / 2. Of 57,951 pairs of given stems of fitting lengths
    72 in a hundred have as many. The work grows with the square of the stems of a band of lengths."""
    alone = F.lit(None).cast("string")
    if {"lo", "hi"} <= set(rows.columns):
        sitting = F.concat(F.lit("="), F.col("lo").cast("string"))
        alone = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.coalesce(sitting, F.lit("")))
    sized = rows.select("norm", F.char_length("norm").alias("n"), alone.alias("alone"))
    parts = -(-(sized.agg(F.sum("n")).first()[0] or 1) // PART_BYTES)
    ordered = sized.repartitionByRange(parts, "n", F.xxhash64("norm")).sortWithinPartitions("n")
    packed = ordered.mapInArrow(_packed(STEM_BLOCK, BLOCK_BYTES), "least int, most int, stems array<string>, alone array<string>")
    blocks = written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    left = blocks.select(*[F.col(c).alias(f"l_{c}") for c in blocks.columns]).repartition(max(parts, 4 * cores), "l_block")
    least = threshold / (2 - threshold) - 1e-9
    # Each pair of blocks once; by turns the later and the earlier of the two is left, so that all have as many partners.
    once = F.when((F.col("l_block") + F.col("block")) % 2 == 0, F.col("l_block") <= F.col("block")).otherwise(F.col("l_block") > F.col("block"))
    meet = left.crossJoin(blocks).filter(once & (F.col("most") >= F.col("l_least") * least) & (F.col("l_most") >= F.col("least") * least))
    found = meet.select(_alike(threshold)(F.col("l_block") == F.col("block"), "l_stems", "l_alone", "stems", "alone").alias("pairs"))
    return found.select(F.inline("pairs"))


def repeats(questions: DataFrame, threshold: float = 0.82, least: int = 40) -> DataFrame:
    """Stems asked again in other sittings: anchor, sittings, questions, and topic (of the anchor's first question) if questions have one.

    questions: question_id, sitting, stem, topic. Two stems are linked if they are alike and not both of one sitting alone: that is a
    reshuffled set, no repeat. Each stem goes to its smallest anchor among those linked that is not itself a member of another."""
    rows = questions.withColumn("norm", norm_stem(F.col("stem"))).filter(F.char_length("norm") >= least)
    distinct = written(rows.groupBy("norm").agg(F.min("sitting").alias("lo"), F.max("sitting").alias("hi")), "stems")
    pairs = written(repeat_candidates(distinct, threshold).withColumn("ratio", _ratio("a", "b")).filter(F.col("ratio") >= threshold), "pairs")
    of = lambda x: distinct.select(F.col("norm").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"))
    same = F.col("lo_a").eqNullSafe(F.col("hi_a")) & F.col("lo_b").eqNullSafe(F.col("hi_b")) & F.col("lo_a").eqNullSafe(F.col("lo_b"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").filter(~same)
    members = pairs.select(F.col("b").alias("x")).distinct()
    anchored = pairs.join(members, pairs["a"] == members["x"], "left_anti").groupBy("b").agg(F.min("a").alias("anchor"))
    grouped = rows.join(anchored, rows["norm"] == anchored["b"], "left").withColumn("anchor", F.coalesce("anchor", "norm"))
    topic = [F.min_by("topic", F.when(F.col("norm") == F.col("anchor"), F.col("question_id"))).alias("topic")] if "topic" in questions.columns else []
    return grouped.groupBy("anchor").agg(F.count_distinct("sitting").alias("sittings"), F.count(F.lit(1)).alias("questions"), *topic).filter("sittings > 1")


#: What a stem about the teaching act says, and what makes it content all the same.
PEDAGOGY = r"(?i)(^|[^a-z])(teacher|teaching|taught|classroom|class room|pupils?|learners?|students? (should|can|are|were|will|may)|assess|assessment|evaluat|which (question|activity|method|strategy|approach)|lesson|pedagog|curriculum|textbook should|project method|group work|higher.order|critical thinking|rubric|portfolio|formative|summative)([^a-z]|$)"
STRONG = r"(?i)(^|[^a-z0-9])(1[0-9]{3}|harappa|mohenjo|ashoka|akbar|mughal|gandhi|ambedkar|phule|periyar|sepoy|mangal pandey|chola|gupta|maurya|sultanate|plassey|buxar|diwani|latitude|longitude|equator|monsoon)([^a-z0-9]|$)"


def tag_topics(rows: DataFrame, taxonomy: list[tuple[str, str, list[str]]], least: int = 2, margin: int = 1) -> DataFrame:
    """question_id, topic_id (null for a refusal), reason. rows: question_id, stem, text (stem and options). taxonomy: (id, strand, aliases), configuration.

    An alias counts 3 if it has a blank or nine characters, else 1. Stems about teaching go to pedagogy topics unless a
    strong content word stands in them."""
    hay = F.lower(F.regexp_replace("text", r"[ \t\r\n\f]+", " "))
    tight = F.replace(hay, F.lit(" "), F.lit(""))
    base = rows.withColumns({"_hay": hay, "_tight": tight, "_ped": F.col("stem").rlike(PEDAGOGY) & ~F.col("stem").rlike(STRONG)})
    hit = lambda a: F.when(F.contains(F.col("_hay"), F.lit(a)) | (F.contains(F.col("_tight"), F.lit(a.replace(" ", ""))) if " " in a else F.lit(False)), 3 if " " in a or len(a) >= 9 else 1).otherwise(0)
    scores = [F.struct(sum((hit(a) for a in aliases), F.lit(0)).alias("score"), F.lit(i).alias("id"), F.lit(strand).alias("strand")) for i, strand, aliases in taxonomy]
    base = base.withColumn("_all", F.filter(F.array(*scores), lambda x: x["score"] > 0))
    base = base.withColumn("_s", F.when(F.col("_ped"), F.filter("_all", lambda x: x["strand"] == "Pedagogy")).otherwise(F.col("_all")))
    ranked = F.array_sort("_s", lambda a, b: F.when(a["score"] != b["score"], (b["score"] - a["score"]).cast("int")).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    base = base.withColumn("_r", ranked)
    best, runner = F.get("_r", F.lit(0))["score"], F.coalesce(F.get("_r", F.lit(1))["score"], F.lit(0))
    reason = (
        F.when(F.trim("_hay") == "", "empty question")
        .when(F.col("_ped") & (F.size("_s") == 0), "pedagogy question without a pedagogy alias")
        .when(F.size("_s") == 0, "no alias")
        .when(best < least, F.concat(F.lit("weak: "), best.cast("string")))
        .when(best - runner < margin, F.concat(F.lit("ambiguous: "), best.cast("string")))
        .otherwise(F.concat(F.lit("score "), best.cast("string"), F.lit(" to "), runner.cast("string")))
    )
    good = (F.size("_s") > 0) & (best >= least) & (best - runner >= margin)
    return base.select("question_id", F.when(good, F.get("_r", F.lit(0))["id"]).alias("topic_id"), reason.alias("reason"))


def register_census(messages: DataFrame, medium: str | None = None) -> DataFrame:
    """lang, register and confidence of each message (column text); a bare English default yields to a study medium.

    A language asked for by name outranks what the message is written in."""
    raw = F.trim(F.coalesce("text", F.lit("")))
    deva, gujr, latn = (F.regexp_count(raw, F.lit(c)) for c in ("[ऀ-ॿ]", "[઀-૿]", "[A-Za-z]"))
    base = messages.withColumns({"_d": deva, "_g": gujr, "_l": latn, "_raw": raw, "_w": F.regexp_extract_all(F.lower(raw), F.lit("[a-z]+"), F.lit(0))})
    count = lambda xs: F.size(F.filter("_w", lambda w: w.isin(xs)))
    strong = lambda xs: count([x for x in xs if x not in AMBIGUOUS])
    every = lambda xs: F.when(strong(xs) > 0, count(xs)).otherwise(0)
    base = base.withColumns({"_hi": every(HINGLISH), "_gu": every(GUJLISH), "_n": F.size("_w")})
    d, g, n = F.col("_d"), F.col("_g"), F.col("_n")
    total, hits = d + g + F.col("_l"), F.greatest("_hi", "_gu")
    indic, lang = F.greatest(d, g), F.when(d >= g, "hi").otherwise("gu")
    share, density = indic / F.greatest(total, F.lit(1)), hits / F.greatest(n, F.lit(1))
    asked = F.lower(F.regexp_extract("_raw", r"(?i)(?:^|[^a-z])(?:in|on|into)[ ]+(hindi|gujarati|english)(?:[^a-z]|$)", 1))
    wanted = F.when(asked == "hindi", "hi").when(asked == "gujarati", "gu").when(asked == "english", "en")
    few = (hits < 2) & (density < 0.25)
    gu_wins = F.col("_gu") > F.col("_hi")
    native = (d > 0) | (g > 0)
    plain = F.when(total == 0, "en").when(native & (share >= 0.55), lang).when(native, F.when(lang == "hi", "hinglish").otherwise("gujlish")).when((hits == 0) | few, "en").when(gu_wins, "gujlish").otherwise("hinglish")
    under = F.when(total == 0, "en").when(native, lang).when((hits == 0) | few, "en").when(gu_wins, "gu").otherwise("hi")
    sure = F.when(total == 0, 0.0).when(native & (share >= 0.55), F.least(F.lit(1.0), share + 0.2)).when(native, 0.7).when(hits == 0, 0.9).when(few, 0.6).otherwise(F.least(F.lit(1.0), 0.5 + density))
    base = base.withColumns({"_plain": plain, "_under": under, "_asked": wanted, "_sure": sure})
    default = F.lit(medium).cast("string") if medium else F.lit(None).cast("string")
    out = F.coalesce("_asked", F.when((F.col("_plain") == "en") & (F.col("_sure") < 0.95), default), "_plain")
    return base.withColumns({"register": out, "lang": F.when(F.col("_asked").isNotNull() | (F.col("_plain") == "en"), out).otherwise(F.col("_under")), "confidence": F.round(F.when(F.col("_asked").isNotNull(), 1.0).otherwise(F.col("_sure")), 6)}).drop(*[f"_{c}" for c in ("d", "g", "l", "raw", "w", "hi", "gu", "n", "plain", "under", "asked", "sure")])


def content_terms(text: Column) -> Column:
    """Content words of a message: no function words, no scaffolding, over two characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'-]*"), F.lit(0))
    drop = sorted(set(HINGLISH) | set(GUJLISH) | set(SCAFFOLD))
    return F.filter(found, lambda w: ~w.isin(drop) & (F.char_length(w) > 2))


def followup_terms(turns: DataFrame) -> DataFrame:
    """Terms of each user turn; with four or fewer, those of the user turn before are added."""
    mine = turns.filter("role = 'user'").withColumn("own", content_terms(F.col("text")))
    before = F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn"))
    short = (F.size("own") > 0) & (F.size("own") <= 4)
    return mine.withColumn("before", before).select("conv_id", "turn", F.when(short & (F.size("before") > 0), F.array_distinct(F.concat("own", "before"))).otherwise(F.col("own")).alias("terms"))


def script_profile(docs: DataFrame) -> DataFrame:
    """For each document and script: runs and characters, and its dominant script (any Indic one wins). Neutral characters join the run before them."""
    pattern = "[A-Za-zÀ-ɏ][^ऀ-ॿ઀-૿]*|[ऀ-ॿ][^A-Za-zÀ-ɏ઀-૿]*|[઀-૿][^A-Za-zÀ-ɏऀ-ॿ]*"
    runs = docs.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    script = F.when(F.col("run").rlike("^[ऀ-ॿ]"), "devanagari").when(F.col("run").rlike("^[઀-૿]"), "gujarati").otherwise("latin")
    each = runs.groupBy("doc_id", "source", script.alias("script")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.char_length("run")).alias("chars"))
    w = Window.partitionBy("doc_id")
    indic = F.max(F.when(F.col("script") != "latin", F.struct("chars", "script"))).over(w)
    return each.withColumn("dominant", F.coalesce(indic["script"], F.lit("latin")))


#: Shapes of question, the most specific first.
ARCHETYPES = [
    ("assertionReason", r"(?i)assertion[ \t\n]*\(?[ \t\n]*a[ \t\n]*\)?|reason[ \t\n]*\(?[ \t\n]*r[ \t\n]*\)?"),
    ("match", r"(?i)match the|column[ \t\n]*[-–]?[ \t\n]*i|correctly matched"),
    ("statements", r"(?i)statement[ \t\n]*[-–]?[ \t\n]*(i|1|ii|2)([^a-z0-9_]|$)|following statements|consider the following"),
    ("negative", r"(?i)(^|[^a-z0-9_])not([^a-z0-9_.?][^.?]{0,39})(correct|true|appropriate)|which([^.?]{0,24}[^a-z0-9_.?])not([^a-z0-9_]|$)|except([^a-z0-9_]|$)|incorrect"),
    ("pedagogyScenario", r"(?i)teacher|classroom|class room|students? (are|is|were|should)|pedagog|assessment|evaluation"),
]


def archetypes(text: Column) -> Column:
    """Names of the shapes a question has, the primary first."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in ARCHETYPES]))


BLOCKS = ("script", "style", "noscript", "svg", "nav", "footer", "header")


def html_text(html: Column) -> tuple[Column, Column]:
    """(title, text) of a page: blocks that are not prose dropped, line ends kept, tags and entities resolved, lines over two characters."""
    blank = r"[ \t\r\f\u000b]+"
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.when(html.rlike(r"(?is)<title[^>]*>(.*?)</title>"), F.substring(F.trim(F.regexp_replace(F.regexp_replace(found, "<[^>]+>", ""), blank, " ")), 1, 200)).otherwise("Web page")
    body = html
    for tag in BLOCKS:
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:[ \t\r\n/][^>]*)?>.*?</{tag}>", " ")
    body = F.regexp_replace(body, r"(?i)<br[ ]*/?>|</p>|</div>|</li>|</h[1-6]>", "\n")
    body = F.regexp_replace(body, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        body = F.replace(body, F.lit(a), F.lit(b))
    lines = F.transform(F.split(F.regexp_replace(body, blank, " "), "\n"), lambda x: F.trim(x))
    return title, F.trim(F.array_join(F.filter(lines, lambda x: F.char_length(x) > 2), "\n"))


def dedupe_docs(docs: DataFrame) -> DataFrame:
    """doc_id, sha256, first_id: the first document of the same text; copies have a smaller first_id."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    return hashed.join(hashed.groupBy("sha256").agg(F.min("doc_id").alias("first_id")), "sha256").select("doc_id", "sha256", "first_id")


def parse_outputs(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A model's answer as fields: code fence off, else from the first { to the last }, else not parsed; never repaired."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"^```[a-z]*[ ]*\n?", ""), r"\n?```$", ""))
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    good = lambda c: F.try_parse_json(c).isNotNull()
    chosen = F.when(good(bare) & bare.startswith("{"), bare).when((cut != "") & good(cut), cut)
    return rows.withColumn("_json", chosen).withColumn("parsed", F.from_json("_json", schema)).withColumn("ok", F.col("_json").isNotNull()).drop("_json")


def headings(pages: DataFrame) -> DataFrame:
    """Numbered headings whose leading number is the chapter's: first of each number, in order. pages: doc_id, chapter, text."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*([0-9]{1,2}\.[0-9]{1,2}[ \t]+[^\n]{3,80})$"), F.lit(1))
    each = pages.select("doc_id", "chapter", F.posexplode(found).alias("at", "line"))
    parts = each.withColumns({"number": F.regexp_extract("line", r"^([0-9]+\.[0-9]+)", 1), "title": F.trim(F.regexp_replace("line", r"^[0-9]+\.[0-9]+[ \t]+", ""))})
    own = parts.filter(F.regexp_extract("line", r"^([0-9]+)\.", 1).cast("int") == F.col("chapter"))
    w = Window.partitionBy("doc_id", "number").orderBy("at")
    first = own.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    order = Window.partitionBy("doc_id").orderBy("at")
    return first.withColumn("place", F.row_number().over(order).cast("long")).select("doc_id", "number", "title", "place")


def guess_mistake(outcomes: DataFrame) -> DataFrame:
    """Guess from the time against the attempt's upper median: much faster is a misreading, anything else conceptual."""
    from quillspark.operators.statistics import latency

    median = latency(outcomes, "attempt_id", "time_ms").select("attempt_id", "median")
    fast = (F.col("time_ms") > 0) & (F.col("time_ms") < F.col("median") * 0.4)
    return outcomes.join(median, "attempt_id").withColumn("guess", F.when(fast, "misread").otherwise("conceptual"))
