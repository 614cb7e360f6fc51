"""Shares and report parts, over documents, conversations, questions and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import quality, reports, windows
from quillspark.operators import text as op
from quillspark.plans import query
from quillspark.sources.folders import written
from quillspark.plans.text import _SHAPES

_SHARE = "round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY {0}), 6) AS share"


def _shape_sql() -> str:
    shapes = "[" + ",".join(f"'{x}'" for x in _SHAPES) + "]"
    flags = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in op.ARCHETYPES)
    return f""", s AS (SELECT lang AS subject, source AS sitting, {shapes}[CAST(doc_id % 6 + 1 AS BIGINT)] || text AS text FROM documents), a AS (SELECT subject, sitting, CASE {flags} ELSE 'none' END AS archetype FROM s), c AS (SELECT subject, sitting, archetype, count(*) AS n FROM a GROUP BY 1, 2, 3)
SELECT subject, sitting, archetype, n, {_SHARE.format("subject, sitting")} FROM c"""


@query("t16_archetype_shares", _shape_sql())
def t16_shares(t):
    """Share of each primary shape in each subject (language) and sitting (source)."""
    d = t.docs.select(F.col("lang").alias("subject"), F.col("source").alias("sitting"), F.concat(F.get(F.array(*map(F.lit, _SHAPES)), (F.col("doc_id") % 6).cast("int")), "text").alias("text"))
    return reports.shares(d.select("subject", "sitting", F.get(op.archetypes(F.col("text")), F.lit(0)).alias("archetype")), ["subject", "sitting"], "archetype")


def _register_sql() -> str:
    from quillspark.plans import ORACLE_SQL

    census = ORACLE_SQL["t11_register_census"]
    at = census.rindex("SELECT conv_id, turn, coalesce(want, plain) AS register")
    named = census[:at] + ", census AS (" + census[at:] + "), j AS (SELECT conv_id, coalesce(role, 'fixture') AS source, register FROM census LEFT JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn)), n AS (SELECT conv_id, source, register, count(*) AS n FROM j GROUP BY 1, 2, 3)"
    return named + f" SELECT conv_id, source, register, n, {_SHARE.format('conv_id, source')} FROM n"


@query("t11_register_shares", _register_sql(), prelude=False)
def t11_shares(t):
    """Share of each register in each conversation and source (role)."""
    from quillspark.plans.text import _MESSAGES

    own = t.raw("conversations").select("conv_id", "turn", "text", F.col("role").alias("source"))
    extra = t.spark.createDataFrame([(*m, "fixture") for m in _MESSAGES], "conv_id long, turn long, text string, source string")
    return reports.shares(op.register_census(own.union(extra)), ["conv_id", "source"], "register").select("conv_id", "source", "register", "n", "share")


@query("t20_output_rates", "SELECT event_type AS producer, count(*) AS outputs, count(*) FILTER (WHERE event_id % 4 = 3) AS failed, round(CAST(count(*) FILTER (WHERE event_id % 4 = 3) AS DOUBLE) / count(*), 6) AS rate FROM events GROUP BY 1", prelude=False)
def t20_rates(t):
    e, p = F.col("event_id"), F.col("props")
    raw = F.when(e % 4 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e % 4 == 1, F.concat(F.lit("Sure: "), p, F.lit(" done"))).when(e % 4 == 2, p).otherwise(F.concat(F.lit("{"), p))
    return reports.output_rates(op.parse_outputs(t.raw("events").select(F.col("event_type").alias("producer"), raw.alias("raw")), "raw", "k long"), "producer")


@query("q19_extraction_methods", ", m AS (SELECT CASE part_key % 3 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'OCR' END AS en, CASE WHEN part_key % 7 = 0 THEN 'EXACT' WHEN part_key % 7 < 4 THEN 'GLYPH' END AS hi FROM questions) SELECT 'en' AS lang, coalesce(en, 'none') AS method, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'hi', coalesce(hi, 'none'), count(*) FROM m GROUP BY 2")
def q19_methods(t):
    k = F.col("part_key")
    return reports.method_counts(t.questions.select(F.when(k % 3 == 0, "EXACT").when(k % 3 == 1, "OCR").alias("extraction_en"), F.when(k % 7 == 0, "EXACT").when(k % 7 < 4, "GLYPH").alias("extraction_hi")), ["en", "hi"])


def _verdict_sql() -> str:
    from quillspark.plans import ORACLE_SQL

    verdict = ORACLE_SQL["q3_review_verdict"]
    at = verdict.rindex("SELECT doc_id, CASE WHEN len(b) > 0")
    return (
        verdict[:at]
        + ", vd AS ("
        + verdict[at:]
        + """), w AS (SELECT coalesce(d.source, 'fixture') AS source, verdict, coalesce(d.lang = 'en', false) AS done FROM vd LEFT JOIN documents d USING (doc_id))
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) FILTER (WHERE verdict = 'PASS') AS pass, count(*) FILTER (WHERE verdict = 'JUDGE') AS judge, count(*) FILTER (WHERE verdict = 'BLOCK') AS block, count(*) FILTER (WHERE NOT done) AS untranslated, CAST(floor(count(*) FILTER (WHERE verdict = 'PASS') * 100e0 / count(*) + 0.5e0) AS BIGINT) AS pass_pct FROM w GROUP BY ROLLUP (source)"""
    )


@query("q19_verdict_counts", _verdict_sql(), prelude=False)
def q19_verdicts(t):
    """Verdicts of q3 by paper (source); English counts as translated."""
    from quillspark.plans.quality import q3

    own = t.docs.select("doc_id", "source", F.col("lang").alias("_lang"))
    rows = q3(t).join(own, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("fixture")))
    return reports.verdict_counts(rows, "source", F.col("_lang") == "en")


@query(
    "w11_newest_sessions",
    """WITH d AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '[ \\t\\r\\n]+', ' ', 'g')) AS t, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN length(t) > 42 THEN substr(t, 1, 42) || '…' ELSE t END AS title, turns, least(turns, 50) AS kept, last_turn FROM d ORDER BY last_turn DESC, conv_id DESC LIMIT 50""",
    prelude=False,
)
def w11_newest(t):
    return reports.newest_sessions(windows.session_digest(t.raw("conversations")), ["last_turn", "conv_id"])


#: Sections as three years spelled them, of two sets; a language's section has its own numbers.
_LABELS = [("CTET_P1", "PAPER-I-MAIN"), ("CTET_P1", "Paper-I (Main)"), ("CTET_P2_MATHSCI", "PAPER-II-Math & Science"), ("CTET_P2_MATHSCI", "PAPER-II (MAIN MATH)"), ("CTET_P2_SOCSCI", "PAPER-II-Social Science"), ("CTET_P2_SOCSCI", "PAPER-II (MAIN SOS)")]
_KEYS = (
    """, o AS (SELECT paper_id, ['CTET_P1', 'CTET_P2_MATHSCI', 'CTET_P2_SOCSCI'][CAST(paper_id % 3 + 1 AS BIGINT)] AS paper_type, CAST(paper_id AS VARCHAR) AS set_code, number, min(key_raw) AS ours FROM questions GROUP BY ALL),
labels(paper_type, pick, section) AS (VALUES """
    + ",".join(f"('{p}', {i % 2}, '{s}')" for i, (p, s) in enumerate(_LABELS))
    + """),
official AS (SELECT o.set_code, section, number, CASE WHEN (paper_id + number) % 20 = 0 THEN 'Z' ELSE ours END AS official FROM o JOIN labels l ON l.paper_type = o.paper_type AND pick = o.paper_id % 2 WHERE number <= 3
  UNION ALL SELECT set_code, CASE WHEN paper_type = 'CTET_P1' THEN 'PAPER-II (MAIN SOS)' ELSE 'PAPER-I (MAIN)' END, number, 'X' FROM o WHERE number <= 2
  UNION ALL SELECT set_code, 'PAPER-II 02-HINDI', number, ours FROM o WHERE number > 3 AND paper_id % 4 <> 0 UNION ALL SELECT set_code, 'PAPER-II-01-English', number, CASE WHEN number % 2 = 0 THEN 'X' ELSE ours END FROM o WHERE number > 3)"""
)


@query(
    "q17_verify_sections",
    _KEYS
    + """, core AS (SELECT o.paper_id, o.number, max(f.official) AS official FROM o JOIN official f ON f.set_code = o.set_code AND f.number = o.number AND NOT regexp_matches(upper(f.section), '[0-9]{2}[- ]+[A-Z]+') AND CASE o.paper_type WHEN 'CTET_P1' THEN regexp_matches(upper(f.section), '^PAPER-I[^I]') AND contains(upper(f.section), 'MAIN') WHEN 'CTET_P2_MATHSCI' THEN starts_with(upper(f.section), 'PAPER-II') AND contains(upper(f.section), 'MATH') ELSE starts_with(upper(f.section), 'PAPER-II') AND (contains(upper(f.section), 'SOCIAL') OR contains(upper(f.section), 'SOS')) END GROUP BY 1, 2),
j AS (SELECT o.*, core.official AS core FROM o LEFT JOIN core USING (paper_id, number) WHERE trim(ours) <> ''), lang AS (SELECT set_code, regexp_extract(upper(section), '[0-9]{2}[- ]+([A-Z]+)', 1) AS lang, number, official AS theirs FROM official WHERE regexp_matches(upper(section), '[0-9]{2}[- ]+[A-Z]+')),
g AS (SELECT paper_id, lang, count(*) FILTER (WHERE ours = theirs) AS same, count(*) AS n FROM j JOIN lang USING (set_code, number) WHERE core IS NULL GROUP BY 1, 2), best AS (SELECT paper_id, arg_min(lang, lpad(CAST(CAST(1000000 - same * 1000000 / n AS BIGINT) AS VARCHAR), 8, '0') || lang) AS lang FROM g WHERE same >= n * 0.95e0 GROUP BY 1),
e AS (SELECT j.paper_id, ours, coalesce(core, theirs) AS official, CASE WHEN theirs IS NOT NULL THEN b.lang END AS lang FROM j LEFT JOIN best b USING (paper_id) LEFT JOIN lang l ON l.set_code = j.set_code AND l.lang = b.lang AND l.number = j.number)
SELECT paper_id, count(official) AS checked, count(*) FILTER (WHERE official <> ours) AS mismatched, count(*) FILTER (WHERE official IS NULL) AS unmatched, max(lang) AS lang FROM e GROUP BY 1""",
)
def q17_sections(t):
    p, n = F.col("paper_id"), F.col("number")
    types = F.array(*map(F.lit, ("CTET_P1", "CTET_P2_MATHSCI", "CTET_P2_SOCSCI")))
    # Read five times from here on.
    ours = written(t.questions.groupBy("paper_id", "number").agg(F.min("key_raw").alias("ours")), "ours").select("paper_id", F.get(types, (p % 3).cast("int")).alias("paper_type"), p.cast("string").alias("set_code"), "number", "ours")
    labels = F.array(*[F.lit(s) for _, s in _LABELS])
    core = ours.filter("number <= 3").select("set_code", F.get(labels, ((p % 3) * 2 + p % 2).cast("int")).alias("section"), "number", F.when((p + n) % 20 == 0, "Z").otherwise(F.col("ours")).alias("official"))
    wrong = ours.filter("number <= 2").select("set_code", F.when(F.col("paper_type") == "CTET_P1", "PAPER-II (MAIN SOS)").otherwise("PAPER-I (MAIN)"), "number", F.lit("X"))
    hindi = ours.filter("number > 3 and paper_id % 4 != 0").select("set_code", F.lit("PAPER-II 02-HINDI"), "number", "ours")
    english = ours.filter("number > 3").select("set_code", F.lit("PAPER-II-01-English"), "number", F.when(n % 2 == 0, "X").otherwise(F.col("ours")))
    return reports.verify_sections(ours, core.union(wrong).union(hindi).union(english))


@query(
    "j10_fill_report",
    """, base AS (SELECT c_mktsegment AS set_code, c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer),
ext AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'AUTOMOBILE' ELSE 'OTHER' END AS set_code, s_suppkey * 3 AS id, CASE WHEN s_suppkey % 4 = 1 AND s_suppkey > 9 OR s_suppkey % 5 = 0 THEN 'x' || CAST(s_nationkey AS VARCHAR) ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier),
good AS (SELECT * FROM ext WHERE nation IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)), o AS (SELECT set_code, count(*) AS every_n, count(*) FILTER (WHERE nation IN (SELECT nation FROM good)) AS good_n FROM ext GROUP BY 1),
n AS (SELECT b.set_code, count(*) FILTER (WHERE b.nation IS NULL AND g.nation IS NOT NULL) AS fill, count(b.nation) AS kept FROM base b LEFT JOIN good g USING (set_code, id) GROUP BY 1),
r AS (SELECT n.*, coalesce(every_n, 0) AS every_n, coalesce(good_n, 0) AS good_n, CASE WHEN coalesce(every_n, 0) = 0 THEN 'absent' WHEN coalesce(good_n, 0) < 4 THEN 'partial' END AS refused FROM n LEFT JOIN o USING (set_code))
SELECT set_code, CASE WHEN refused IS NULL THEN fill ELSE 0 END AS filled, kept, every_n - good_n AS rejected, refused FROM r""",
)
def j10_report(t):
    base = t.raw("customer").select(F.col("c_mktsegment").alias("set_code"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string")).alias("nation"))
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    codes = F.when(s % 4 == 0, "BUILDING").when(s % 4 == 1, "MACHINERY").when(s % 4 == 2, "AUTOMOBILE").otherwise("OTHER")
    ext = t.raw("supplier").select(codes.alias("set_code"), (s * 3).alias("id"), F.when(((s % 4 == 1) & (s > 9)) | (s % 5 == 0), F.concat(F.lit("x"), n)).otherwise(n).alias("nation"))
    return reports.fill_report(base, ext, "id", "nation", t.raw("nation").select(F.col("n_nationkey").cast("string").alias("nation")), 4)
