"""Validation over the canonical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import quality as op
from quillspark.operators.quality import PASSAGE_REF
from quillspark.plans import query

_FACTS = """, facts AS (SELECT question_id, count(*) AS n_options, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE trim(text) = ''), '') AS empty, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE regexp_matches(trim(text), '^\\([0-9]\\)$')), '') AS marker,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE is_correct), '') AS rights, count(DISTINCT lower(trim(text))) AS n_texts FROM options GROUP BY 1),
full_q AS (SELECT q.*, coalesce(n_options, 0) AS n_options, coalesce(empty, '') AS empty, coalesce(marker, '') AS marker, coalesce(rights, '') AS rights, coalesce(n_texts, 0) AS n_texts, accepted, array_to_string(string_split(accepted, ''), ',') AS expected FROM questions q LEFT JOIN facts USING (question_id) LEFT JOIN legend USING (key_raw))"""

_PROBLEMS = """, problems AS (SELECT question_id, list_filter([CASE WHEN n_options <> 4 THEN CAST(n_options AS VARCHAR) || ' options, 4 expected' END, CASE WHEN empty <> '' THEN 'empty option: ' || empty END, CASE WHEN marker <> '' THEN 'marker only: ' || marker END,
  CASE WHEN rights = '' THEN 'none marked correct' END, CASE WHEN rights <> '' AND rights <> expected THEN 'marked ' || rights || ', official ' || expected END, CASE WHEN rights = '' THEN 'official key names missing option: ' || expected END, CASE WHEN trim(stem) = '' THEN 'empty stem' END], lambda x: x IS NOT NULL) AS p FROM full_q)"""


@query("q1_blocking_problems", _FACTS + _PROBLEMS + " SELECT question_id, array_to_string(p, '; ') AS problems FROM problems")
def q1(t):
    return op.blocking_problems(t.questions, t.options).select("question_id", F.array_join("problems", "; ").alias("problems"))


@query("q2_confidence", _FACTS + " SELECT question_id, greatest(0e0, round(1e0 - (n_warnings * 0.25e0 + CASE WHEN n_options <> 4 THEN 0.3e0 ELSE 0e0 END + CASE WHEN rights = '' THEN 0.3e0 ELSE 0e0 END + CASE WHEN stem = '' THEN 0.3e0 ELSE 0e0 END + CASE WHEN length(accepted) > 1 THEN 0.05e0 ELSE 0e0 END), 3)) AS confidence FROM full_q")
def q2(t):
    return op.confidence(t.questions, t.options)


#: Texts with the characters that the given tables lack.
FIXTURE = [
    (-1, "बाल विकास क्या है ?"),
    (-2, "कििताब ाबत क््ष"),
    (-3, "text � with damage and  marks, read the passage"),
    (-4, "હિંદી અને ગુજરાતી ૧૨૩ and 1,234 and 007"),
    (-5, "लgood"),
]
_FIX_SQL = ", fixture(doc_id, text) AS (VALUES " + ",".join(f"({i}, '{x}')" for i, x in FIXTURE) + "), stems AS (SELECT doc_id, text, lang FROM documents UNION ALL SELECT doc_id, text, CAST(NULL AS VARCHAR) FROM fixture)"


def _stems(t):
    return t.raw("documents").select("doc_id", "text", "lang").union(t.spark.createDataFrame(FIXTURE, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string")))


@query(
    "q3_review_verdict",
    _FIX_SQL
    + """, v AS (SELECT doc_id, length(trim(text)) AS n, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 4 END AS n_options, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS n_right, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS n_empty, text, lang, doc_id % 3 AS w FROM stems WHERE doc_id >= -5),
r AS (SELECT doc_id, list_filter([CASE WHEN n = 0 THEN 'empty stem' WHEN n < 15 THEN 'stem too short: ' || CAST(n AS VARCHAR) END, CASE WHEN n_options <> 4 THEN CAST(n_options AS VARCHAR) || ' options, 4 expected' END, CASE WHEN n_right = 0 THEN 'no key joined' END, CASE WHEN n_empty > 0 THEN 'an option is empty' WHEN n_options <> 4 THEN 'duplicate option text' END], lambda x: x IS NOT NULL) AS b,
  list_filter([CASE WHEN n > 2000 THEN 'stem long: ' || CAST(n AS VARCHAR) END, CASE WHEN regexp_matches(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}]') THEN 'replacement or private-use characters' END, CASE WHEN lang IS NULL THEN 'no subject' END, CASE WHEN w > 0 THEN CAST(w AS VARCHAR) || ' warnings' END, CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])(passage|extract|poem|following (text|lines))([^a-z]|$)') THEN 'passage missing' END], lambda x: x IS NOT NULL) AS j FROM v)
SELECT doc_id, CASE WHEN len(b) > 0 THEN 'BLOCK' WHEN len(j) > 0 THEN 'JUDGE' ELSE 'PASS' END AS verdict, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE j END, '; ') AS reasons FROM r""",
)
def q3(t):
    d = F.col("doc_id")
    n = F.when(d % 5 == 0, 3).otherwise(4)
    what, why = op.verdict(F.col("text"), n, F.when(d % 11 == 0, 0).otherwise(1), F.when(d % 13 == 0, 1).otherwise(0), F.lit(4), F.col("lang"), d % 3, F.lit(False), F.lit(""))
    return _stems(t).select("doc_id", what.alias("verdict"), F.array_join(why, "; ").alias("reasons"))


@query(
    "q4_dup_stems",
    """, s AS (SELECT doc_id % 50 AS paper_id, doc_id AS pos, text, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^(which (one )?of the following|read the following|consider the following)', ''), '[^a-z0-9 ]', '', 'g')) AS norm FROM documents),
f AS (SELECT *, CASE WHEN length(norm) > 30 THEN first_value(paper_id) OVER (PARTITION BY norm ORDER BY paper_id, pos) END AS head FROM s)
SELECT pos AS doc_id, CASE WHEN head < paper_id THEN head END AS same_as, CASE WHEN head < paper_id AND pos % 2 = 0 THEN 'JUDGE' WHEN pos % 2 = 0 THEN 'PASS' ELSE 'BLOCK' END AS verdict FROM f""",
)
def q4(t):
    d = F.col("doc_id")
    rows = t.docs.select((d % 50).alias("paper_id"), d.alias("pos"), F.col("text").alias("stem"), F.when(d % 2 == 0, "PASS").otherwise("BLOCK").alias("verdict"))
    return op.dup_stems(rows).select(F.col("pos").alias("doc_id"), "same_as", "verdict")


@query("q5_unsound_papers", ", d AS (SELECT paper_id, number FROM questions GROUP BY 1, 2 HAVING count(*) > 1) SELECT paper_id, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM d GROUP BY 1")
def q5(t):
    return op.unsound_papers(t.questions).select("paper_id", F.array_join("numbers", ",").alias("numbers"))


@query("q6_drop_ambiguous", "SELECT question_id FROM questions WHERE part_key % 37 <> 0")
def q6(t):
    bad = t.questions.filter("part_key % 37 = 0").select("question_id")
    options = t.options.union(t.options.join(bad, "question_id", "left_semi"))
    return op.drop_ambiguous(t.questions, options)[0].select("question_id")


@query(
    "q7_completeness",
    _FACTS
    + """, c AS (SELECT paper_id, count(*) AS parsed, count(*) FILTER (WHERE n_options = 4) AS four_option, count(*) FILTER (WHERE n_warnings = 0) AS clean, count(*) FILTER (WHERE n_warnings > 0) AS flagged, count(*) - count(DISTINCT number) AS repeated, list(DISTINCT number) AS have FROM full_q GROUP BY 1)
SELECT paper_id, parsed, four_option, clean, flagged, repeated, 7 AS expected, array_to_string(list_sort(list_filter([1,2,3,4,5,6,7], lambda x: NOT list_contains(have, x))), ',') AS missing FROM c""",
)
def q7(t):
    return op.completeness(t.questions, t.options, 7).withColumn("missing", F.array_join("missing", ","))


@query(
    "q8_gaps",
    """, n AS (SELECT l_orderkey, l_linenumber AS number, count(*) AS c FROM lineitem GROUP BY 1, 2), h AS (SELECT l_orderkey, list(number) AS have, max(number) AS most, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (WHERE c > 1), '') AS twice FROM n GROUP BY 1)
SELECT l_orderkey, twice, array_to_string(list_filter(range(1, most + 1), lambda x: NOT list_contains(have, x)), ',') AS missing FROM h""",
)
def q8(t):
    return op.gaps(t.raw("lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", F.array_join("twice", ",").alias("twice"), F.array_join("missing", ",").alias("missing"))


@query("q9_needs_image", _FACTS + " SELECT question_id FROM full_q WHERE n_options <> 4 OR empty <> '' OR marker <> ''")
def q9(t):
    return op.needs_image(t.questions, t.options).select("question_id")


@query(
    "q10_extractability",
    _FIX_SQL
    + """, p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM stems), a AS (SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, avg(CASE WHEN length(text) >= 120 THEN 1e0 ELSE 0e0 END) AS usable, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]'))) AS BIGINT) AS latin, CAST(sum(len(regexp_extract_all(text, '[\\x{0900}-\\x{097F}]'))) AS BIGINT) AS devanagari FROM p GROUP BY 1)
SELECT doc_id, pages, chars, usable, latin, devanagari, round(CAST(latin AS DOUBLE) / greatest(chars, 1), 6) AS latin_share, CASE WHEN CAST(chars AS DOUBLE) / pages < 200 THEN 'under 200 characters a page' WHEN usable < 0.35 THEN 'few usable pages' WHEN devanagari = 0 THEN 'expected script absent' END AS reason FROM a""",
)
def q10(t):
    pages = _stems(t).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return op.extractability(pages, "devanagari")


@query(
    "q11_readable",
    _FIX_SQL
    + """, c AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}\\x{0900}-\\x{097F}\\x{0A80}-\\x{0AFF}]')) AS letters, len(regexp_extract_all(text, '[A-Za-z0-9\\x{00C0}-\\x{024F}\\x{0900}-\\x{097F}\\x{0A80}-\\x{0AFF} \\n\\t.,;:!?()''"%/-]')) AS plain FROM stems)
SELECT doc_id, letters >= 40 AND plain > n * 0.85e0 AND letters > n * 0.55e0 AS readable FROM c""",
)
def q11(t):
    return _stems(t).select("doc_id", op.readable(F.col("text")).alias("readable"))


@query("q12_domain_check", ", d AS (SELECT paper_id, paper_type, CASE WHEN paper_type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'unknown' WHEN paper_type <> CASE paper_id % 2 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END THEN 'misfiled' END AS problem FROM papers) SELECT * FROM d WHERE problem IS NOT NULL")
def q12(t):
    expected = F.when(F.col("paper_id") % 2 == 0, "1-URGENT").otherwise("2-HIGH")
    return op.domain_check(t.papers, "paper_type", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], expected).select("paper_id", "paper_type", "problem")


@query(
    "q13_corruption",
    _FIX_SQL
    + """ SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, chr(65533)) THEN 'replacement' END, CASE WHEN regexp_matches(text, '[\\x{E000}-\\x{F8FF}]') THEN 'private-use' END, CASE WHEN regexp_matches(text, '[\\x{01}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]') THEN 'control' END,
  CASE WHEN regexp_matches(text, '(^|[^\\x{0904}-\\x{0939}\\x{0958}-\\x{0961}\\x{093C}])[\\x{093E}-\\x{094C}]') THEN 'orphan vowel sign' END, CASE WHEN regexp_matches(text, '[\\x{093E}-\\x{094C}][\\x{093E}-\\x{094C}]') THEN 'stacked vowel sign' END, CASE WHEN regexp_matches(text, '\\x{094D}\\x{094D}') THEN 'doubled virama' END,
  CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}][A-Za-z]') THEN 'residual latin' END], lambda x: x IS NOT NULL), ',') AS problems FROM stems""",
)
def q13(t):
    return _stems(t).select("doc_id", F.array_join(op.corruption(F.col("text")), ",").alias("problems"))


@query("q14_char_census", ", c AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '[^a-zA-Z0-9 \\n.,]')) AS ch FROM documents) SELECT source, ch, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY 1, 2")
def q14(t):
    return op.char_census(t.docs, "[a-zA-Z0-9 \n.,]")


@query(
    "q15_missing_passage",
    f""", s AS (SELECT item_id AS id, 'In the passage above, ' || text AS stem, CASE WHEN item_id % 4 = 0 THEN text ELSE '' END AS passage FROM benchmark UNION ALL SELECT doc_id + 100000, text, NULL FROM documents)
SELECT id, CASE WHEN trim(coalesce(passage, '')) = '' AND length(trim(stem)) < 400 AND regexp_extract(stem, '{PASSAGE_REF}', 1) <> '' THEN lower(regexp_extract(stem, '{PASSAGE_REF}', 1)) END AS refers_to FROM s""",
)
def q15(t):
    b = t.raw("benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("In the passage above, "), "text").alias("stem"), F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise("").alias("passage"))
    d = t.docs.select(F.col("doc_id") + 100000, "text", F.lit(None).cast("string"))
    return b.union(d).select("id", op.missing_passage(F.col("stem"), F.col("passage")).alias("refers_to"))


_NUM = "list_distinct(list_transform(regexp_extract_all(regexp_replace(translate({0}, '०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯', '01234567890123456789'), '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END))"


@query(
    "q16_faithful",
    _FIX_SQL
    + f""", turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations UNION ALL SELECT doc_id, 0, text || ' 42', text FROM fixture),
r AS (SELECT *, CASE WHEN length(before) > 0 THEN CAST(length(text) AS DOUBLE) / length(before) ELSE 0e0 END AS ratio, list_sort(list_filter({_NUM.format("text")}, lambda x: NOT list_contains({_NUM.format("before")}, x))) AS fresh FROM turns WHERE before IS NOT NULL)
SELECT conv_id, turn, round(ratio, 2) AS ratio, array_to_string(list_filter([CASE WHEN trim(before) <> '' AND trim(text) = '' THEN 'dropped' END, CASE WHEN len(fresh) > 0 THEN 'new numbers: ' || array_to_string(fresh, ',') END, CASE WHEN length(before) > 0 AND ratio > 2.6 THEN 'too long' END, CASE WHEN length(before) > 0 AND ratio < 0.45 THEN 'too short' END], lambda x: x IS NOT NULL), '; ') AS problems FROM r""",
)
def q16(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.raw("conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))
    extra = t.spark.createDataFrame(FIXTURE, "conv_id long, before string").select("conv_id", F.lit(0).cast("long"), F.concat("before", F.lit(" 42")), "before")
    problems, ratio = op.faithful(F.col("before"), F.col("text"))
    return turns.union(extra).filter("before is not null").select("conv_id", "turn", ratio.alias("ratio"), F.array_join(problems, "; ").alias("problems"))


_OURS = ", ours AS (SELECT paper_id, number, min(key_raw) AS ours FROM questions GROUP BY 1, 2)"


def _ours(t):
    return t.questions.groupBy("paper_id", "number").agg(F.min("key_raw").alias("ours"))


@query(
    "q17_verify_keys",
    _OURS
    + """, official AS (SELECT paper_id, number, CASE WHEN (paper_id + number) % 20 = 0 THEN 'Z' ELSE ours END AS official FROM ours WHERE number <> 2)
SELECT paper_id, count(*) FILTER (WHERE official IS NOT NULL) AS checked, count(*) FILTER (WHERE official <> ours) AS mismatched, count(*) FILTER (WHERE official IS NULL) AS unmatched FROM ours LEFT JOIN official USING (paper_id, number) GROUP BY 1""",
)
def q17(t):
    ours = _ours(t)
    official = ours.filter("number != 2").select("paper_id", "number", F.when((F.col("paper_id") + F.col("number")) % 20 == 0, "Z").otherwise(F.col("ours")).alias("official"))
    return op.verify_keys(ours, official)


@query(
    "q18_identify_section",
    _OURS
    + """, sections AS (SELECT paper_id, number, s AS section, CASE WHEN (paper_id + number) % 4 = s AND s > 0 THEN 'Z' ELSE ours END AS theirs FROM ours CROSS JOIN (VALUES (1), (2), (3)) v(s)),
a AS (SELECT paper_id, section, avg(CASE WHEN ours = theirs THEN 1e0 ELSE 0e0 END) AS agree FROM ours JOIN sections USING (paper_id, number) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY agree DESC, section) AS rn FROM a)
SELECT paper_id, section AS best, round(agree, 6) AS agree, CASE WHEN agree >= 0.95 THEN section END AS accepted FROM b WHERE rn = 1""",
)
def q18(t):
    ours = t.dealt("paper_id").groupBy("paper_id", "number").agg(F.min("key_raw").alias("ours"))
    s = F.col("section")
    sections = ours.withColumn("section", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("paper_id", "number", "section", F.when((F.col("paper_id") + F.col("number")) % 4 == s, "Z").otherwise(F.col("ours")).alias("theirs"))
    return op.identify_section(ours, sections)


@query(
    "q19_batch_report",
    _FACTS
    + """, x AS (SELECT f.*, exam_code FROM full_q f JOIN papers USING (paper_id)) SELECT CASE WHEN grouping(exam_code) = 1 THEN 'TOTAL' ELSE exam_code END AS exam_code, count(*) AS parsed, count(*) FILTER (WHERE n_options = 4) AS four_option, count(key_raw) AS keyed, count(*) FILTER (WHERE n_warnings > 0) AS flagged, count(*) FILTER (WHERE key_raw = 'Z') AS bonus, count(*) FILTER (WHERE length(accepted) > 1) AS multi,
CAST(floor(CAST(count(*) FILTER (WHERE n_warnings = 0) * 100 AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS clean_pct FROM x GROUP BY ROLLUP (exam_code)""",
)
def q19(t):
    return op.batch_report(t.questions.join(t.papers.select("paper_id", "exam_code"), "paper_id"), t.options, "exam_code")
