"""Text operators over documents, benchmark items, conversations, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import norm_stem
from quillspark.operators import search
from quillspark.operators import text as op
from quillspark.operators.windows import dedupe_stems
from quillspark.plans import query
from quillspark.plans.quality import _FIX_SQL, _stems


def _list(xs) -> str:
    return "[" + ",".join("'" + x + "'" for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ",".join("'" + x + "'" for x in xs) + ")"


_CLASS = "[a-z0-9\\x{00C0}-\\x{024F}\\x{0900}-\\x{097F}\\x{0A80}-\\x{0AFF}]+"
_TOK = f"list_filter(regexp_extract_all(lower(text), '{_CLASS}'), lambda w: NOT regexp_matches(w, '^[a-z0-9]$') AND w NOT IN {_in(op.STOP)})"
_CHUNKS = _FIX_SQL + f", tok AS (SELECT doc_id AS chunk_id, {_TOK} AS ws FROM stems), tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM tok) GROUP BY 1, 2)"


def _chunks(t):
    return _stems(t).select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 10).alias("page"))


#: Indexes of this session's tables, by application, folder and kind: built once, read by every search.
_BUILT: dict = {}


def _index(t, kind: str):
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _BUILT:
        _BUILT[key] = search.build_index(_chunks(t), search.Words(op.WORD_CLASS, tuple(op.STOP), 2) if kind == "ranked" else search.Words())
    return _BUILT[key]


@query("t4_postings_tf", _CHUNKS + " SELECT chunk_id, term, tf FROM tf")
def t4(t):
    return op.postings(_chunks(t))[0]


@query("t4_postings_df", _CHUNKS + " SELECT term, count(*) AS df FROM tf GROUP BY 1")
def t4_df(t):
    return op.postings(_chunks(t))[1]


_ASK = ", q AS (SELECT item_id AS query_id, replace(text, chr(10), ' ') AS text FROM benchmark)"


def _asks(t):
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))


@query(
    "t5_bm25",
    _CHUNKS
    + _ASK
    + f""", qt AS (SELECT query_id, unnest(list_distinct({_TOK})) AS term FROM q), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS nd, avg(len(ws)) AS ml FROM tok),
s AS (SELECT query_id, tf.chunk_id, sum(ln(1 + (nd - df + 0.5e0) / (df + 0.5e0)) * (tf.tf * 2.5e0) / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * len(ws) / ml))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN tok ON tok.chunk_id = tf.chunk_id CROSS JOIN st GROUP BY 1, 2),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id % 10, chunk_id) AS rank FROM s WHERE score > 0) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 4""",
)
def t5(t):
    return search.ranked_search(_asks(t), _index(t, "ranked"))


_PLAIN = ", pt AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM stems), ptf AS (SELECT chunk_id, term, count(*) AS tf FROM pt GROUP BY 1, 2)"
_HARM = "list_sum(list_transform(range(1, tf + 1), lambda i: 1e0 / (i * i)))"
_STRICT = (
    _PLAIN
    + f""", wq AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN '"' || array_to_string(list_slice(string_split(text, ' '), 1, CASE WHEN query_id % 2 = 0 THEN 2 ELSE 4 END), ' ') || '" ' || text WHEN query_id % 3 = 1 THEN text || ' -the' ELSE text END AS text FROM q),
w AS (SELECT query_id, list_distinct(regexp_extract_all(regexp_replace(lower(text), '(^| )-[a-z0-9]+', ' ', 'g'), '[a-z0-9]+')) AS terms, regexp_extract_all(lower(text), '(?:^| )-([a-z0-9]+)', 1) AS minus, regexp_extract_all(lower(text), '"([^"]+)"', 1) AS phrases FROM wq),
hits AS (SELECT query_id, chunk_id, len(terms) AS n, count(*) AS h, sum({_HARM}) / len(terms) AS score FROM (SELECT query_id, terms, unnest(terms) AS term FROM w) JOIN ptf USING (term) GROUP BY 1, 2, 3),
ok AS (SELECT h.query_id, h.chunk_id, score FROM hits h JOIN w USING (query_id) JOIN stems ON doc_id = chunk_id WHERE h = n AND NOT EXISTS (SELECT 1 FROM ptf p WHERE p.chunk_id = h.chunk_id AND list_contains(w.minus, p.term)) AND len(list_filter(w.phrases, lambda x: NOT contains(' ' || array_to_string(regexp_extract_all(lower(stems.text), '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(x, '[a-z0-9]+'), ' ') || ' '))) = 0),
strict AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ok)"""
)


def _web(t):
    q = F.col("query_id")
    text = F.when(q % 3 == 0, F.concat(F.lit('"'), F.array_join(F.slice(F.split("text", " "), F.lit(1), F.when(q % 2 == 0, 2).otherwise(4)), " "), F.lit('" '), "text")).when(q % 3 == 1, F.concat("text", F.lit(" -the"))).otherwise(F.col("text"))
    return _asks(t).select("query_id", text.alias("text"))


@query("t6_fts_all", _FIX_SQL + _ASK + _STRICT + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM strict WHERE rank <= 4")
def t6(t):
    return search.strict_search(_web(t), _index(t, "words"))


_ANY = f""", ask AS (SELECT query_id, list_slice(list_ordered, 1, 8) AS terms FROM (SELECT query_id, list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_position(ws, ws[i]) = i THEN ws[i] END), lambda x: x IS NOT NULL) AS list_ordered FROM (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3) AS ws FROM {{0}}))),
ah AS (SELECT query_id, chunk_id, sum({_HARM}) / len(terms) AS score FROM (SELECT query_id, terms, unnest(terms) AS term FROM ask) JOIN ptf USING (term) GROUP BY query_id, chunk_id, terms),
loose AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ah)"""


@query("t7_fts_any", _FIX_SQL + _ASK + _PLAIN + _ANY.format("q") + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM loose WHERE rank <= 4")
def t7(t):
    return search.loose_search(_asks(t), _index(t, "words"))


_PART = "CASE WHEN chunk_id % 10 < 8 THEN 'corpus' ELSE 'notes' END AS part"


@query(
    "t8_retrieve",
    _FIX_SQL
    + _ASK
    + _STRICT.replace("ELSE text END AS text FROM q),", "ELSE text END AS text FROM q UNION ALL SELECT -1, 'zzzz qqqq'),")
    + _ANY.format("wq")
    + f""", sr AS (SELECT query_id, chunk_id, part, row_number() OVER (PARTITION BY query_id, part ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT *, {_PART} FROM ok)),
lr AS (SELECT query_id, chunk_id, part, row_number() OVER (PARTITION BY query_id, part ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT *, {_PART} FROM ah) x WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.query_id = x.query_id AND sr.part = x.part)),
found AS (SELECT query_id, part, 'all' AS method, chunk_id, rank FROM sr UNION ALL SELECT query_id, part, 'any', chunk_id, rank FROM lr),
cited AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS number FROM found WHERE rank <= CASE part WHEN 'corpus' THEN 4 ELSE 2 END)
SELECT query_id, number, part AS source, method, chunk_id FROM cited UNION ALL SELECT query_id, 0, 'none', 'nothing found', NULL FROM wq WHERE query_id NOT IN (SELECT query_id FROM cited)""",
)
def t8(t):
    asks = _web(t).union(t.spark.createDataFrame([(-1, "zzzz qqqq")], "query_id long, text string"))
    return search.retrieve(asks, _index(t, "words").only("page < 8"), _index(t, "words").only("page >= 8"))


@query("t9_repeats")
def t9(t):
    """Every line of every document is a stem; a document's source is its sitting."""
    lines = t.docs.select(F.col("doc_id").alias("question_id"), F.col("source").alias("sitting"), F.explode(F.split("text", "\n")).alias("stem"))
    return op.repeats(lines)


@query(
    "t9_stem_repeats",
    """, l AS (SELECT source, unnest(string_split(text, chr(10))) AS stem FROM documents), s AS (SELECT source, trim(regexp_replace(regexp_replace(regexp_replace(lower(stem), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^(which (one )?of the following|read the following|consider the following)', ''), '[^a-z0-9 ]', '', 'g')) AS norm FROM l)
SELECT norm AS anchor, count(DISTINCT source) AS sittings, count(*) AS questions FROM s WHERE length(norm) >= 40 GROUP BY 1 HAVING count(DISTINCT source) > 1""",
)
def t9_exact(t):
    lines = t.docs.select(F.col("source").alias("sitting"), F.explode(F.split("text", "\n")).alias("stem")).withColumn("anchor", norm_stem(F.col("stem"))).filter(F.char_length("anchor") >= 40)
    return lines.groupBy("anchor").agg(F.count_distinct("sitting").alias("sittings"), F.count(F.lit(1)).alias("questions")).filter("sittings > 1")


TAXONOMY = [("alpha", "History", ["the thing", "ontheretion", "and"]), ("beta", "Pedagogy", ["teacher", "ing th", "of"]), ("gamma", "Civics", ["erhaps", "de la", "que"]), ("delta", "Geography", ["und der", "die"])]


def _tag_sql() -> str:
    def hit(a: str) -> str:
        tight = f" OR contains(tight, '{a.replace(' ', '')}')" if " " in a else ""
        return f"CASE WHEN contains(hay, '{a}'){tight} THEN {3 if ' ' in a or len(a) >= 9 else 1} ELSE 0 END"

    each = ",".join("{'id': '" + i + "', 'strand': '" + s + "', 'score': " + " + ".join(map(hit, al)) + "}" for i, s, al in TAXONOMY)
    word = lambda p: p.replace("'", "''")
    return f""", b AS (SELECT doc_id, text, lower(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS hay, regexp_matches(text, '{word(op.PEDAGOGY)}') AND NOT regexp_matches(text, '{word(op.STRONG)}') AS ped FROM s0),
c AS (SELECT *, replace(hay, ' ', '') AS tight FROM b), d AS (SELECT *, list_filter([{each}], lambda x: x.score > 0) AS al FROM c), e AS (SELECT doc_id, hay, ped, unnest(CASE WHEN ped THEN list_filter(al, lambda x: x.strand = 'Pedagogy') ELSE al END) AS x FROM d),
r AS (SELECT doc_id, x.id AS id, x.score AS score, row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.id) AS rn FROM e), m AS (SELECT d.doc_id, hay, ped, a.id, a.score AS best, coalesce(z.score, 0) AS runner FROM d LEFT JOIN r a ON a.doc_id = d.doc_id AND a.rn = 1 LEFT JOIN r z ON z.doc_id = d.doc_id AND z.rn = 2)
SELECT doc_id AS question_id, CASE WHEN best >= 2 AND best - runner >= 1 THEN id END AS topic_id, CASE WHEN trim(hay) = '' THEN 'empty question' WHEN ped AND best IS NULL THEN 'pedagogy question without a pedagogy alias' WHEN best IS NULL THEN 'no alias' WHEN best < 2 THEN 'weak: ' || CAST(best AS VARCHAR) WHEN best - runner < 1 THEN 'ambiguous: ' || CAST(best AS VARCHAR) ELSE 'score ' || CAST(best AS VARCHAR) || ' to ' || CAST(runner AS VARCHAR) END AS reason FROM m"""


@query("t10_tag_topics", ", s0 AS (SELECT doc_id, text FROM documents UNION ALL SELECT 900001, 'The teacher teaches of the thing' UNION ALL SELECT 900002, 'A classroom lesson on erhaps' UNION ALL SELECT 900003, 'Gandhi and the thing for students should')" + _tag_sql())
def t10(t):
    extra = t.spark.createDataFrame([(900001, "The teacher teaches of the thing"), (900002, "A classroom lesson on erhaps"), (900003, "Gandhi and the thing for students should")], "doc_id long, text string")
    rows = t.docs.select("doc_id", "text").union(extra)
    return op.tag_topics(rows.select(F.col("doc_id").alias("question_id"), F.col("text").alias("stem"), "text"), TAXONOMY)


_MESSAGES = [(-1, 0, "बाल विकास क्या है ?"), (-2, 0, "bal vikas kya hai bhai"), (-3, 0, "What is child development?"), (-4, 0, "No in 6 pages write all notes on Hindi"), (-5, 0, ""), (-6, 0, "123 + 4"), (-7, 0, "કોષિકા (Cell)"), (-8, 0, "kem cho mane shu che"), (-9, 0, "one kya in a long english sentence here matlab nothing")]


@query(
    "t11_register_census",
    f""", msgs AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {",".join(f"({a}, {b}, '{c}')" for a, b, c in _MESSAGES)}) v(conv_id, turn, text)),
a AS (SELECT *, trim(text) AS raw, len(regexp_extract_all(text, '[\\x{{0900}}-\\x{{097F}}]')) AS d, len(regexp_extract_all(text, '[\\x{{0A80}}-\\x{{0AFF}}]')) AS g, len(regexp_extract_all(text, '[A-Za-z]')) AS l, regexp_extract_all(lower(text), '[a-z]+') AS w, lower(regexp_extract(trim(text), '(?i)(?:^|[^a-z])(?:in|on|into)[ ]+(hindi|gujarati|english)(?:[^a-z]|$)', 1)) AS asked FROM msgs),
b AS (SELECT *, len(w) AS n, d + g + l AS total, CASE WHEN len(list_filter(w, lambda x: x IN {_in([x for x in op.HINGLISH if x not in op.AMBIGUOUS])})) > 0 THEN len(list_filter(w, lambda x: x IN {_in(op.HINGLISH)})) ELSE 0 END AS hi, CASE WHEN len(list_filter(w, lambda x: x IN {_in([x for x in op.GUJLISH if x not in op.AMBIGUOUS])})) > 0 THEN len(list_filter(w, lambda x: x IN {_in(op.GUJLISH)})) ELSE 0 END AS gu FROM a),
c AS (SELECT *, greatest(hi, gu) AS hits, CAST(greatest(hi, gu) AS DOUBLE) / greatest(n, 1) AS density, CAST(greatest(d, g) AS DOUBLE) / greatest(total, 1) AS share, d > 0 OR g > 0 AS native, CASE WHEN d >= g THEN 'hi' ELSE 'gu' END AS lg FROM b),
e AS (SELECT *, hits = 0 OR (hits < 2 AND density < 0.25) AS english FROM c),
f AS (SELECT *, CASE WHEN total = 0 THEN 'en' WHEN native AND share >= 0.55 THEN lg WHEN native THEN CASE WHEN lg = 'hi' THEN 'hinglish' ELSE 'gujlish' END WHEN english THEN 'en' WHEN gu > hi THEN 'gujlish' ELSE 'hinglish' END AS plain, CASE WHEN total = 0 THEN 'en' WHEN native THEN lg WHEN english THEN 'en' WHEN gu > hi THEN 'gu' ELSE 'hi' END AS under,
  CASE WHEN total = 0 THEN 0e0 WHEN native AND share >= 0.55 THEN least(1e0, share + 0.2e0) WHEN native THEN 0.7e0 WHEN hits = 0 THEN 0.9e0 WHEN english THEN 0.6e0 ELSE least(1e0, 0.5e0 + density) END AS sure, CASE asked WHEN 'hindi' THEN 'hi' WHEN 'gujarati' THEN 'gu' WHEN 'english' THEN 'en' END AS want FROM e)
SELECT conv_id, turn, coalesce(want, plain) AS register, CASE WHEN want IS NOT NULL OR plain = 'en' THEN coalesce(want, plain) ELSE under END AS lang, round(CASE WHEN want IS NOT NULL THEN 1e0 ELSE sure END, 6) AS confidence FROM f""",
)
def t11(t):
    extra = t.spark.createDataFrame(_MESSAGES, "conv_id long, turn long, text string")
    return op.register_census(t.raw("conversations").select("conv_id", "turn", "text").union(extra)).select("conv_id", "turn", "register", "lang", "confidence")


_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]*'), lambda w: w NOT IN {_in(sorted(set(op.HINGLISH) | set(op.GUJLISH) | set(op.SCAFFOLD)))} AND length(w) > 2)"


@query("t13_query_terms", f"SELECT conv_id, turn, array_to_string({_TERMS}, ' ') AS terms FROM conversations", prelude=False)
def t13(t):
    return t.raw("conversations").select("conv_id", "turn", F.array_join(op.content_terms(F.col("text")), " ").alias("terms"))


@query(
    "w10_followup_terms",
    f"""WITH u AS (SELECT conv_id, turn, {_TERMS} AS own FROM conversations WHERE role = 'user'), l AS (SELECT *, lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u),
m AS (SELECT conv_id, turn, CASE WHEN len(own) BETWEEN 1 AND 4 AND len(before) > 0 THEN list_concat(own, before) ELSE own END AS ws, len(own) BETWEEN 1 AND 4 AND len(before) > 0 AS merged FROM l)
SELECT conv_id, turn, array_to_string(CASE WHEN merged THEN list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_position(ws, ws[i]) = i THEN ws[i] END), lambda x: x IS NOT NULL) ELSE ws END, ' ') AS terms FROM m""",
    prelude=False,
)
def w10(t):
    return op.followup_terms(t.raw("conversations")).select("conv_id", "turn", F.array_join("terms", " ").alias("terms"))


#: Turns of two short follow-ups, a long one after a short one, and one whose terms all stand after the sixth word.
_TURNS = [(-1, 0, "user", "Explain photosynthesis stages"), (-1, 1, "assistant", "Light and dark stages"), (-1, 2, "user", "chlorophyll absorption"), (-1, 3, "user", "compare mitochondria chloroplast nucleus ribosome vacuole cytoplasm membrane"), (-1, 4, "user", "what is the it of the osmosis diffusion gradient pressure turgor"), (-1, 5, "user", "")]


@query(
    "w10_followup_terms_whole",
    f"""WITH v AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {",".join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in _TURNS)}) x(conv_id, turn, role, text)),
u AS (SELECT conv_id, turn, {_TERMS} AS own FROM v WHERE role = 'user'), l AS (SELECT *, lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u),
m AS (SELECT conv_id, turn, CASE WHEN len(own) BETWEEN 1 AND 4 AND len(before) > 0 THEN list_concat(own, before) ELSE own END AS ws, len(own) BETWEEN 1 AND 4 AND len(before) > 0 AS merged FROM l)
SELECT conv_id, turn, array_to_string(CASE WHEN merged THEN list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_position(ws, ws[i]) = i THEN ws[i] END), lambda x: x IS NOT NULL) ELSE ws END, ' ') AS terms FROM m""",
    prelude=False,
)
def w10_whole(t):
    """As w10_followup_terms, with turns that are merged and turns that are not."""
    turns = t.raw("conversations").select("conv_id", "turn", "role", "text").union(t.spark.createDataFrame(_TURNS, "conv_id long, turn long, role string, text string"))
    return op.followup_terms(turns).select("conv_id", "turn", F.array_join("terms", " ").alias("terms"))


@query(
    "t14_script_profile",
    _FIX_SQL
    + """, r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}][^\\x{0900}-\\x{097F}\\x{0A80}-\\x{0AFF}]*|[\\x{0900}-\\x{097F}][^A-Za-z\\x{00C0}-\\x{024F}\\x{0A80}-\\x{0AFF}]*|[\\x{0A80}-\\x{0AFF}][^A-Za-z\\x{00C0}-\\x{024F}\\x{0900}-\\x{097F}]*')) AS run FROM stems),
e AS (SELECT doc_id, CASE WHEN regexp_matches(run, '^[\\x{0900}-\\x{097F}]') THEN 'devanagari' WHEN regexp_matches(run, '^[\\x{0A80}-\\x{0AFF}]') THEN 'gujarati' ELSE 'latin' END AS script, run FROM r),
g AS (SELECT doc_id, script, count(*) AS runs, CAST(sum(length(run)) AS BIGINT) AS chars FROM e GROUP BY 1, 2)
SELECT doc_id, script, runs, chars, coalesce(first_value(CASE WHEN script <> 'latin' THEN script END) OVER (PARTITION BY doc_id ORDER BY CASE WHEN script <> 'latin' THEN 0 ELSE 1 END, chars DESC, script DESC), 'latin') AS dominant FROM g""",
)
def t14(t):
    return op.script_profile(_stems(t).select("doc_id", F.lit("s").alias("source"), "text")).drop("source")


_SHAPES = ["", "Assertion (A): ", "Consider the following: Statement I ", "Match the column I ", "Which of these is not correct? ", "The teacher asks: "]


@query(
    "t16_archetypes",
    ", s AS (SELECT item_id, ["
    + ",".join(f"'{x}'" for x in _SHAPES)
    + "][CAST(item_id % 6 + 1 AS BIGINT)] || text AS text FROM benchmark), a AS (SELECT item_id, list_filter(["
    + ",".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in op.ARCHETYPES)
    + "], lambda x: x IS NOT NULL) AS f FROM s) SELECT item_id, array_to_string(f, ',') AS flags, f[1] AS main FROM a",
)
def t16(t):
    shapes = F.array(*map(F.lit, _SHAPES))
    rows = t.raw("benchmark").select("item_id", F.concat(F.get(shapes, (F.col("item_id") % 6).cast("int")), "text").alias("text")).select("item_id", op.archetypes(F.col("text")).alias("f"))
    return rows.select("item_id", F.array_join("f", ",").alias("flags"), F.get("f", F.lit(0)).alias("main"))


def _html_sql() -> str:
    body = "html"
    for tag in op.BLOCKS:
        body = f"regexp_replace({body}, '(?is)<{tag}(?:[ \\t\\r\\n/][^>]*)?>.*?</{tag}>', ' ', 'g')"
    body = f"regexp_replace({body}, '(?i)<br[ ]*/?>|</p>|</div>|</li>|</h[1-6]>', chr(10), 'g')"
    body = f"regexp_replace({body}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        body = f"replace({body}, '{a}', '{b}')"
    return f"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g')), 1, 200) ELSE 'Web page' END AS title,
trim(array_to_string(list_filter(list_transform(string_split(regexp_replace({body}, '[ \\t\\r\\f\\v]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 2), chr(10))) AS text FROM pages"""


@query("t17_html_text", _html_sql(), prelude=False)
def t17(t):
    title, text = op.html_text(F.col("html"))
    return t.raw("pages").select("page_id", title.alias("title"), text.alias("text"))


@query("t19_dedupe_docs", "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents", prelude=False)
def t19(t):
    return op.dedupe_docs(t.docs)


@query(
    "t20_parse_outputs",
    """WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Sure: ' || props || ' done' WHEN 2 THEN props ELSE '{' || props END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(regexp_extract(raw, '"k": *([0-9]+)', 1) AS BIGINT) END AS k, event_id % 4 <> 3 AS ok FROM w""",
    prelude=False,
)
def t20(t):
    e, p = F.col("event_id"), F.col("props")
    raw = F.when(e % 4 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e % 4 == 1, F.concat(F.lit("Sure: "), p, F.lit(" done"))).when(e % 4 == 2, p).otherwise(F.concat(F.lit("{"), p))
    return op.parse_outputs(t.raw("events").select("event_id", raw.alias("raw")), "raw", "k long").select("event_id", F.col("parsed.k").alias("k"), "ok")


_TIER = """qt AS (SELECT query_id, lower(trim(query)) AS q, list_filter(string_split_regex(lower(trim(query)), '[^a-z0-9+#.]+'), lambda w: w <> '') AS ts FROM qs),
c AS (SELECT query_id, item_id, CASE WHEN k = q THEN 0 WHEN contains(k, q) THEN 1 WHEN len(ts) > 0 AND len(list_filter(ts, lambda w: NOT contains(hay, w))) = 0 THEN CASE WHEN len(list_filter(ts, lambda w: contains(k, w))) > 0 THEN 2 ELSE 3 END WHEN contains(hay, q) THEN 4 END AS tier
  FROM qt CROSS JOIN (SELECT item_id, lower(item_id) AS k, lower(item_id) || ' ' || lower(name) || ' ' || lower(text) AS hay FROM items) WHERE q <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(item_id), item_id) AS rank FROM c WHERE tier IS NOT NULL) SELECT query_id, item_id, tier, rank FROM r WHERE rank <= 25"""
_WANTED = [(1, "12"), (2, "red ring"), (3, "brand#1"), (4, "small widget economy"), (5, "1999"), (6, "  "), (7, "--"), (8, "RING 7"), (9, "zzz q"), (10, "o"), (11, "x-1/2"), (12, "1/2 --")]


@query(
    "t22_tier_search",
    f""", qs AS (SELECT * FROM (VALUES {",".join(f"({a}, '{b}')" for a, b in _WANTED)}) v(query_id, query)), given AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name, p_name || ' ' || p_brand || ' ' || p_type AS text, 0 AS place FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'flat copy', p_type, 1 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'X-' || CAST(p_partkey AS VARCHAR) || '/2', p_name, '--' || p_brand, 1 FROM part WHERE p_partkey % 50 = 1),
items AS (SELECT item_id, name, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(item_id) ORDER BY place) AS rn FROM given) WHERE rn = 1), """
    + _TIER,
)
def t22(t):
    """Parts, with flat copies that lose against them."""
    qs = t.spark.createDataFrame(_WANTED, "query_id int, query string")
    part, key = t.raw("part"), F.col("p_partkey").cast("string")
    own = part.select(key.alias("item_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.lit(0).alias("place"))
    flat = part.filter("p_partkey % 3 = 0").select(key, F.lit("flat copy"), "p_type", F.lit(1))
    odd = part.filter("p_partkey % 50 = 1").select(F.concat(F.lit("X-"), key, F.lit("/2")), "p_name", F.concat(F.lit("--"), "p_brand"), F.lit(1))
    return search.tier_search(qs, search.build_catalogue(search.catalogue(own.union(flat).union(odd), ["place"])))


@query(
    "t22_tier_search_benchmark",
    """, qs AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, CAST(1 + item_id % 4 AS BIGINT)), ' ') AS query FROM benchmark), items AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, coalesce(source, '') AS name, coalesce(text, '') AS text FROM documents), """
    + _TIER,
)
def t22_benchmark(t):
    """The first one to four words of each benchmark item, against whole documents."""
    q = F.col("item_id")
    qs = t.raw("benchmark").select(q.alias("query_id"), F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), F.lit(1), (1 + q % 4).cast("int")), " ").alias("query"))
    return search.tier_search(qs, search.build_catalogue(t.docs.select(F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("name"), "text")))


@query(
    "t23_headings",
    """, n AS (SELECT doc_id, doc_id % 3 + 1 AS chapter, list_transform(string_split(text, chr(10)), lambda x, i: CAST((i % 3) + 1 AS VARCHAR) || '.' || CAST(i AS VARCHAR) || ' ' || x) AS ls FROM documents),
l AS (SELECT doc_id, chapter, unnest(ls) AS line, generate_subscripts(ls, 1) AS spot FROM n), f AS (SELECT *, regexp_extract(line, '^([0-9]+\\.[0-9]+)', 1) AS number, trim(regexp_replace(line, '^[0-9]+\\.[0-9]+[ \\t]+', '')) AS title FROM l WHERE regexp_matches(line, '^[ \\t]*[0-9]{1,2}\\.[0-9]{1,2}[ \\t]+[^\\n]{3,80}$') AND CAST(regexp_extract(line, '^([0-9]+)\\.', 1) AS INTEGER) = chapter)
SELECT doc_id, number, title, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS place FROM f""",
)
def t23(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((((i + 1) % 3) + 1).cast("string"), F.lit("."), (i + 1).cast("string"), F.lit(" "), x))
    return op.headings(t.docs.select("doc_id", (F.col("doc_id") % 3 + 1).alias("chapter"), F.array_join(lines, "\n").alias("text")))


@query("t24_guess_mistake", ", m AS (SELECT attempt_id, list_sort(list(time_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM responses GROUP BY 1) SELECT attempt_id, question_no, CASE WHEN time_ms > 0 AND time_ms < median * 0.4e0 THEN 'misread' ELSE 'conceptual' END AS guess FROM responses JOIN m USING (attempt_id)")
def t24(t):
    return op.guess_mistake(t.responses.select("attempt_id", "question_no", "time_ms")).select("attempt_id", "question_no", "guess")


@query(
    "w8_dedupe_stems",
    """, s AS (SELECT question_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(stem), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^(which (one )?of the following|read the following|consider the following)', ''), '[^a-z0-9 ]', '', 'g')) AS fp FROM questions),
r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY question_id) AS rn FROM s) SELECT question_id FROM r WHERE fp = '' OR rn = 1""",
)
def w8(t):
    return dedupe_stems(t.questions.select("question_id", "stem"), norm_stem(F.col("stem")), ["question_id"]).select("question_id")


def _pages(t):
    """Documents as pages of twelve lines, each line a paragraph."""
    lines = F.split("text", "\n")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 12).cast("int")), lambda i: F.array_join(F.slice(lines, i * 12 + 1, F.lit(12)), "\n\n"))
    return t.docs.select("doc_id", F.posexplode(parts).alias("page", "text"))


@query("t2_chunk_corpus")
def t2(t):
    return op.chunk_corpus(_pages(t))


@query("t3_chunk_pages")
def t3(t):
    return op.chunk_pages(_pages(t))

