"""SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

import math

from .licenses import COPYRIGHT, DIGESTS, EQUIVALENT, KNOWN
from .quality import GRIDS

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(COPYRIGHT)}, '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


LICENSES = f"""WITH known AS (SELECT license, sha256({_canonical("text")}) AS digest FROM (VALUES {",".join(f"({_quoted(a)}, {_quoted(t)})" for a, _, t in KNOWN)}) v(license, text) UNION ALL SELECT * FROM (VALUES {",".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in DIGESTS)}) w(license, digest)),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS text FROM documents),
units AS (SELECT doc_id, 'text' AS unit, 0 AS line_no, text FROM lines UNION ALL SELECT doc_id, 'line', CAST(generate_subscripts(ls, 1) AS INTEGER), unnest(ls) FROM lines)
SELECT doc_id, unit, line_no, digest, license FROM (SELECT doc_id, unit, line_no, sha256({_canonical("text")}) AS digest FROM units) JOIN known USING (digest)"""

MIXING = f"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || md5(coalesce(text, ''))), 1, 9) AS BIGINT) AS ticket FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, CAST(2 * size AS DOUBLE) AS cap FROM src),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, rk) AS spot FROM w),
c AS (SELECT *, 1.5e0 * (SELECT sum(size) FROM src) - coalesce(sum(cap) OVER (ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pool, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM o),
f AS (SELECT pool, heavy, spot FROM c WHERE pool / heavy * w <= cap ORDER BY spot LIMIT 1),
t AS (SELECT c.source, c.size AS source_size, CASE WHEN (SELECT spot FROM f) <= c.spot THEN (SELECT pool / heavy FROM f) * w ELSE cap END AS target FROM c),
n AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), source_size) AS need1, greatest(CAST(floor(target + 0.5) AS BIGINT) - source_size, 0) AS need2 FROM t),
g AS (SELECT source, ticket, sum(size) AS words FROM s GROUP BY 1, 2), r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY ticket) AS upto FROM g),
k AS (SELECT r.source, r.ticket, CASE WHEN upto <= need1 OR (upto - words <= need1 AND need1 < upto AND (need1 - (upto - words)) * 2 >= words) THEN 1 ELSE 0 END + CASE WHEN upto <= need2 OR (upto - words <= need2 AND need2 < upto AND (need2 - (upto - words)) * 2 >= words) THEN 1 ELSE 0 END AS times FROM r JOIN n ON n.source IS NOT DISTINCT FROM r.source)
SELECT s.doc_id, s.size, n.source_size, n.target, CAST(s.size * k.times AS BIGINT) AS taken FROM s JOIN n ON n.source IS NOT DISTINCT FROM s.source JOIN k ON k.source IS NOT DISTINCT FROM s.source AND k.ticket = s.ticket"""

_LEVELS = ", ".join(f"CAST(len(list_filter({cs}, lambda c: {m} > c)) AS INTEGER) AS {m}" for m, cs in GRIDS.items())
_TESTS = math.prod(len(cs) + 1 for cs in GRIDS.values())
_RULES = " CROSS JOIN ".join(f"(SELECT unnest(range({len(cs) + 1})) AS r_{m})" for m, cs in GRIDS.items())
_UNDER = " AND ".join(f"{m} <= r_{m}" for m in GRIDS)

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(list_slice(ws, i, i + 7), ' '))) AS x, unnest(range(1, len(ws) - 6)) AS spot FROM d WHERE len(ws) >= 8),
twice AS (SELECT doc_id, spot FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(least(8, coalesce(after - spot, 8))) AS BIGINT) AS n FROM (SELECT *, lead(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS after FROM twice) GROUP BY 1),
m AS (SELECT d.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
q AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS long_words FROM m),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
rated AS (SELECT doc_id, stratum, first(good) AS good, {", ".join(f"max({m}) AS {m}" for m in GRIDS)} FROM (SELECT doc_id, stratum, good, {_LEVELS} FROM q JOIN lab USING (doc_id)) GROUP BY 1, 2),
tot AS (SELECT stratum, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS all_bad FROM rated GROUP BY 1),
cell AS (SELECT stratum, {", ".join(GRIDS)}, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad FROM rated GROUP BY ALL),
cnt AS (SELECT tot.stratum, n, all_bad, {", ".join(f"r_{m}" for m in GRIDS)}, n - coalesce(sum(good), 0) AS k, all_bad - coalesce(sum(bad), 0) AS caught FROM tot CROSS JOIN {_RULES} LEFT JOIN cell ON cell.stratum = tot.stratum AND {_UNDER} GROUP BY tot.stratum, n, all_bad, {", ".join(f"r_{m}" for m in GRIDS)}),
safe AS (SELECT * FROM cnt WHERE n > 0 AND k <= n * 0.02e0 AND caught > all_bad * 0.02e0 AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02e0) + (n - j) * ln(0.98e0)))) * (SELECT count(*) * {_TESTS} FROM tot) <= 0.05e0),
lim AS (SELECT stratum, {", ".join(f"({cs})[r_{m} + 1] AS max_{m}" for m, cs in GRIDS.items())} FROM safe QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, k, {", ".join(f"r_{m} DESC" for m in GRIDS)}) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({m} > max_{m}, false)" for m in GRIDS)}) AS kept FROM q LEFT JOIN lim USING (stratum)"""

ORACLE_SQL = {"op4_license_scan": LICENSES, "op6_quality_rules": QUALITY, "op7_mixing": MIXING}
