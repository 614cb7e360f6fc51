"""License scans: entire texts and stand-alone notice lines looked up by canonical digest.

A text is made canonical (case, punctuation, copyright lines, equivalent spellings, blanks), hashed, and joined with
the digests of known licence texts, a table of some dozens that is broadcast up to BROADCAST rows. The unit is the entire
document, however long, and each of its lines, which must equal a known notice as a whole. Only matches have rows: a
document without one has none. A null or empty text, or one of copyright lines only, matches nothing. Of known texts with
one digest the first name counts. Repeated rows give repeated results; an empty table an empty one; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lowered

#: Known texts, public licence notices and short licences.
KNOWN = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "Released under the MIT License."),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
#: Canonical digests of further licences' official texts, those longer than a screen among them.
DIGESTS = [
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSD-2-Clause", "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-3-Clause", "6e5bc7d06b9485f41b9e2e272443a94351b113b594b4615a14a64b741fc6d298"),
    ("BSL-1.0", "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6"),
    ("CC0-1.0", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("GFDL-1.2", "8446e2329e3fe2b35501056164a645d74fef33dc1b8a2a132629bf1935fa72e7"),
    ("GFDL-1.3", "961b6d8afa12e353079f8676ad28084c800a46123e76f7f4f7e7f81df82289dc"),
    ("GPL-1.0", "a39d7cceab675e14bdc24e269448ac0ed44fdef25178b183064cd4b35b8d2e7b"),
    ("GPL-2.0", "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5"),
    ("GPL-3.0", "68ca42869e9a3e25843be66c6f296ce2b1f3629ac71d77465db0636dc8781c06"),
    ("LGPL-2.0", "1862ecc2c3c5e3b9e88481e95603c88e089c43e9d5702b2ec01391491b606a9e"),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
    ("Unlicense", "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
]
#: Spellings that count as the same, after case and punctuation are gone.
EQUIVALENT = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("organisation", "organization"), ("v", "version")]
BROADCAST = 100_000
COPYRIGHT = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by[ \t])|\(c\)|©|all rights reserved)[^\n]*$"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word that each of the known texts holds, in any of its spellings.
HINT = r"(?i)licen[sc]e|public|permission|redistribution"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, equivalent spellings, single blanks."""
    out = F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, _MARKS, " ")), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: list[tuple[str, str, str]] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame(known, "license string, form string, text string")
    texts = rows.select("license", "form", digest(F.col("text")).alias("digest"), canonical(F.col("text")).rlike(HINT).alias("hinted"))
    return texts.union(spark.createDataFrame([(n, "text", d, True) for n, d in DIGESTS], texts.schema)).dropDuplicates(["digest"])


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each match: doc_id, unit (text: the entire document; line: a line of it), line_no (from 1; 0 for the text), digest, license.

    known: table (license, digest, form, hinted), as known_digests() makes it. Where all known texts hold a word of HINT,
    only units that hold one are hashed; no other could match."""
    known = known if known is not None else known_digests(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("whole"))
    hinted = bool(known.agg(F.coalesce(F.bool_and("hinted"), F.lit(True)).alias("h")).first()["h"])
    if hinted:
        base = base.filter(F.col("whole").rlike(HINT))
    lines = F.transform(F.split("whole", "\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), x.alias("unit_text")))
    if hinted:
        lines = F.filter(lines, lambda x: x["unit_text"].rlike(HINT))
    units = base.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("line_no"), F.col("whole").alias("unit_text"))), lines)).alias("x"))
    hashed = units.select("doc_id", F.when(F.col("x.line_no") == 0, "text").otherwise("line").alias("unit"), F.col("x.line_no").alias("line_no"), digest(F.col("x.unit_text")).alias("digest"))
    small = known.select("digest", "license")
    small = F.broadcast(small) if known.count() <= BROADCAST else small
    return hashed.join(small, "digest").select("doc_id", "unit", "line_no", "digest", "license")
