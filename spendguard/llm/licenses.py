"""Licence scans by canonical digest: whole texts, normalised, hash-joined to known licences.

Normalisation follows the idea of the public SPDX matching guidelines: case, white space, punctuation,
copyright lines and equivalent spellings do not count. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard.llm.registry import query, table

# Spellings that licence matching treats as equal (left becomes right).
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "copyright holder": "copyright owner", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Public licence texts and short licence notices, by SPDX identifier.
LICENSES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Patterns mean the same in Java's and in RE2's syntax: ASCII classes, no line modes.
_NOTICE = r"(^|\n)[ \t]*(copyright( |:|$)|copyright \(c\)|\(c\)|©|all rights reserved)[^\n]*"
_MARKS = r"[^0-9a-z\x80-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, punctuation and white space as one blank, spellings unified."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, _NOTICE, "\n")
    # Two blanks between words, so that neighbours do not share the blank that ends one and starts the next.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, _MARKS, "  ")), F.lit(" "))
    for old, new in _spellings():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spellings() -> list[tuple[str, str]]:
    return [tuple(f" {words.replace(' ', '  ')} " for words in pair) for pair in EQUIVALENT.items()]


def known_licenses(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """license_id and digest of every different canonical text; of equal texts the first identifier."""
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(licenses)], "n int, license_id string, text string")
    digests = rows.select("n", "license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return digests.groupBy("digest").agg(F.min_by("license_id", "n").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_canonical (characters), digest (SHA-256 of the canonical text) and license_id, null where the
    whole text is no known licence, for every row of `docs`.

    Null and empty texts, and texts of punctuation or copyright lines alone, have an empty canonical text and
    no licence. Repeated rows stay; columns not named are ignored. Both sides are joined by digest; equal
    digests of copies are as many as the copies, against one licence row each.
    """
    text = canonical(F.col(text_col))
    hashed = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
        "_id", F.char_length("_t").cast("long").alias("n_canonical"), F.sha2("_t", 256).alias("digest")
    )
    found = hashed.join(licenses.select("digest", "license_id"), "digest", "left")
    return found.select(F.col("_id").alias(id_col), "n_canonical", "digest", F.expr("if(n_canonical > 0, license_id, null)").alias("license_id"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    out = f"regexp_replace({out}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, {_quoted(_NOTICE)}, chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({out}, {_quoted(_MARKS)}, '  ', 'g')) || ' '"
    for old, new in _spellings():
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(replace({out}, '  ', ' '))"


def scan_sql() -> str:
    values = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(LICENSES))
    return f"""
WITH lic(n, license_id, text) AS (VALUES {values}),
known AS (SELECT sha256({_canonical_sql('text')}) AS digest, arg_min(license_id, n) AS license_id FROM lic GROUP BY 1),
docs AS (SELECT doc_id, {_canonical_sql('text')} AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_canonical, sha256(t) AS digest,
    CASE WHEN length(t) > 0 THEN license_id END AS license_id
FROM docs LEFT JOIN known ON known.digest = sha256(t)"""


@query("op9_license_scan", scan_sql())
def op9_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))
