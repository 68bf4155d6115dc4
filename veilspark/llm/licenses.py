"""License scans by canonical digest lookup.

A text is made canonical (ASCII case, copyright lines, punctuation and equivalent spellings no longer differ), and the
SHA-256 of its canonical form is looked up in the digests of known licences by a hash join over entire texts. A line
that as a whole is a known notice is looked up the same way. The copyright rule of the canonical form takes any line that
begins with the word, also one of wrapped prose; a text with such lines is looked up in a second form, too, without its
copyright notices only.

Defined results: a null text has a null digest and no licence; an empty text has the digest of the empty string; rows
repeat as they come; a null doc_id is kept. Extra columns are ignored. The catalogue is a table of the caller's, of
`CATALOGUE_ROWS` rows at most.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the catalogue, which goes to every task.
CATALOGUE_ROWS = 10_000

# Spellings that count as equal, after lower-casing.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("modelled", "modeled"), ("per cent", "percent"), ("non-commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("https://", "http://")]
#: Blanks and comment marks before the words of a line.
_MARKS = r"[ \t#*;%/!-]*"
COPYRIGHT_LINE = rf"(?m)^{_MARKS}(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: A line that is a notice wherever it stands, and those that begin a paragraph; a wrapped line of prose is neither.
NOTICE_LINE = rf"(?m)^{_MARKS}(?:copyright[ \t:]*(?:\(c\)|©|[<\[{{]|[0-9]{{4}})[^\n]*|\(c\)[ \t]*(?:copyright|[<\[{{]|[0-9]{{4}})[^\n]*|©[^\n]*|all rights reserved[.!]?[ \t\r]*)$"
NOTICE_PARAGRAPH = rf"(\A|\n[ \t\r]*\n)(?:{_MARKS}(?:copyright|\(c\)|©|all rights reserved)[^\n]*(?:\n|$))++"
# what is neither letter nor digit of ASCII, and the punctuation that texts are typeset with
NO_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f" + " «»‐-‧‰-⁞　-〃]+"
#: If every notice has this in its canonical form, other lines aren't looked up.
MARK = "licen"

# Licence texts and one-line notices.
_PERMISSIVE_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
LICENSES = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _PERMISSIVE_END,
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END,
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_START + _BSD_END,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END,
}
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
}

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: What goes of a text, with what is put there; `lines` is the SQL's rule.
_RULES = {"lines": [(COPYRIGHT_LINE, "")], "notices": [(NOTICE_LINE, ""), (NOTICE_PARAGRAPH, "1")], "none": []}


def canonical_text(text: str, rule: str = "lines") -> str:
    """The canonical form, for catalogue entries."""
    x = text.translate(str.maketrans(_FROM, _FROM.lower()))
    for pattern, group in _RULES[rule]:
        x = re.sub(pattern, group and "\\" + group, x)
    for a, b in SPELLINGS:
        x = x.replace(a, b)
    return re.sub(NO_WORD, " ", x).strip(" ")


def canonical(text: Column, rule: str = "lines") -> Column:
    """The same form of a column."""
    x = F.translate(text, _FROM, _FROM.lower())
    for pattern, group in _RULES[rule]:
        x = F.regexp_replace(x, F.lit(pattern), F.lit(group and "$" + group))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, F.lit(NO_WORD), F.lit(" ")))


def digest(text: str, rule: str = "lines") -> str:
    return hashlib.sha256(canonical_text(text, rule).encode()).hexdigest()


def _digest(text: Column, rule: str = "lines") -> Column:
    return F.sha2(canonical(text, rule).cast("binary"), 256)


def _found(lines: Column, notices: dict[str, str], rule: str) -> Column:
    """The ids of the lines that are notices, by the digests of one rule."""
    flat = [F.lit(x) for t, i in sorted(notices.items()) for x in (digest(t, rule), i)]
    if not flat:
        return F.array().cast("array<string>")
    if all(MARK in canonical_text(t, rule) for t in notices):
        lines = F.filter(lines, lambda x: F.contains(F.translate(x, "LICEN", "licen"), F.lit(MARK)))
    by_digest = F.create_map(*flat)
    return F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, _digest(x, rule))), lambda x: x.isNotNull())


def scan(docs: DataFrame, licenses: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (of the entire text) and notice_ids (of whole lines, joined by commas)."""
    licenses = LICENSES if licenses is None else licenses
    # by text, one id for each canonical form; a notice that is a copyright line has its words as its form
    by_rule: dict[str, dict[str, tuple[str, str]]] = {"lines": {}, "none": {}}
    for i, t in (NOTICES if notices is None else notices).items():
        rule = "lines" if canonical_text(t) else "none"
        by_rule[rule][digest(t, rule)] = (t, i)
    if len(licenses) + sum(map(len, by_rule.values())) > CATALOGUE_ROWS:
        raise ValueError(f"the catalogue has more than {CATALOGUE_ROWS} rows")
    spark = docs.sparkSession
    whole, wrapped = (F.broadcast(spark.createDataFrame(sorted({digest(t, r): i for i, t in licenses.items()}.items()), f"{c} string, {n} string")) for r, c, n in (("lines", "canonical_sha256", "license_id"), ("notices", "__wrapped", "__id")))
    ids = F.concat(*[_found(F.split("text", "\n"), dict(found.values()), r) for r, found in by_rule.items()])
    # prose may be wrapped before the word copyright, so a text with such a line has a second form, without notices only
    second = F.when(F.rlike(F.translate("text", _FROM, _FROM.lower()), F.lit(COPYRIGHT_LINE)), _digest(F.col("text"), "notices"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("canonical_sha256"), second.alias("__wrapped"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(ids)), ","), F.lit("")).alias("notice_ids"))
    met = rows.join(whole, "canonical_sha256", "left").join(wrapped, "__wrapped", "left")
    return met.select("doc_id", "canonical_sha256", F.coalesce("license_id", "__id").alias("license_id"), "notice_ids")


def oracle() -> str:
    """The scan in DuckDB's SQL, with the catalogue's digests."""

    def canon(x: str) -> str:
        x = f"regexp_replace(translate({x}, '{_FROM}', '{_FROM.lower()}'), '{COPYRIGHT_LINE}', '', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"trim(regexp_replace({x}, '{NO_WORD}', ' ', 'g'), ' ')"

    values = lambda d: ", ".join(f"('{digest(t)}', '{i}')" for i, t in d.items())
    return f"""
WITH known(k, license_id) AS (VALUES {values(LICENSES)}), notices(k, id) AS (VALUES {values(NOTICES)}),
     d AS (SELECT doc_id, row_number() OVER () AS rid, text, sha256({canon("text")}) AS canonical_sha256 FROM documents),
     l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
     m AS (SELECT rid, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT rid, sha256({canon("line")}) AS k FROM l WHERE contains(translate(line, 'LICEN', 'licen'), '{MARK}')) JOIN notices USING (k) GROUP BY rid)
SELECT doc_id, canonical_sha256, license_id, coalesce(ids, '') AS notice_ids
FROM d LEFT JOIN known ON canonical_sha256 = k LEFT JOIN m USING (rid)
"""
