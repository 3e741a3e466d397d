"""License scans by canonical digest.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and white space), the
form is hashed, and the digest is joined with the digests of known licence texts, which went the same way. Whole
documents are looked up, and so is every line of a document, since notices of one line stand among other text.

Everything is made of built-in column functions. The known texts are broadcast while they are few; a longer list is
joined by a shuffle.

Known as whole documents: 0BSD, Apache-2.0, BSD-2-Clause, BSD-3-Clause, BSL-1.0, CC0-1.0, GPL-2.0, GPL-3.0, ISC, LGPL-2.1,
LGPL-3.0, MIT, MPL-2.0, Unlicense and Zlib; and one-line notices (``_SHORT_TEXTS``).

Definitions: a null text has no digest and matches nothing, nor does a form without letters or digits. If several known
texts have one form, the smallest name is reported. Lines are cut at line feeds; a repeated line counts each time.
Rows that repeat an id share their lines' matches. Copyright lines are lines that begin, behind punctuation, with a
copyright sign, or with the word followed by a sign, a year or "by", or that reserve all rights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import computed_once
from ..session import cut_lineage
from .license_texts import FULL_TEXTS

# Known texts up to this number are broadcast.
BROADCAST_TEXTS = 5000

# Equivalent spellings, applied in this order to lower-cased text.
EQUIVALENT_SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("judgement", "judgment"),
    ("https:", "http:"),
    ("&", " and "),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n©]*(?:©|\(c\)|all rights reserved|copyright +(?:\(c\)|©|[0-9<\[{]|by ))[^\n]*$"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f©]+"
# The same without the line feed.
PUNCTUATION_IN_LINES = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f©]+"

# Public licence notices and short texts.
_SHORT_TEXTS = (
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0 notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0 notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT notice", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
)

_TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "ISC": ("ISC License", "The ISC License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Zlib": ("zlib License", "The zlib License"),
}
_END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def _known_texts() -> Iterator[tuple[str, str]]:
    """The texts, and the forms in which they are commonly given: with a title, without the appendix, with bullets."""
    whole = dict(FULL_TEXTS)
    bsd = whole["BSD-3-Clause"]
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE IS")]
    whole["BSD-2-Clause"] = bsd.replace(third, "")
    for name, text in (*_SHORT_TEXTS, *whole.items()):
        forms = [text]
        if name.startswith("BSD-"):
            forms.append(re.sub(r"(?m)^[123]\. ", "* ", text))
        if _END_OF_TERMS in text:
            forms.append(text[: text.index(_END_OF_TERMS) + len(_END_OF_TERMS)])
        # The plain text comes last and so is the one that a dictionary of the texts holds.
        for form in reversed(forms):
            yield from ((name, f"{title}\n\n{form}") for title in _TITLES.get(name, ()))
            yield name, form


KNOWN_TEXTS = tuple(_known_texts())


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds; lines may keep a blank at either end."""
    form = F.lower(text)
    marked = form.contains("copyright") | form.contains("(c)") | form.contains("©") | form.contains("all rights reserved")
    form = F.when(marked, F.regexp_replace(form, COPYRIGHT_LINE, "")).otherwise(form)
    for spelling, common in EQUIVALENT_SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(common))
    return F.regexp_replace(form, PUNCTUATION_IN_LINES, " ")


def canonical(text: Column) -> Column:
    """The canonical form; empty for texts without letters and digits."""
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


def _digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """``digest``, ``license`` and the form's length for a table of known texts (``license``, ``text``)."""
    if known is None:
        known = spark.createDataFrame(KNOWN_TEXTS, "license string, text string")
    forms = known.select("license", canonical(F.col("text")).alias("form")).filter("form <> ''")
    return forms.groupBy(_digest(F.col("form")).alias("digest"), F.length("form").alias("size")).agg(
        F.min("license").alias("license")
    )


def _fits(line: Column, longest: int | None, sizes: list[int] | None) -> Column:
    """Whether a known form has this length; for long lists, whether it is not longer than all of them."""
    return F.length(line).isin(sizes) if sizes else F.length(line) <= (longest or 0)


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licences of whole texts and of single lines.

    Columns: ``doc_id``, ``digest`` (of the whole text), ``license`` (its name, or null), ``n_notices`` (lines that are
    a known text), ``notices`` (their names, sorted, joined by "; ").
    """
    digests = known_digests(documents.sparkSession, known)
    longest, count = digests.agg(F.max("size"), F.count("*")).first()
    few = count <= BROADCAST_TEXTS
    sizes = [r["size"] for r in digests.select("size").distinct().collect()] if few else None
    digests = digests.select("digest", "license")
    if few:
        digests = F.broadcast(digests)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Both look-ups use the form of the whole text, which is made once.
    texts = computed_once(texts, "form", canonical_lines(F.col("text")))
    forms = texts.select(
        "doc_id",
        _digest(F.trim(F.regexp_replace("form", "[ \n]+", " "))).alias("digest"),
        F.transform(F.split("form", "\n"), lambda line: F.trim(line)).alias("lines"),
    )
    kept = F.filter("lines", lambda line: (line != "") & _fits(line, longest, sizes))
    forms = cut_lineage(forms.select("doc_id", "digest", kept.alias("lines")), "forms")
    whole = forms.select("doc_id", "digest").join(digests, "digest", "left")
    lines = forms.select("doc_id", F.explode("lines").alias("form"))
    notices = (
        lines.select("doc_id", _digest(F.col("form")).alias("digest"))
        .join(digests, "digest")
        .groupBy("doc_id", "license")
        .agg(F.count("*").alias("n"))
        .groupBy("doc_id")
        .agg(F.sum("n").alias("n_notices"), F.concat_ws("; ", F.sort_array(F.collect_list("license"))).alias("notices"))
    )
    seen = notices.withColumnRenamed("doc_id", "noticed_id")
    return whole.join(seen, F.col("doc_id").eqNullSafe(F.col("noticed_id")), "left").select(
        "doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )


def oracle() -> str:
    """The same result over ``documents`` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        text = f"regexp_replace(lower({column}), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        for spelling, common in EQUIVALENT_SPELLINGS:
            text = f"replace({text}, {quoted(spelling)}, {quoted(common)})"
        return f"trim(regexp_replace({text}, {quoted(PUNCTUATION)}, ' ', 'g'))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN_TEXTS)
    return f"""
WITH known AS (
  SELECT sha256({form('text')}) AS digest, min(license) AS license FROM (VALUES {values}) AS v(license, text) GROUP BY 1
), whole AS (
  SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM (SELECT doc_id, {form('text')} AS form FROM documents)
), lines AS (
  SELECT doc_id, sha256(form) AS digest
  FROM (SELECT doc_id, {form('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
  WHERE form <> ''
), notices AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, '; ' ORDER BY license) AS notices
  FROM lines JOIN known USING (digest) GROUP BY doc_id
)
SELECT w.doc_id, w.digest, k.license, coalesce(n.n_notices, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.doc_id IS NOT DISTINCT FROM n.doc_id
"""
