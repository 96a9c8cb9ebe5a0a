"""Licence scans by digests of canonical texts.

A text is brought to a canonical form: lower case, lines of copyright notices
removed, equivalent spellings unified, everything but Latin letters and digits
turned into single spaces. The digest of the form is looked up among the digests
of known texts in a hash join, once for the entire text and once for each of its lines.

Scale: texts are read, never moved; only lines that hit go on. The known digests
are a table of any size, which Spark broadcasts when its own estimate allows.

Defined results: a null text counts as empty; an empty canonical form matches
nothing. A text that matches several names gets the first one in order. Rows
with equal ids (null included) share the licences of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import small_table

# Spellings that count as equal, each as found and as written in the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("sub-licen", "sublicen"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https:", "http:"),
)
COPYRIGHT_LINE = r"(?m)^[^\n]*(?:copyright [0-9(]|copyright ©|\(c\) [0-9]|© ?[0-9]|all rights reserved)[^\n]*"

# The known texts, notices and short licences in full.
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT_MIT),
    ("MIT", "MIT License\n\n" + _GRANT_MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS_ISC),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    form = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    for found, written in SPELLINGS:
        form = F.replace(form, F.lit(found), F.lit(written))
    return F.trim(F.regexp_replace(form, "[^a-z0-9]+", " "))


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """Columns digest and license of known (name, text) pairs, the first name for equal digests."""
    table = small_table(spark, [tuple(k) for k in known], "license string, text string")
    return table.where(canonical(F.col("text")) != "").groupBy(canonical_digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, digest of the canonical text, license of the entire text, line_licenses and n_license_lines.

    ``known`` has the columns digest and license, one row per digest.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = rows.select("id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    hits = lines.select("id", canonical_digest(F.col("line")).alias("digest")).join(known, "digest")
    by_id = hits.groupBy(F.col("id").alias("of")).agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("n")
    )
    whole = rows.select("id", canonical_digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    return whole.join(by_id, whole["id"].eqNullSafe(by_id["of"]), "left").select(
        F.col("id").alias(id_column),
        "digest",
        "license",
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
    )
