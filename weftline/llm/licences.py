"""Licence scan by canonical digest (DataFrame operations only).

A text is brought to a canonical form - lower case, without lines that only claim copyright or name
the MIT, ISC or a BSD licence as a title, punctuation and white
space as single spaces, equivalent spellings made one - and the digest of the whole form is joined to the digests of
known licence texts, which get the same form. The same is done with single lines that speak of a licence, to find
notices inside other texts.

Known texts are a table of any size; without one, it is made of KNOWN and the files of licence_texts. Digests are joined,
and Spark broadcasts the smaller side if it is small. A claim of copyright is
(c), a year or "by" after the word, or a line that ends like a holder's name; a claim without "all rights reserved" on one
line with the licence itself has no end that shows, so that line stays as it is.

Defined results: whole texts count, however long; a null or empty text has an empty canonical form and no licence; repeated rows are looked up each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import materialise

# fixed values: texts of public licences and the usual notices
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS"
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("THIS SOFTWARE IS", _THIRD, 1)
KNOWN |= {x.stem: x.read_text(encoding="utf-8") for x in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
# fixed values: spellings that mean the same, after punctuation has become spaces
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencee", "licensee"), ("licencees", "licensees"), ("licencor", "licensor"), ("licencors", "licensors"), ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicenced", "sublicensed"), ("sublicencing", "sublicensing"), ("sublicencees", "sublicensees"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"))
_CLAIM = r"copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4}|yyyy|by )[^\n]{0,150}?(all rights reserved|$)|(©|\(c\))[^\n]{0,40}$"
_HOLDER = r"copyright [^\n]{0,80}(authors|inc|ltd|llc|all rights reserved)[^\p{L}\p{N}\n]*$|all rights reserved[^\p{L}\p{N}\n]*$"
_TITLE = r"(the )?(mit|isc|((simplified|new|revised|modified) )?bsd|bsd[ -][23][ -]clause)( [^\p{L}\p{N}\n]?(simplified|new|revised|modified)[^\p{L}\p{N}\n]?)? licen[cs]e( \([^)\n]{0,40}\))?[^\p{L}\p{N}\n]*$"
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*({_CLAIM}|{_HOLDER}|{_TITLE})"


def canonical(text: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    # every word gets two spaces of its own, so that spellings are replaced as whole words
    x = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(" " + a.replace(" ", "  ") + " "), F.lit(" " + b + " "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def known_digests(known: DataFrame) -> DataFrame:
    """licence_id, digest of each known text (licence_id, text); of texts with one form the smallest id counts."""
    forms = known.select("licence_id", F.md5(canonical(F.col("text")).cast("binary")).alias("digest"))
    return forms.groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def known_licences(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """The known texts of this module as a table."""
    return spark.createDataFrame(list((known or KNOWN).items()), "licence_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical_chars, digest (of the whole canonical text), licence_id (or null) and notices (of its lines).

    known: a table of any size with licence_id and text.
    """
    table = materialise(known_digests(known if known is not None else known_licences(docs.sparkSession)), "licence-digests")
    same = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    # single lines: those that hit are few, and go back to the rows by the text's digest
    lines = docs.filter(F.col(text_col).rlike("(?i)licen[cs]e")).select(same.alias("same"), F.explode(F.split(text_col, "\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike("(?i)licen[cs]e")).select("same", F.md5(canonical(F.col("line")).cast("binary")).alias("digest"))
    notices = lines.join(table, "digest").groupBy("same").agg(F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("notices"))
    notices = materialise(notices, "licence-notices")
    slim = docs.select(F.col(id_col), same.alias("same"), canonical(F.col(text_col)).alias("__form"))
    slim = slim.select(id_col, "same", F.length("__form").cast("long").alias("canonical_chars"), F.md5(F.col("__form").cast("binary")).alias("digest"))
    out = slim.join(table, "digest", "left").join(notices, "same", "left")
    return out.select(id_col, "canonical_chars", "digest", "licence_id", F.coalesce("notices", F.lit("")).alias("notices"))
