"""Operator 6: licence scans by canonical digest lookup.

A text is made canonical - A-Z lower-cased, copyright lines dropped, everything but letters and digits read as one blank,
equivalent spellings brought to one form - and the SHA-256 of what is left is hash-joined with the digests of known
licences. The known texts pass through the same expressions. The entire text has to agree; besides, each line of a
text is looked up among the known one-line notices the same way.

Spellings are made equal by rules (-ise/-ize, -our/-or, -ence/-ense, -re/-er after t, doubled l, "copyright owner"), on
both sides, so that a rule needs no word list.

Defined results: a null text counts as empty. What has no letter or digit left matches nothing. Rows of one doc_id share
their notices; a row without doc_id gets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinclock.llm.common import lower_ascii
from twinclock.session import materialise

#: Most known texts that are broadcast: digests of 64 characters and short names, below 16 MB.
BROADCAST_TEXTS = 100_000

# Public licence texts and notices.
PERMISSION = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
              '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
              "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
              "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
              'portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
              "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
              "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
              "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
USE_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
USE_END = ('\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
           "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
           "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
           "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software.\n3. This notice may not be removed or altered from any source distribution.")
KNOWN = [
    ("MIT", "text", "MIT License\n" + PERMISSION),
    ("MIT", "text", PERMISSION),
    ("ISC", "text", USE + USE_KEEP + USE_END),
    ("0BSD", "text", USE + "." + USE_END),
    ("Zlib", "text", ZLIB),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "notice", "Released under the MIT License."),
]
#: Rules in order: pattern, what takes its place.
LINE_RULES = [(r"(^|\n)[^a-z0-9\n]*(copyright|©|\(c\))([^a-z\n]|\(c\))*[0-9][^\n]*", "$1"), (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*", "$1"),
              (r"[^a-z0-9\n\x{80}-\x{10ffff}]+", " ")]
SPELLINGS = [(r"is(e|ed|es|ing|ation|ations)( |\n|$)", "iz$1$2"), (r"([a-z]{3})our(s|able|ed|ite|)( |\n|$)", "$1or$2$3"),
             (r"enc(e|ed|es)( |\n|$)", "ens$1$2"), (r"tre(s|)( |\n|$)", "ter$1$2"), (r"ll(ed|ing)( |\n|$)", "l$1$2"),
             (r"copyright owner", "copyright holder")]


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line feeds."""
    out = lower_ascii(F.coalesce(text, F.lit("")))
    for pattern, to in LINE_RULES + SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(line: Column) -> Column:
    return F.sha2(line.cast("binary"), 256)


def known_table(spark: SparkSession, known: list[tuple[str, str, str]] = KNOWN) -> DataFrame:
    """license, kind (text or notice), text."""
    return spark.createDataFrame(known, "license string, kind string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license (of the entire text, or null), notices (sorted, comma-separated, or null)."""
    digests = known.select("license", "kind", one_line(canonical_lines(F.col("text"))).alias("line")).where("line <> ''")
    digests = digests.groupBy("kind", digest(F.col("line")).alias("known")).agg(F.min("license").alias("license"), F.max(F.length("line")).alias("size"))
    hint = F.broadcast if digests.count() <= BROADCAST_TEXTS else (lambda df: df)
    texts = digests.where("kind = 'text'").select(F.col("known").alias("canonical_sha256"), "license")
    notices = digests.where("kind = 'notice'").select(F.col("known").alias("line_sha256"), F.col("license").alias("notice"))
    longest = digests.where("kind = 'notice'").agg(F.max("size")).first()[0] or 0

    # every text is made canonical once; the digest and the few short lines are all that is kept of it. A line that is
    # longer than the longest known notice cannot equal one.
    canonical = docs.select("doc_id", canonical_lines(F.col("text")).alias("twinclock_text"))
    short = F.filter(F.transform(F.split("twinclock_text", "\n"), one_line), lambda line: (line != "") & (F.length(line) <= longest))
    rows = materialise(canonical.select("doc_id", digest(one_line(F.col("twinclock_text"))).alias("canonical_sha256"), short.alias("lines")), "licenses")
    found = rows.select("doc_id", F.explode("lines").alias("line")).select("doc_id", digest(F.col("line")).alias("line_sha256")).join(hint(notices), "line_sha256")
    found = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    return (rows.drop("lines").join(hint(texts), "canonical_sha256", "left").join(found, "doc_id", "left")
            .select("doc_id", "canonical_sha256", "license", "notices"))
