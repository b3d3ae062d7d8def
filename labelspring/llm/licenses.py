"""Licence scans: canonical forms of entire texts, looked up by digest.

A canonical form is in lower case, without copyright lines, with one spelling
for equivalent ones, and with a space for whatever is not a letter or digit. A
text is looked up as a whole, however it is wrapped, and so is each of its lines. NULL and empty texts
and texts of copyright lines alone have no form and match nothing. Rows are
looked up one by one, so repeated rows get equal results. Known texts without
id or form are passed over; of ids with equal forms the smallest counts. Other
columns are not looked at. Empty tables match nothing.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.llm.shared import spread_join
from labelspring.sources.scratch import cut_lineage, new_path, write_table

COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
)

#: A line that starts with (c) and no year: of a copyright, or of a list in a licence.
LIST_ITEM = r"(?m)^[^\p{L}\p{N}\n]*\(c\)[ \t]+[^0-9 \t]"
#: Copyright lines but for those.
DATED_COPYRIGHT_LINE = COPYRIGHT_LINE.replace(r"|\(c\)[ \t]|", r"|\(c\)[ \t]+[0-9]|")

#: Spellings that licence matching guidelines hold to be equivalent.
SPELLINGS = (
    (r"\(c\)|©", "copyright"),
    (r"https://", "http://"),
    (r"\b(sub)?licence", "$1license"),
    (r"\bsub[ -]license", "sublicense"),
    (r"\bnon[ -]commercial", "noncommercial"),
    (r"\borganisation", "organization"),
    (r"\bauthoris", "authoriz"),
    (r"\b(fav|hon)our", "$1or"),
    (r"\bjudgement", "judgment"),
    (r"\bcopyright holder", "copyright owner"),
    (r"\bper cent\b", "percent"),
)

#: The wording of short licences and of common notices. Whole texts are files.
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
    "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
KNOWN_LICENSES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted. " + _NO_WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. " + _NO_WARRANTY,
    ),
)


#: A part of a known text that may be missing: a title, an appendix, a list's numbers.
OPTIONAL = re.compile(r"\[\[(.*?)\]\]", re.DOTALL)


def spellings_of(text: str) -> list[str]:
    """A known text with and without each of its parts in double brackets."""
    parts = OPTIONAL.split(text)
    choices = [(part, "") if k % 2 else (part,) for k, part in enumerate(parts)]
    return ["".join(chosen) for chosen in product(*choices)]


def license_texts() -> list[tuple[str, str]]:
    """``license_id, text`` of the whole licence texts in the package, in all their spellings."""
    known = []
    for file in sorted((files("labelspring.llm") / "license_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            text = file.read_text(encoding="utf-8")
            known += [(file.name.removesuffix(".txt"), one) for one in spellings_of(text)]
    return known


def canonical_lines(text: Column, dropped: str = COPYRIGHT_LINE) -> Column:
    """The canonical forms of the lines that have one."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "\r\n?", "\n"), dropped, "")
    spelt = reduce(lambda t, pair: F.regexp_replace(t, *pair), SPELLINGS, plain)
    spaced = F.regexp_replace(spelt, r"[^\p{L}\p{N}\n]+", " ")
    lines = F.transform(F.split(F.coalesce(spaced, F.lit("")), "\n"), lambda line: F.btrim(line))
    return F.filter(lines, lambda line: F.length(line) > 0)


def digest(form: Column) -> Column:
    return F.when(F.length(form) > 0, F.sha2(F.encode(form, "UTF-8"), 256))


def _unwrapped(lines: Column) -> Column:
    """A whole text's form that its line breaks do not change: no spelling ends at one."""
    spaced = [pair for pair in SPELLINGS if " " in pair[0]]
    return reduce(lambda t, pair: F.regexp_replace(t, *pair), spaced, F.array_join(lines, " "))


def whole_digests(text: Column, lines: Column) -> Column:
    """The digests a whole text is looked up by: with list items (c) dropped as copyright lines, and not."""
    listed = F.when(
        F.lower(text).rlike(LIST_ITEM), digest(_unwrapped(canonical_lines(text, DATED_COPYRIGHT_LINE)))
    )
    return F.array_distinct(F.array_compact(F.array(digest(_unwrapped(lines)), listed)))


def known_wholes(known: DataFrame) -> DataFrame:
    """``whole, license_id`` from ``license_id, text``."""
    found = whole_digests(F.col("text"), canonical_lines(F.col("text")))
    forms = known.where("license_id is not null").select("license_id", F.explode(found).alias("whole"))
    return forms.groupBy("whole").agg(F.min("license_id").alias("license_id"))


def known_digests(known: DataFrame) -> DataFrame:
    """``digest, license_id`` from ``license_id, text``."""
    forms = known.where("license_id is not null").select(
        "license_id", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest")
    )
    return forms.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text_digest, license_id, notice_ids`` of every document.

    ``license_id`` is that of the whole text, NULL if unknown; ``notice_ids``
    lists those of its lines in order of the alphabet, once each. Forms are made
    once and only digests are written. The digests of lines are joined first and
    grouped after, by the digest of their text, so that copies count once.
    """
    spark = documents.sparkSession
    wholes = cut_lineage(known_wholes(known), "wholes")
    known = cut_lineage(known_digests(known), "known")
    formed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", canonical_lines(F.col("text")).alias("lines")
    ).select(
        "doc_id",
        digest(F.array_join("lines", " ")).alias("text_digest"),
        F.transform(whole_digests(F.col("text"), F.col("lines")), F.unhex).alias("wholes"),
        F.array_distinct(F.transform("lines", lambda line: F.unhex(digest(line)))).alias("lines"),
    )
    formed = write_table(formed, new_path(spark, "forms"))
    lines = write_table(
        formed.select("text_digest", F.explode("lines").alias("line")).distinct(), new_path(spark, "lines")
    )
    as_line = known.select(F.unhex("digest").alias("line"), F.col("license_id").alias("notice"))
    notices = (
        spread_join(lines, as_line, ["line"], "text_digest")
        .groupBy("text_digest")
        .agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notice_ids"))
    )
    as_whole = wholes.select(F.unhex("whole").alias("whole"), "license_id")
    whole = (
        formed.select("text_digest", F.explode("wholes").alias("whole"))
        .join(F.broadcast(as_whole), "whole")
        .groupBy("text_digest")
        .agg(F.min("license_id").alias("license_id"))
    )
    found = notices.join(whole, "text_digest", "full")
    texts = formed.select("doc_id", "text_digest")
    return spread_join(texts, found, ["text_digest"], "doc_id", "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids")
    )
