"""License scans: canonical digests of texts and lines, looked up among digests of known licences. DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# Licence texts and notices by SPDX identifier.
NOTICES = {
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
}
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
}
#: Whole texts, each with a title as its first paragraph, named SPDX identifier[.variant].txt.
FOLDER = Path(__file__).parent / "license_texts"
#: What follows this line of a text isn't always copied with it.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"), ("per cent", "percent")]
#: Words of a copyright holder's name and address at most.
HOLDER = 40
#: A copyright statement: the word with its sign, or either with a year, and the holder up to the end of the paragraph or to where terms begin, which stays. Line breaks don't matter.
COPYRIGHT = (
    r"(?i)(?:copyright\s*(?:\(c\)|©)|(?:copyright|\(c\)|©)\s*,?\s*[<\[{]?(?:[12][0-9]{3}|year|yyyy|4-digit))\S*(?:(?:[ \t\r]+|[ \t\r]*\n[ \t\r]*)\S+){0,%d}?"
    r"(\s*\n[ \t\r]*\n|\s*\z|\s+(?:permission|redistribution|everyone|licensed|this\s+(?:program|library|software|file|work))\b)" % HOLDER
)
RESERVED = r"(?i)all\s+rights\s+reserved"
#: Runs of anything but letters and digits.
GAPS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright statements, one space for each run of punctuation and space, one spelling."""
    out = F.regexp_replace(F.regexp_replace(text, COPYRIGHT, " $1 "), RESERVED, " ")
    out = F.trim(F.regexp_replace(ascii_lower(out), GAPS, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_sql(text: str) -> str:
    """canonical() as DuckDB SQL."""
    out = f"regexp_replace(regexp_replace({text}, '{COPYRIGHT}', ' \\1 ', 'g'), '{RESERVED}', ' ', 'g')"
    out = f"trim(regexp_replace(translate({out}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAPS}', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _known(text: str) -> str:
    """digest() of a known text, which has only ASCII characters."""
    out = re.sub(RESERVED, " ", re.sub(COPYRIGHT.replace(r"\z", r"\Z"), r" \1 ", text, flags=re.ASCII))
    out = re.sub(r"[^a-z0-9]+", " ", out.lower()).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return hashlib.sha256(out.encode()).hexdigest()


def known(spark: SparkSession, *kinds: dict) -> DataFrame:
    """(digest, license) of the known texts: a constant table."""
    rows = {_known(t): name for kind in kinds for name, texts in kind.items() for t in ([texts] if isinstance(texts, str) else texts)}
    return spark.createDataFrame(sorted(rows.items()), "digest string, license string")


def bundled_texts() -> list[tuple[str, str]]:
    """(license, text) of the bundled whole texts: MIT, ISC, which stands for its author's name as well, and those in FOLDER."""
    files = [(re.sub(r"(\.university)?\.txt$", "", f.name), f.read_text("utf-8")) for f in sorted(FOLDER.glob("*.txt"))]
    return [*TEXTS.items(), ("ISC", TEXTS["ISC"].replace("THE AUTHOR", "ISC")), *files]


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bundled_texts(), "license string, text string")


def known_texts(texts: DataFrame) -> DataFrame:
    """(digest, license) of whole texts (license, text): with and without the first paragraph, and what follows the terms. One row a digest."""
    start = F.regexp_replace("text", r"^\s+", "")
    short = F.when(F.contains(start, F.lit(END_OF_TERMS)), F.concat(F.substring_index(start, END_OF_TERMS, 1), F.lit(END_OF_TERMS)))
    bare = F.when(F.contains(start, F.lit(END_OF_TERMS)), F.substring_index(start, END_OF_TERMS, 1))
    forms = texts.select("license", F.explode(F.array(start, short, bare)).alias("form")).where("form is not null")
    untitled = F.when(F.col("form").rlike(r"\n[ \t\r]*\n"), F.regexp_replace("form", r"^(?s:.*?)\n[ \t\r]*\n", ""))
    forms = forms.select("license", F.explode(F.array("form", untitled)).alias("form")).where("form is not null")
    # a text that is nothing but a title has the digest of the empty text without it
    return forms.where(canonical(F.col("form")) != "").groupBy(digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"))


def notice_map() -> dict[str, str]:
    return {_known(t): name for name, texts in NOTICES.items() for t in texts}


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the entire canonical text, license that has this digest, and the notices among its lines.

    notices: SPDX identifiers of lines that are known notices, sorted and joined by commas, empty
    if there are none; n_notices: how many such lines. Null and empty texts have the digest of the
    empty text, no license and no notices. Rows are kept one for one. texts: a table (license, text)
    of the known whole texts; without one, the bundled ones, few enough to be broadcast. Notices that
    are a whole document are known as well.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in sorted(notice_map().items()) for x in pair])
    likely = F.filter(F.split(text, "\n"), lambda line: line.rlike("(?i)licen[sc]"))
    notices = F.filter(F.transform(likely, lambda line: F.element_at(table, digest(line))), lambda x: x.isNotNull())
    out = docs.select("doc_id", digest(text).alias("digest"), notices.alias("found"))
    whole = known_texts(bundled(spark) if texts is None else texts).union(known(spark, NOTICES)).groupBy("digest").agg(F.min("license").alias("license"))
    out = out.join(F.broadcast(whole) if texts is None else whole, "digest", "left")
    return out.select("doc_id", "digest", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def _forms(text: str) -> list[str]:
    """The forms of known_texts() of one bundled text."""
    out = [text.lstrip()]
    if END_OF_TERMS in out[0]:
        terms = out[0].split(END_OF_TERMS)[0]
        out += [terms + END_OF_TERMS, terms]
    return out + [re.split(r"\n[ \t\r]*\n", form, maxsplit=1)[1] for form in out if re.search(r"\n[ \t\r]*\n", form)]


def oracle_sql() -> str:
    whole: dict[str, str] = {}
    for name, text in [*((name, form) for name, text in bundled_texts() for form in _forms(text)), *((name, t) for name, texts in NOTICES.items() for t in texts)]:
        whole[_known(text)] = min(name, whole.get(_known(text), name))
    whole.pop(hashlib.sha256(b"").hexdigest(), None)
    rows = ", ".join(f"('{d}', '{n}')" for d, n in sorted(whole.items()))
    lines = ", ".join(f"('{d}', '{n}')" for d, n in sorted(notice_map().items()))
    return f"""
    WITH known(digest, license) AS (VALUES {rows}), notice(digest, license) AS (VALUES {lines}),
    texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS (SELECT l.doc_id, string_agg(DISTINCT n.license, ',' ORDER BY n.license) AS notices, count(*) AS n_notices
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) l
              JOIN notice n ON sha256({canonical_sql('l.line')}) = n.digest WHERE regexp_matches(l.line, '(?i)licen[sc]') GROUP BY 1)
    SELECT t.doc_id, sha256({canonical_sql('t.text')}) AS digest, k.license, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
    FROM texts t LEFT JOIN known k ON sha256({canonical_sql('t.text')}) = k.digest LEFT JOIN found f ON f.doc_id = t.doc_id
    """
