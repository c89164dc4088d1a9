"""Licence scans by digests of canonical texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.scratch import broadcast_if_small

#: Spellings that count as equal (fixed values).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("copyright holder", "copyright owner"),
    ("v2", "version 2"), ("v3", "version 3"), ("http", "https"),
]
LEVELS = ("line", "paragraph", "text")

# Notices and short licence texts (fixed values).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

#: Headings that short licence texts are given with.  Lines such as "All rights reserved." stand below some.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "All rights reserved.", "BSD 2-Clause License\nAll rights reserved."),
    "BSD-3-Clause": ("BSD 3-Clause License", "All rights reserved.", "BSD 3-Clause License\nAll rights reserved."),
}
#: Entire licence texts, one file per licence.
TEXTS = Path(__file__).with_name("license_texts")
#: Whatever follows this line of a licence tells how to apply it.
_LAST_LINE = "END OF TERMS AND CONDITIONS"


def entire_texts() -> list[tuple[str, str]]:
    """(license, text) of the licence files, and also without what follows the end of their terms.

    A heading such as "BSD 3-Clause License" above a text makes the notice one of several
    paragraphs; for that, short licences are listed under their usual headings, too.
    """
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        head, end, _ = text.partition(_LAST_LINE)
        out += [(path.stem, text), *([(path.stem, head), (path.stem, head + end)] if end else [])]
        out += [(path.stem, f"{title}\n{text}") for title in HEADINGS.get(path.stem, ())]
    return out + [(name, f"{title}\n{text}") for name, text in KNOWN for title in HEADINGS.get(name, ()) if len(text) > 500]


def _lines(text: Column) -> Column:
    """The lines in lower case, without ASCII signs and outer blanks, and without copyright lines."""
    plain = F.regexp_replace(F.lower(text), r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    kept = F.filter(F.split(plain, "\n"), lambda x: ~F.regexp_like(x, F.lit("^ *(copyright|©|c copyright|c [0-9]{4})")))
    # Not F.trim itself: with two parameters it would get the line's number as the signs to trim.
    return F.transform(kept, lambda x: F.trim(x))


def _spelled(text: Column) -> Column:
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(out)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no ASCII signs, single blanks, one spelling."""
    return _spelled(_whole(_lines(text)))


#: Up to so many different lengths of known texts, units of other lengths are left out before hashing.
MAX_LENGTHS = 1000


def scan_licenses(df: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, level, places): licences that a whole text, or a whole line or paragraph of it, is.

    ``known`` has (license string, license_text string).  Entire texts are brought to canonical form
    and hashed; equal SHA-256 digests are equal texts.  A unit is the text, each paragraph (between
    lines without letters and digits) and each line, so that notices inside a document are found,
    too; ``level`` is the largest unit that matched and ``places`` how many units of that level did.

    Units of a text are hashed where the text is, if their length is one that a known text has; only
    digests meet the known ones, which are broadcast up to a checked number and joined by shuffle
    beyond it.  Null, empty and signs-only texts and units match nothing.  Rows with a null key are
    left out, repeated rows count again in ``places``.  Empty tables give an empty result; other
    columns are ignored.
    """
    listed = known.where("license is not null and license_text is not null").select("license", canonical(F.col("license_text")).alias("_c")).where("_c <> ''")
    lengths = [r[0] for r in listed.select(F.length("_c")).distinct().limit(MAX_LENGTHS + 1).collect()]
    listed = broadcast_if_small(listed.select("license", F.sha2("_c", 256).alias("_digest")).distinct())

    def units(level, parts):
        return F.transform(parts, lambda u: F.struct(F.lit(level).alias("level"), _spelled(u).alias("unit")))

    lines = F.col("_lines")
    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda p: p != "")
    joined = F.transform(paragraphs, lambda p: F.trim(F.translate(p, "\n", " ")))
    every = F.concat(units(0, lines), F.when(F.size(joined) > 1, units(1, joined)).otherwise(units(1, F.array().cast("array<string>"))), units(2, F.array(_whole(lines))))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), _lines(F.col(text)).alias("_lines"))
    cut = rows.select("_key", F.explode(every).alias("u")).select("_key", "u.level", "u.unit")
    if len(lengths) <= MAX_LENGTHS:
        cut = cut.where(F.length("unit").isin(lengths))
    found = cut.withColumn("_digest", F.sha2("unit", 256)).join(listed, "_digest").groupBy("_key", "license", "level").agg(F.count("*").alias("places"))
    best = found.groupBy("_key", "license").agg(F.max(F.struct("level", "places")).alias("b"))
    return best.select(
        F.col("_key").alias(key), "license", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("b.level") + 1).alias("level"), F.col("b.places").alias("places"),
    )
