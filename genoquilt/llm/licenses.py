"""License scans by canonical digest: texts are normalised and hash-joined to the digests of known licences.

The canonical form is lower case, drops copyright statements (a year, a sign or, at the start of a paragraph, a name after the
word), spells equivalent words and versions one way, and turns all
but letters and digits into single spaces. Entire texts are hash-joined to the bounded table of known forms by their digest.
Each line is a second unit (a notice within a document): its digest is looked up in the set of known ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Equivalent spellings of whole words, replaced in this order.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("colour", "color"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("sub license", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("https", "http"),
]
#: Versions: "version 2.0", "v2.0", "version 2" and "v2" are all 2 0.
VERSIONS = [(f"{word}{n} {part}", f"{n} {part}") for n in "1234" for part in "01" for word in ("version ", "v")]
VERSIONS += [(f"{word}{n}", f"{n} 0") for n in "234" for word in ("version ", "v")]

#: Short notices and short licences, by SPDX identifier, as their publishers word them.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]

#: Full texts of short licences, without titles and copyright statements, and the titles they go by.
_MIT = next(t for i, t in NOTICES if t.startswith("MIT License")).split("\n\n", 2)[2]
_0BSD = next(t for i, t in NOTICES if i == "0BSD")
_ISC = _0BSD.replace("is hereby granted.", "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _bsd(clauses: int) -> list[str]:
    """The text with numbered and with marked clauses, and with either number of the holder in the disclaimer."""
    lists = [" ".join(f"{n + 1}. {c}" if numbered else c for n, c in enumerate(_BSD[:clauses])) for numbered in (True, False)]
    return [f"{_BSD_HEAD} {x} {t}" for x in lists for t in (_BSD_TAIL, _BSD_TAIL.replace("HOLDER OR", "HOLDERS OR"), _BSD_TAIL.replace("HOLDER OR", "OWNER OR"))]


_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MORE = "For more information, please refer to <https://unlicense.org/>"

TEXTS = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], [_MIT]),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause License"], [_0BSD]),
    ("ISC", ["ISC License", "The ISC License", "ISC License (ISC)"], [_ISC, _ISC.replace("and/or distribute", "and distribute")]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"], _bsd(2)),
    ("BSD-3-Clause", ["BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"], _bsd(3)),
    ("Unlicense", ["The Unlicense", "Unlicense"], [_UNLICENSE, f"{_UNLICENSE} {_MORE}", f"{_UNLICENSE} {_MORE.rstrip('/>')}"]),
]

#: SHA-256 of the canonical form of long licence texts (Debian's /usr/share/common-licenses).
DIGESTS: dict[str, str] = {
    "bebc0974f0c6e7ff459bdb2f690fc5954a1b85721c2f8d4d14c1b1b36c95aeb4": "Apache-2.0",
    "46511498b7f84d5e9cecb77e4ff892243bbc369402778c7b7718ff114a349b62": "Apache-2.0",
    "82c3372e6c46ee6860b6f7e8795385b2f852f6f2f09ec44ef6d48071f6f92c7b": "Apache-2.0",
    "795f9bb1bf2c1f6524cdb7fad0ead517490a53781c3a6f01c07e45da0e6c1687": "Artistic-1.0-Perl",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd": "GFDL-1.2-only",
    "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd": "GFDL-1.3-only",
    "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f": "GPL-1.0-only",
    "9b2bfed4a167ee57b9fdbf97f9086c5deda7d711d6e6fcdb4d978b468558a080": "GPL-2.0-only",
    "9c1d95c42937ba735a5bfd8101dc3e4d1ed596038b05f22be654e627c2ab4be2": "GPL-3.0-only",
    "0a9aff3f657f9d838df7020765ae99578ded18aebb915198c9a38e1d7521ced7": "LGPL-2.0-only",
    "e2943f5da7ef6b3add61b3d7bef4f639bff6720238c6ff35e5bc66aa2717d0da": "LGPL-2.1-only",
    "03537efc9e8cdf64e4b5cde6ce3c38e080e6acf7952692e0abe3616ac667ae0b": "LGPL-3.0-only",
    "1eebcbe820cf327b930dce7adaf607e89a5938e1c82a750538cf203310f07752": "MPL-1.1",
    "62aa6121738c213ee6d4023a5f1f4d76fd550ca7234c4000bc8e81d41116ac7f": "MPL-2.0",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
}

#: Fixed value: a copyright statement of the lower-cased text, to the end of its line or to the words a licence begins with.
STATEMENT = (
    r"(?m)(?:(?:^|(?<=licen[sc]e[ )]))[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|\d{4}|[<\[{(] ?(?:year|yyyy))|\(c\)[ \t]*(?:copyright|\d{4}|[<\[{(] ?(?:year|yyyy))|©)"
    r"|(?:\A|(?<=\n\n))[ \t]*copyright[ \t:]+(?!(?:holders?|owners?|notices?|laws?|licen[sc]es?|interests?|statements?|and|or|in|of|is|on|to)\b)\p{L})"
    r"[^\n]*?(?=permission is hereby granted|permission to use|redistribution and use|all rights reserved|licensed under the|$)(?:\s*all rights reserved\b)?"
)


#: What a text with a copyright statement holds; others are not searched for one.
STATEMENT_MARKS = ("copyright", "(c)", "©")
SEPARATOR, SEPARATOR_IN_LINE = r"[^\p{L}\p{N}]+", r"[^\p{L}\p{N}\n]+"


def _spelled(words: Column) -> Column:
    """Words that have two blanks around them, in their one spelling: rules meet whole words, also one after the other."""
    wide = lambda text: F.lit(f"  {text.replace(' ', '  ')}  ")
    for a, b in SPELLINGS:
        words = F.replace(words, wide(a), wide(b))
    return words


def _versioned(words: Column) -> Column:
    wide = lambda text: F.lit(f"  {text.replace(' ', '  ')}  ")
    out = words
    for a, b in VERSIONS:
        out = F.replace(out, wide(a), wide(b))
    marks = F.contains(words, F.lit("  version  "))
    for n in "1234":
        marks = marks | F.contains(words, F.lit(f"  v{n}  "))
    return F.when(marks, out).otherwise(words)


def with_forms(df: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with the canonical form of the entire text and the array of those of its lines, and the names of both."""
    whole, lines = fresh(df, "_whole"), fresh(df, "_lines")
    pad = lambda c: F.concat(F.lit("  "), c, F.lit("  "))
    marked = F.lit(False)
    for mark in STATEMENT_MARKS:
        marked = marked | F.contains(F.col(lines), F.lit(mark))
    # step by step, so that no step is computed twice
    df = df.withColumn(lines, F.lower(text_col))
    df = df.withColumn(lines, F.when(marked, F.regexp_replace(lines, STATEMENT, " ")).otherwise(F.col(lines)))
    df = df.withColumns({whole: pad(F.regexp_replace(lines, SEPARATOR, "  ")), lines: pad(F.replace(F.regexp_replace(lines, SEPARATOR_IN_LINE, "  "), F.lit("\n"), F.lit("  \n  ")))})
    df = df.withColumns({c: _spelled(F.col(c)) for c in (whole, lines)})
    df = df.withColumns({c: F.replace(_versioned(F.col(c)), F.lit("  "), F.lit(" ")) for c in (whole, lines)})
    return df.withColumns({whole: F.trim(whole), lines: F.transform(F.split(lines, "\n"), lambda x: F.trim(x))}), whole, lines


def known_digests(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(digest, license): one row a canonical form, of the notices, the full texts with each of their titles and without, and the
    long texts; its size is that of these lists."""
    texts = [(i, f"{title}\n\n{body}") for i, titles, bodies in TEXTS for title in ["", *titles] for body in bodies]
    rows, whole, _ = with_forms(spark.createDataFrame([*notices, *texts], "license string, text string"), "text")
    digests = rows.select(F.sha2(whole, 256).alias("digest"), "license")
    long = spark.createDataFrame([(d, i) for d, i in DIGESTS.items()], "digest string, license string")
    return digests.unionByName(long).groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, text_license, line_licenses array<string>, n_lines long) for each row.

    ``text_license``: the licence whose digest the entire text has, else null. ``line_licenses``: sorted distinct
    licences of its lines, ``n_lines`` the number of lines that hit. A null text has null digest and no hits; a text
    or line without letters and digits hits nothing. Rows are kept as they are, repeated ones and null ids too. Other columns
    are ignored. An empty table gives no rows.

    ``known`` is a bounded list with one row a digest: it is broadcast to the hash join, and its digests are one
    array of the plan for the lines, of which only those that hit are looked up.
    """
    names = {r["digest"]: r["license"] for r in known.collect()}
    empty = F.sha2(F.lit(""), 256)
    rows, whole, lines = with_forms(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    digests = F.transform(lines, lambda x: F.sha2(x, 256))
    rows = rows.select("id", F.sha2(whole, 256).alias("text_digest"), F.coalesce(digests, F.array().cast("array<string>")).alias("digests"))
    listed = F.array(*map(F.lit, sorted(names))) if names else F.array().cast("array<string>")
    rows = rows.withColumn("hits", F.array_except(F.array_intersect("digests", listed), F.array(empty)))
    of = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]) if names else F.expr("cast(map() as map<string,string>)")
    n_lines = F.when(F.size("hits") > 0, F.size(F.filter("digests", lambda d: F.array_contains("hits", d)))).otherwise(0)
    table = known.where(F.col("digest") != empty).select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))
    out = rows.join(F.broadcast(table), "text_digest", "left")
    found = F.array_sort(F.array_distinct(F.transform("hits", lambda d: F.try_element_at(of, d))))
    return out.select(F.col("id").alias(id_col), "text_digest", "text_license", found.alias("line_licenses"), n_lines.cast("long").alias("n_lines"))
