"""Licence scan by canonical digest: texts are normalised and hash-joined to known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and customary notices, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = _BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: (identifier, entire text).  A licence may have several texts: its full text and the notices that stand for it.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ZERO_BSD),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
]
#: Whole texts, one file for each identifier; a copy may end with the terms, without the advice on how to apply them.
TERMS_END = "END OF TERMS AND CONDITIONS"
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    _text = _file.read_text(encoding="utf-8")
    _terms, _end, _ = _text.partition(TERMS_END)
    KNOWN += [(_file.stem, x) for x in {_text, _terms + _end, _terms}]
#: Spellings that count as equal, applied to normalised text in this order.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("noncommercial", "non commercial"),
    ("sublicense", "sub license"),
    ("while", "whilst"),
    ("copyright owner", "copyright holder"),
]
#: A line that names the holder of a copyright, in a comment or not, says nothing about which licence it is.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(©]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|the[ \t][^\n]*(authors|contributors))|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def normalised(line: Column) -> Column:
    """One line in canonical form: lower case, no copyright line, one space between words, one spelling."""
    out = F.regexp_replace(F.lower(line), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the canonical form of each known text; one row for each distinct digest."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "license string, text string")
    return rows.select(F.md5(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", most_known: int = 100_000) -> DataFrame:
    """Finds known licences by the digest of entire texts.

    Two kinds of unit are looked up whole: the document, and each of its lines
    (a notice stands on a line of its own).  Returns one row for each row of
    ``docs``: id, ``license`` (of the whole document, else null), ``notices``
    (sorted distinct licences of its lines, comma-joined; empty if none) and
    ``n_notices`` (lines that are a notice).  Null and empty texts match
    nothing; repeated rows each give a row; other columns are not looked at.
    The licence table is broadcast after a check that it has at most
    ``most_known`` rows.
    """
    if known is not None and len(known) > most_known:
        raise ValueError(f"more than {most_known} known texts")
    table = known_digests(docs.sparkSession, known)
    units = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines")
    ).select("id", "row", F.posexplode(F.concat(F.array(F.array_join("lines", " ")), "lines")).alias("place", "unit"))
    found = (
        units.select("id", "row", "place", F.when(F.col("unit") != "", F.md5("unit")).alias("digest"))
        .join(F.broadcast(table), "digest", "left")
        .where((F.col("place") == 0) | F.col("license").isNotNull())
    )
    line = F.when(F.col("place") > 0, F.col("license"))
    return (
        found.groupBy("row", "id")
        .agg(
            F.max(F.when(F.col("place") == 0, F.col("license"))).alias("license"),
            F.array_join(F.sort_array(F.collect_set(line)), ",").alias("notices"),
            F.count(line).alias("n_notices"),
        )
        .select(F.col("id").alias(id_col), "license", "notices", "n_notices")
    )
