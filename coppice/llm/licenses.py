"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to canonical form (case, equivalent spellings, copyright lines, punctuation, white space) and its
SHA-256 is looked up among the digests of known licence texts: whole documents, and within them whole lines and whole
blocks between lines without letters or digits, as licence notices and file headers are. The known digests are bounded by
this file (LICENSES, NAMES, SPDX and WHOLE), so the lookup is a broadcast hash join. The texts are read once, for a table
of digests that both lookups read.

Null and empty texts, and texts of which the canonical form is empty, have no digest and match nothing. Equal lines
and blocks count each time; a block of one line counts as that line. Ties cannot be: a canonical form has one licence. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# Steps to the canonical form, in order, on lower-case text: what a text must hold for the step to change
# anything, pattern, and what takes its place. The same patterns serve Spark and DuckDB.
STEPS = (
    (("copyright", "©", "(c)"), r"(?m)^[^a-z0-9\n]*(copyright|©|\(c\))[^\n]*$", " "),
    (("all rights reserved",), r"all rights reserved", " "),
    (("licen",), r"licence|licens(?:e|ing)?\b", "license"),
    (("http",), r"https?://(?:www\.)?", "http "),
    (("sub-license",), r"sub-license", "sublicense"),
    (("non-commercial",), r"non-commercial", "noncommercial"),
    (("organis",), r"organis", "organiz"),
    (("&",), r"&", " and "),
    ((), r"[^a-z0-9]+", " "),
    (("version",), r"\bversion\b ?", ""),
    ((), r"( |^)v(?:er)? ?([0-9])", "{1}{2}"),
)
#: Every known text holds one of these, and no step takes them away; other lines need not be brought to canonical form.
MARKS = ("licen", "permission", "redistribution", "cc0")

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

# Fixed values: (licence, text). Whole licences, file notices and one-line notices.
LICENSES = (
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


_GNU_NOTICE = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."""
_GNU_NOTICE_2 = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

# Paragraphs that stand for their licence in file headers.
HEADERS = (
    ("MIT", _MIT_GRANT.split("\n\n")[0]),
    ("ISC", _ISC.split("\n\n")[0]),
    ("Apache-2.0", _APACHE_NOTICE.split(" You may obtain")[0]),
    ("Apache-2.0", _APACHE_NOTICE.split("\n\n")[0]),
    ("MPL-2.0", _MPL_NOTICE),
    *((name, text.format(what=what, kind=kind, n=n)) for text in (_GNU_NOTICE, _GNU_NOTICE_2) for what in ("program", "library", "file", "software") for name, kind, n in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))),
)
# Licences by the names that notices use, and the words before them.
NAMES = (("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("MPL-2.0", "Mozilla Public License, v. 2.0"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"))
BEFORE_NAMES = ("Licensed under the", "Released under the", "Distributed under the", "This project is licensed under the", "This work is licensed under the", "This software is released under the")
# Identifiers; those of SUFFIXED come with -only and -or-later too.
SPDX = ("MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Unlicense", "BSL-1.0", "Zlib", "0BSD", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "Artistic-2.0", "WTFPL")
SUFFIXED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")

#: Every known text, of one canonical form one.
TEXTS = (
    *LICENSES,
    *HEADERS,
    *((name, f"{before} {full}.") for before in BEFORE_NAMES for name, full in NAMES),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in SUFFIXED for end in ("", "-only", "-or-later")),
)

# Digests of the canonical forms of whole licences, too long to stand here.
WHOLE = (
    ("Apache-2.0", "51907d72c705b03b33701e9993cb06a389e965828774169390dae9be4c155dc3"),
    ("Artistic-1.0", "e6e0a89c729d8b6f73de6a0422b960ddab89445ac9ad91383c9feda4dd0e3315"),
    ("CC0-1.0", "1815b1711bbecf90bd98e97f2ff2a61169506a4a1ebecf48acdffee888c3c49c"),
    ("GFDL-1.2", "2830bad988bfc93f7e00327a02dafd05695bf13a853ec12ea311723e0fec6906"),
    ("GFDL-1.3", "a51149a11d9b6050733574496865649911eabaf1772d7fbdec2e14684f1f7a2c"),
    ("GPL-1.0", "34689847814d26aa2a840990ec5a779ad163650dd652ca094a2bbd453585ae2c"),
    ("GPL-2.0", "cf4949400245e178889bb83d374a36ead3ddb5585951e610b62d23b7739aca19"),
    ("GPL-3.0", "4e4b67c99ea66cfdd15659df39fd50435d331ea292921efd3831d36168355d48"),
    ("LGPL-2.0", "4705404fff12e98fdada2c9702c564860ef59de3f974b6df3e9f40b69389d0d8"),
    ("LGPL-2.1", "e7c7404c25d2838a1815e0e72ba9ff97aa6a676e591c22ac9c64aeff5d3c379f"),
    ("LGPL-3.0", "6b7235d3fb71e3e003c181b2c4040028d4a5fe17bb00b1f21e7bbf9582ca9de5"),
    ("MPL-1.1", "c9dcabdd3abc515251733396d6f192bd91161b920538d7b4554a39dbc2bf8aa1"),
    ("MPL-2.0", "aeefd73d77e9d85a4883a5771472108d171f1febdc11389435ea2e43ba975037"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
)
#: What parts blocks, and a block of two lines or more.
BETWEEN, SEVERAL = r"\n[^A-Za-z0-9\n]*\n", r"[A-Za-z0-9][^\n]*\n[^\n]*[A-Za-z0-9]"


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where that is empty. Lambdas name what each step has made, so that it is made once."""

    def once(x: Column, f) -> Column:
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def step(needs: tuple[str, ...], pattern: str, by: str):
        def change(x: Column) -> Column:
            changed = F.regexp_replace(x, pattern, by.replace("{1}", "$1").replace("{2}", "$2"))
            return F.when(reduce(lambda a, b: a | b, (F.contains(x, F.lit(n)) for n in needs)), changed).otherwise(x) if needs else changed

        return change

    out = F.lower(text)
    for s in STEPS:
        out = once(out, step(*s))
    return once(F.trim(out), lambda x: F.when(x != "", F.sha2(x, 256)))


def known_digests(spark: SparkSession) -> DataFrame:
    """(known_digest, license), a row for each canonical form."""
    if not all(any(m in text.lower() for m in MARKS) for _, text in TEXTS):
        raise ValueError("a known text holds none of MARKS")
    every = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in TEXTS))
    rows = spark.range(1).select(F.explode(every).alias("x")).select(digest(F.col("x.text")).alias("known_digest"), "x.license")
    whole = F.array(*(F.struct(F.lit(d).alias("known_digest"), F.lit(name).alias("license")) for name, d in WHOLE))
    both = rows.unionByName(spark.range(1).select(F.inline(whole)))
    return both.groupBy("known_digest").agg(F.min("license").alias("license"))


def marked(x: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(m)) for m in MARKS))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license (of the whole text), n_notices and notices (licences of whole lines and blocks) of every row."""
    known = F.broadcast(known_digests(docs.sparkSession))  # bounded by this file
    lines = F.filter(F.split("text", "\n"), marked)
    blocks = F.filter(F.split("text", BETWEEN), lambda x: marked(x) & x.rlike(SEVERAL))
    pieces = F.when(marked(F.col("text")), F.transform(F.concat(lines, blocks), digest))
    rows = materialise(docs.select("doc_id", digest(F.col("text")).alias("digest"), pieces.alias("_pieces"), F.monotonically_increasing_id().alias("_row")))
    hits = rows.select("_row", F.explode("_pieces").alias("known_digest")).join(known, "known_digest")
    notices = hits.groupBy("_row").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    whole = rows.select("_row", "doc_id", "digest").join(known, F.col("digest") == F.col("known_digest"), "left")
    return whole.join(notices, "_row", "left").select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    out = f"lower({text})"
    for _, pattern, by in STEPS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), by.replace("{1}", "\\1").replace("{2}", "\\2"))
    return f"trim({out})"


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEXTS)
    whole = ", ".join(f"('{d}', '{n}')" for n, d in WHOLE)
    return f"""
WITH raw(license, body) AS (VALUES {values}),
whole(d, license) AS (VALUES {whole}),
known AS (SELECT d, min(license) AS license FROM (SELECT sha256({_sql('body')}) AS d, license FROM raw UNION ALL SELECT d, license FROM whole) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql('text')} AS form FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
blocks AS (SELECT r, unnest(string_split_regex(text, '{BETWEEN}')) AS line FROM docs),
pieces AS (SELECT r, line FROM lines UNION ALL SELECT r, line FROM blocks WHERE regexp_matches(line, '{SEVERAL}')),
forms AS (SELECT r, {_sql('line')} AS form FROM pieces),
hits AS (SELECT f.r, k.license FROM forms f JOIN known k ON f.form <> '' AND sha256(f.form) = k.d),
notices AS (SELECT r, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM hits GROUP BY r)
SELECT d.doc_id, CASE WHEN d.form <> '' THEN sha256(d.form) END AS digest, k.license,
       CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices, coalesce(n.notices, '') AS notices
FROM docs d LEFT JOIN known k ON d.form <> '' AND sha256(d.form) = k.d LEFT JOIN notices n ON n.r = d.r
"""
