"""Licence scan by canonical digest lookup.

A text is put in canonical form - lower case, copyright lines dropped, punctuation and white space (line ends as well) reduced to single
spaces, equivalent spellings unified - and the MD5 of the whole of it is looked up, by a hash join, in a
table of known licence digests. Three units are looked up per document, each as an entire text: the document, each of its blocks (between
blank lines, however wrapped) and each of its lines. `known` may be any table of (digest, name).

Known are the entire texts of MIT, ISC, BSD-2-Clause, BSD-3-Clause, 0BSD, Zlib, Unlicense, Apache-2.0, Artistic, CC0-1.0, GPL-1.0, GPL-2.0, GPL-3.0, LGPL-2.0,
LGPL-2.1, LGPL-3.0, MPL-1.1, MPL-2.0 and GFDL-1.2 and 1.3, and one-line notices of some of them.

Null text has no digest and no licence. Empty text, and units without letters or digits, have no digest.
Repeated rows are judged alike and kept. Extra columns are ignored unless named in `keep`. An empty table
gives an empty result. Two licences with one canonical form are one digest; the first name stands.

Built-in SQL functions only. Digests are computed in the scan and written without the texts; (row, digest) pairs meet
the known table, which is broadcast up to `MAX_BROADCAST` rows and joined by shuffle beyond that. Only matches are exchanged, and the narrow rows they go to.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritree.llm.common import written

#: Known digests up to this many rows (40 MB at most) are broadcast.
MAX_BROADCAST = 200_000

# Equivalent spellings and the texts of known licences, as published.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("version ", "v"),
    ("https", "http"),
)

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
    "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
)

_ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    "under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"
)
LICENSES += (("0BSD", _ZERO_BSD), ("0BSD", "BSD Zero Clause License\n\n" + _ZERO_BSD), ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("Unlicense", _UNLICENSE))
# Digests of the canonical forms of longer licences' entire texts, as systems publish them under LONG_TEXTS.
LONG_TEXTS = "/usr/share/common-licenses"
LONG_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "6cf6d4816b86204753564f4214439a7d"),
    ("Artistic-1.0-Perl", "bd74953f77848ac901eeca77820b47ed"),
    ("CC0-1.0", "a4d407d601620dcd1a57f461a0f80a88"),
    ("GFDL-1.2", "a63bcf70eaf1e8be5d25a366f134ef02"),
    ("GFDL-1.3", "56dbd4ca2aff74296efe987d4c595419"),
    ("GPL-1.0", "1e4f039243b1c71d5c186d9937aeda23"),
    ("GPL-2.0", "6207c0b48c5fa78a8a5572438feaa4fc"),
    ("GPL-3.0", "8a6b80c7732637c707b3c7ce6cee667c"),
    ("LGPL-2.0", "3a959eed00bc9152ca7b2bc7e322fc9e"),
    ("LGPL-2.1", "3511a918296d8ee16d0121324b25a7c9"),
    ("LGPL-3.0", "f60d411f4519ef894d908ffbf9d66b2d"),
    ("MPL-1.1", "c3f89b9e84c65cbaec5b93cba5b8e7ae"),
    ("MPL-2.0", "99d9512c10329504e5b176fbedaf178b"),
)

#: A line that only states a copyright: it names the holder or the year and is no part of the licence.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}]*(copyright[\x09-\x0D\x20]+(\(c\)|©|[0-9]{4})|\(c\)[\x09-\x0D\x20]*[0-9]{4}|©|all rights reserved)"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: What stands between blocks.
BLANK = r"\n[\x09-\x0D\x20]*\n"


def _base(line: Column) -> Column:
    """Letters and digits of one line between single spaces; a copyright line has none."""
    low = F.lower(line)
    return F.when(low.rlike(COPYRIGHT_LINE), "").otherwise(F.trim(F.regexp_replace(low, NOT_WORD, " ")))


def _spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical_text(text: str) -> str:
    """The canonical form of a whole text, outside Spark (for the known table and tests)."""
    import regex

    lines = (x.lower() for x in text.split("\n"))
    out = " ".join(x for x in (regex.sub(NOT_WORD, " ", low).strip(" ") for low in lines if not regex.search(COPYRIGHT_LINE, low)) if x)
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def known_digests() -> list[tuple[str, str]]:
    """(digest, name) of the licences above, a digest once."""
    out: dict[str, str] = {}
    for name, text in LICENSES:
        out.setdefault(hashlib.md5(canonical_text(text).encode()).hexdigest(), name)
    return sorted((out | {d: n for n, d in LONG_DIGESTS if d not in out}).items())


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_digests(), "digest string, name string")


def scan(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, text_digest, text_license (of the entire text), block_licenses and line_licenses (sorted names of entire blocks and lines), one row per input row."""
    spark = docs.sparkSession
    known = known_table(spark) if known is None else known.select("digest", "name").groupBy("digest").agg(F.min("name").alias("name"))
    by_digest = F.broadcast(known) if known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else known
    some = lambda a: F.filter(a, lambda x: x != "")
    blocks = F.transform(F.split(F.coalesce(F.col("__text"), F.lit("")), BLANK), lambda b: some(F.transform(F.split(b, "\n"), _base)))
    rows = docs.select(F.struct(F.col(key), *[F.col(c) for c in keep if c != key]).alias("__row"), F.col(text).alias("__text")).withColumn("__blocks", blocks).withColumn("__lines", F.flatten("__blocks"))
    digest = lambda x: F.md5(_spelled(x))
    units = rows.select(
        "__row",
        F.when(F.size("__lines") > 0, digest(F.array_join("__lines", " "))).alias("text_digest"),
        # a block of one line is that line
        F.array_distinct(F.transform(F.filter("__blocks", lambda b: F.size(b) > 1), lambda b: digest(F.array_join(b, " ")))).alias("__bs"),
        F.array_distinct(F.transform("__lines", digest)).alias("__ls"),
        F.monotonically_increasing_id().alias("__id"),
    )
    units = written(units, "licenses")
    of = lambda kind, c: F.transform(c, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("digest")))
    every = F.concat(of("text", F.filter(F.array("text_digest"), lambda d: d.isNotNull())), of("block", F.col("__bs")), of("line", F.col("__ls")))
    pairs = units.select("__id", F.explode(every).alias("u")).select("__id", "u.*").join(by_digest, "digest")
    name = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    hits = pairs.groupBy("__id").agg(F.max(name("text")).alias("text_license"), F.array_sort(F.collect_set(name("block"))).alias("block_licenses"), F.array_sort(F.collect_set(name("line"))).alias("line_licenses"))
    none = F.array().cast("array<string>")
    return units.join(hits, "__id", "left").select("__row.*", "text_digest", "text_license", F.coalesce("block_licenses", none).alias("block_licenses"), F.coalesce("line_licenses", none).alias("line_licenses"))


def sql() -> str:
    """The same scan as DuckDB SQL over `documents`; it finds the known digests itself, from the licences' texts."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    spelled = "x"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, '{a}', '{b}')"
    base = f"list_filter(list_transform(string_split(b, chr(10)), lambda l: CASE WHEN regexp_matches(lower(l), {q(COPYRIGHT_LINE)}) THEN '' ELSE trim(regexp_replace(lower(l), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END), lambda l: l <> '')"
    blocks = f"list_transform(regexp_split_to_array(t, {q(BLANK)}), lambda b: {base})"
    digest = lambda x: f"md5({spelled.replace('x', x, 1) if x != 'x' else spelled})"
    texts = ", ".join(f"({k}, {q(n)}, {q(t)})" for k, (n, t) in enumerate(LICENSES))
    return f"""
WITH given(k, name, t) AS (VALUES {texts}), known AS (
  SELECT digest, arg_min(name, k) AS name FROM (
    SELECT k, name, {digest("array_to_string(flatten(" + blocks + "), ' ')")} AS digest FROM given
    UNION ALL SELECT * FROM (VALUES {", ".join(f"({k + 1000}, {q(n)}, {q(d)})" for k, (n, d) in enumerate(LONG_DIGESTS))}) AS v(k, name, digest)
  ) GROUP BY digest
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {blocks.replace("(t,", "(coalesce(text, ''),")} AS bs FROM documents
), e AS (
  SELECT r, doc_id, CASE WHEN len(flatten(bs)) > 0 THEN {digest("array_to_string(flatten(bs), ' ')")} END AS text_digest,
    list_transform(list_filter(bs, lambda b: len(b) > 1), lambda b: {digest("array_to_string(b, ' ')")}) AS ds, list_transform(flatten(bs), lambda x: {digest("x")}) AS ls FROM d
), b AS (
  SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT r, unnest(ds) AS digest FROM e) JOIN known USING (digest) GROUP BY r
), l AS (
  SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT r, unnest(ls) AS digest FROM e) JOIN known USING (digest) GROUP BY r
)
SELECT doc_id, text_digest, known.name AS text_license, coalesce(b.names, '') AS block_licenses, coalesce(l.names, '') AS line_licenses
FROM e LEFT JOIN known ON known.digest = e.text_digest LEFT JOIN b USING (r) LEFT JOIN l USING (r)
"""
