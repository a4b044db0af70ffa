"""Operator 9: licence scan by canonical digest lookup, in DataFrame functions only.

Method. A text is brought to a canonical form: A-Z lower-cased, copyright statements and
"all rights reserved" dropped, punctuation and white space turned into single blanks,
equivalent spellings unified word by word. The SHA-256 digest of the canonical form is
hash-joined to the digests of known licence texts and notices. Three kinds of entire texts
are looked up: the document as a whole, each of its paragraphs (between blank lines), which
may be wrapped, and each of its lines. A copyright statement ends at a full stop that is
followed by more text, else with its line; it must have a sign or a year after the word.
Equivalent spellings of two words are not seen across a line end.

Registry. `KNOWN` has complete short licences and common notices. Further texts (the long
licences) are added as rows of a table known(license, text) given to `registry`.

Scale. One pass over the documents; what changes a text works on the whole text at once.
The units of a document are aggregated where they are read, so one small row per document
is shuffled. The registry is broadcast only while it has at most `SMALL_REGISTRY` rows,
otherwise the join is left to Spark.

Edge cases. Null, empty and purely copyright texts have an empty canonical form, which
no licence has. Repeated rows and repeated or null doc_ids are reported row by row.
Lines are parted by line feeds; a carriage return counts as white space. A unit that two
licences share goes to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SMALL_REGISTRY = 10_000

#: Parts of complete licence texts.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known notices and complete licence texts by SPDX identifier.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License\n\n{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"MIT License\n\n{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT_GRANT}\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT}\n\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}\n\n{_ISC_WARRANTY}"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_NAMES}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n{_BSD_SOURCE}\n\n{_BSD_BINARY}\n\n{_BSD_NAMES}\n\n{_BSD_WARRANTY}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
)
#: Spellings that count as the same, after punctuation is gone.
EQUIVALENT = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("https", "http"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright statement at the start of a line, which follows a line feed.
_STATED = r"\n[ \t]*(copyright[ \t:]*(\(c\)|©|[0-9<{\[])|\(c\)[ \t]*(copyright)?[ \t]*[0-9<{\[]|©)"
#: The same up to a full stop and the first sign of what follows, and the same to the end of its line.
COPYRIGHT_BEFORE, COPYRIGHT = _STATED + r"[^\n]*?\. +([^\n ])", _STATED + r"[^\n]*"
RESERVED = r"all rights reserved\.?"
#: ASCII signs and white space but the line feed, and typographic quotes and dashes.
SIGNS = r"[\x00-\x09\x0B-/:-@\[-`{-\x7f‘’“”–—…]+"


def canonical(text: Column) -> Column:
    """The canonical forms of all lines, parted by line feeds; copyright statements are gone, blank lines are empty."""
    out = F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))
    for pattern, new in ((RESERVED, ""), (COPYRIGHT_BEFORE, "\n$4"), (COPYRIGHT, "")):
        out = F.regexp_replace(out, pattern, new)
    # every word gets blanks of its own on both sides, so that neighbours are both replaced
    out = F.replace(F.regexp_replace(out, SIGNS, "  "), F.lit("\n"), F.lit(" \n "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(_apart(a)), F.lit(_apart(b)))
    return F.trim(F.replace(F.replace(F.regexp_replace(out, " +", " "), F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def _whole(form: Column) -> Column:
    """The canonical form of an entire text, out of that of its lines."""
    return F.trim(F.regexp_replace(form, "\n+", " "))


def units(form: Column) -> Column:
    """All entire texts to look up, from the canonical forms of the lines: the document first, then lines and paragraphs, as (digest, whole)."""
    filled = lambda parts: F.filter(parts, lambda c: c != "")
    lines, paragraphs = F.split(form, "\n"), F.transform(F.split(form, "\n\n+"), _whole)
    whole = F.struct(_digest(_whole(form)).alias("digest"), F.lit(True).alias("whole"))
    each = F.transform(filled(F.array_union(lines, paragraphs)), lambda c: F.struct(_digest(c).alias("digest"), F.lit(False).alias("whole")))
    return F.concat(F.array(whole), each)


def registry(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """digest, license of KNOWN and of further texts more(license, text); a text under several names keeps the smallest."""
    texts = spark.createDataFrame(list(KNOWN), "license string, text string")
    texts = texts if more is None else texts.union(more.select("license", "text"))
    return texts.select("license", _digest(_whole(canonical(F.col("text")))).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """docs(doc_id, text), known(digest, license) -> doc_id, n_units, whole_license, licenses (sorted, comma-joined), n_licenses."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical(F.col("text")).alias("form"))
    rows = rows.select("row", "doc_id", F.explode(units(F.col("form"))).alias("u"))
    rows = rows.select("row", "doc_id", F.col("u.digest").alias("digest"), F.col("u.whole").alias("whole"))
    joined = rows.join(F.broadcast(known) if small else known, "digest", "left")
    out = joined.groupBy("row", "doc_id").agg(
        F.count("*").alias("n_units"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.sort_array(F.collect_set("license")).alias("found"),
    )
    return out.select(
        "doc_id", "n_units", "whole_license", F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses")
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), registry(spark), len(KNOWN) <= SMALL_REGISTRY)


QUERIES = {"op9_license_scans": op9_license_scans}


def _duck(text: str) -> str:
    out = f"concat(chr(10), translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'))"
    for pattern, new in ((RESERVED, ""), (COPYRIGHT_BEFORE, "\n\\4"), (COPYRIGHT, "")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"concat(' ', replace(regexp_replace({out}, '{SIGNS}', '  ', 'g'), chr(10), ' ' || chr(10) || ' '), ' ')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{_apart(a)}', '{_apart(b)}')"
    return f"trim(replace(replace(regexp_replace({out}, ' +', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), ' ')"


_FORM = _duck("text")
_LINES = "[y for y in string_split(form, chr(10)) if y <> '']"
_PARTS = "[y for y in [trim(replace(x, chr(10), ' '), ' ') for x in string_split_regex(form, '\\n\\n+')] if y <> '']"
_TEXTS = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)

ORACLE = {
    "op9_license_scans": f"""
WITH known AS (
  SELECT sha256(array_to_string({_LINES}, ' ')) AS digest, min(license) AS license
  FROM (SELECT license, {_FORM} AS form FROM (VALUES {_TEXTS}) AS k(license, text)) GROUP BY 1),
d AS (SELECT r, doc_id, {_LINES} AS ls, {_PARTS} AS ps FROM (SELECT row_number() OVER () AS r, doc_id, {_FORM} AS form FROM documents)),
u AS (
  SELECT r, doc_id, sha256(array_to_string(ls, ' ')) AS digest, true AS whole FROM d
  UNION ALL SELECT r, doc_id, sha256(l), false FROM (SELECT r, doc_id, unnest(list_distinct(list_concat(ls, ps))) AS l FROM d))
SELECT doc_id, count(*) AS n_units, max(CASE WHEN whole THEN license END) AS whole_license,
       coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, count(DISTINCT license) AS n_licenses
FROM u LEFT JOIN known USING (digest) GROUP BY r, doc_id
"""
}
