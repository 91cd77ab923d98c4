"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines left out, equivalent spellings made one,
every run of other characters than letters and digits made one blank, lines that only name a licence left out. The digest of
the whole canonical text is hash-joined to the digests of known licences: a text that holds anything beside the licence
has another digest. Apart from that, each canonical line is looked up among known notices of one line.

Known texts are a parameter, a table of (license, text); by default those of TEXTS, and ``texts_of_files`` makes one of a folder of whole
licence files, which the tasks read. Their digests are broadcast if they are few, as the default
ones are, and else met by a shuffle of digests alone.

Defined cases: a null or blank text has the digest of the empty text and no licence, and so has one of names and owners alone; a known
text without a canonical line or without a name is left out; of
several known licences with one digest the first by name is taken; repeated rows and ids are judged
row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Equivalent spellings, in the order in which they are replaced.
SPELLINGS = (
    ("licence", "license"),
    ("sub-licens", "sublicens"),
    ("copyright owner", "copyright holder"),
    ("non-commercial", "noncommercial"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("https:", "http:"),
    ("&", "and"),
)
#: Those of two words, as they are once lines are joined: a line may end between the words.
JOINED = (("copyright owner", "copyright holder"), ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("per cent", "percent"))
#: Lines that name an owner, and among them those that begin like one but are part of a condition.
OWNER_LINE = r"^[^a-z0-9]*(copyright|all rights reserved|\(c\)|©)"
CONDITION_LINE = r"^[^a-z0-9]*copyright (notices?|holders?|owners?|law|laws|licen[cs]e|statement|interest|and|or|in|to)\b"
#: Canonical lines that only name a licence.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "isc license", "the isc license", "isc license isc", "mit no attribution",
    "bsd zero clause license", "zero clause bsd license", "bsd zero clause license 0bsd", "bsd 2 clause license", "the 2 clause bsd license", "simplified bsd license",
    "bsd 2 clause simplified license", "bsd 3 clause license", "the 3 clause bsd license", "new bsd license", "bsd 3 clause new or revised license", "zlib license",
    "the zlib license", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0", "the unlicense", "unlicense",
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_OR_LATER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\n"
    "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
#: Known licence texts, and the headers that stand for long ones.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted.\n\n" + _ISC_AS_IS,
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so.\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD_CONDITIONS + _BSD_AS_IS,
    "BSD-3-Clause": _BSD_CONDITIONS
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\n" + _BSD_AS_IS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
    "\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be "
    "removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
    'by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and "
    "this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
    "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    'generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
    "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR '
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org/>",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": _GNU_OR_LATER.format(name="General Public License", version="2"),
    "GPL-3.0-or-later": _GNU_OR_LATER.format(name="General Public License", version="3"),
    "LGPL-3.0-or-later": _GNU_OR_LATER.format(name="Lesser General Public License", version="3"),
    "AGPL-3.0-or-later": _GNU_OR_LATER.format(name="Affero General Public License", version="3"),
}
#: Known notices of one line.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def canonical_lines(text: str | None) -> list[str]:
    """The canonical form of a text by lines, in Python."""
    lines = []
    for line in (text or "").lower().split("\n"):
        if not re.match(OWNER_LINE, line) or re.match(CONDITION_LINE, line):
            for a, b in SPELLINGS:
                line = line.replace(a, b)
            lines.append(re.sub("[^a-z0-9]+", " ", line).strip(" "))
    return [x for x in lines if x and x not in TITLES]


def digest(text: str) -> str:
    whole = " ".join(canonical_lines(text))
    for a, b in JOINED:
        whole = whole.replace(a, b)
    return hashlib.sha256(whole.encode()).hexdigest()


def known_texts(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license) of known texts (license, text), one for each digest."""
    if texts is None:
        texts = spark.createDataFrame(list(TEXTS.items()), "license string, text string")
    made = texts.where(F.col("license").isNotNull()).select("license", joined(canonical(F.col("text"))).alias("_text"))
    made = made.where(F.col("_text") != "").select("license", F.sha2(F.col("_text").cast("binary"), 256).alias("digest"))
    return made.groupBy("digest").agg(F.min("license").alias("license"))


def texts_of_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(license, text) of the files of a folder, UTF-8, each one whole text named by its file's name without what follows the last dot."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").format("binaryFile").load(folder)
    name = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("license"), F.col("content").cast("string").alias("text"))


def known_notices() -> list[tuple[str, str]]:
    return [(digest(line), name) for name, lines in NOTICES.items() for line in lines]


def canonical(text: Column) -> Column:
    """The canonical form of a text by lines. Spellings never reach over lines, so they are made one in the whole text."""
    kept = lambda x: ~F.rlike(x, F.lit(OWNER_LINE)) | F.rlike(x, F.lit(CONDITION_LINE))
    low = F.array_join(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), kept), "\n")
    for a, b in SPELLINGS:
        low = F.replace(low, F.lit(a), F.lit(b))
    plain = F.regexp_replace(low, "[^a-z0-9\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: (x != "") & ~x.isin(*TITLES))


def joined(lines: Column) -> Column:
    """The canonical form of a text as a whole, from its lines."""
    whole = F.array_join(lines, " ")
    for a, b in JOINED:
        whole = F.replace(whole, F.lit(a), F.lit(b))
    return whole


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, notices): the licence that a whole text is, and those that its lines name."""
    names = F.create_map(*(F.lit(x) for pair in known_notices() for x in pair))
    digests = F.array(*(F.lit(d) for d, _ in known_notices()))

    def looked_up(lines: Column) -> Column:
        own = F.filter(F.transform(lines, lambda x: F.sha2(x.cast("binary"), 256)), lambda d: F.array_contains(digests, d))
        return F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda d: names[d]))), ",")

    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(canonical(F.col("text")), lambda x: F.struct(F.sha2(joined(x).cast("binary"), 256).alias("digest"), looked_up(x).alias("notices"))).alias("_made"),
    ).select("doc_id", "_made.*")
    known = known_texts(docs.sparkSession, texts)
    # the default texts are a few rows
    return made.join(F.broadcast(known) if texts is None else known.hint("merge"), "digest", "left").select("doc_id", "digest", "license", "notices")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    low = rf"array_to_string(list_filter(string_split(lower(coalesce({column}, '')), chr(10)), lambda x: not regexp_matches(x, {_quoted(OWNER_LINE)}) or regexp_matches(x, {_quoted(CONDITION_LINE)})), chr(10))"
    for a, b in SPELLINGS:
        low = f"replace({low}, {_quoted(a)}, {_quoted(b)})"
    plain = rf"regexp_replace({low}, '[^a-z0-9\n]+', ' ', 'g')"
    return f"list_filter(list_transform(string_split({plain}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and x not in ({', '.join(map(_quoted, TITLES))}))"


def _sql_joined(lines: str) -> str:
    whole = f"array_to_string({lines}, ' ')"
    for a, b in JOINED:
        whole = f"replace({whole}, {_quoted(a)}, {_quoted(b)})"
    return whole


def _values(rows) -> str:
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows)


ORACLE = f"""
WITH texts(license, text) AS (VALUES {_values(TEXTS.items())}),
notes(name, line) AS (VALUES {_values((n, x) for n, lines in NOTICES.items() for x in lines)}),
known AS (SELECT license, sha256({_sql_joined(_sql_lines("text"))}) AS digest FROM texts),
named AS (SELECT name, sha256(array_to_string({_sql_lines("line")}, ' ')) AS digest FROM notes),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines("text")} AS lines FROM documents),
whole AS (SELECT r, doc_id, sha256({_sql_joined("lines")}) AS digest FROM docs),
found AS (
    SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
    FROM (SELECT r, sha256(unnest(lines)) AS digest FROM docs) JOIN named USING (digest) GROUP BY r
)
SELECT doc_id, whole.digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (r)
"""
