"""Licence scan by canonical digests (operator 8).

A text, and each of its lines, is put in a canonical form: lower case, marks and quotes
to spaces, lines of copyright holders left out, equal spellings made one. Digests of the
forms are looked up in a table of known licence texts and notices, of fixed size.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Licences and the names by which notices give them.
NAMES = {
    "MIT": ("MIT License", "Expat License"), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"), "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"), "ISC": ("ISC License",), "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "EPL-2.0"), "Unlicense": ("Unlicense",), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
#: Forms of notices.
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "Available under the {}", "License: {}", "{}")
#: Texts of short licences, without titles and copyright lines.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}
#: Whole texts beside ``TEXTS``, a file for each licence.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
#: Titles above short licences, whose files have none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "Expat License"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License", "The BSD License", "Modified BSD License", "BSD-3-Clause"),
    "Unlicense": ("The Unlicense", "Unlicense"), "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "Zlib"), "BSL-1.0": ("Boost Software License - Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0", "BSL-1.0"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0"),
}
#: How many lines at the top of a file are its title.
HEADS = {"Artistic-1.0-Perl": 1, "GFDL-1.2": 2, "GFDL-1.3": 2, "GPL-1.0": 2, "LGPL-2.0": 2, "MPL-1.1": 2, "Apache-2.0": 3, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-2.0": 1, "CC0-1.0": 2, "CC-BY-SA-4.0": 1}
#: More names of the GNU licences, with and without what follows the version.
SPELLED = {lic: [*(f"{name}{mark}{version}{more}" for name in names for mark in (" v", ", version ") for version in dict.fromkeys((at, at.removesuffix(".0"))) for more in ("", " only", " or later", ", or (at your option) any later version")), f"{lic}-only", f"{lic}-or-later"]
    for lic, at, names in (("GPL-2.0", "2.0", ("GNU General Public License", "GNU GPL", "GPL")), ("GPL-3.0", "3.0", ("GNU General Public License", "GNU GPL", "GPL")), ("LGPL-2.1", "2.1", ("GNU Lesser General Public License", "GNU LGPL", "LGPL")),
        ("LGPL-3.0", "3.0", ("GNU Lesser General Public License", "GNU LGPL", "LGPL")), ("AGPL-3.0", "3.0", ("GNU Affero General Public License", "GNU AGPL", "AGPL")))}
for _names in SPELLED.values():  # GPLv3
    _names += [x.replace("L v", "Lv") for x in _names if "L v" in x]
#: Spellings that mean the same, after case and marks are gone.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"), ("copyright owner", "copyright holder"), ("https ", "http "), (" version ", " v"))
_QUOTES, _SPACES = "‘’“”„«»‐‑–—…· ", " " * 14
_HOLDER = "^(c )?copyright( |$)|^c [0-9]{4}( |$)|^all rights reserved$"
#: What follows the word copyright in running text, of which any line may start with it.
_RUNNING = "^copyright (also|and|are|as|disclaimer|doctrines|holders?|if|in|including|interest|is|laws?|license|like|line|more|notices?|of|on|or|owner|ownership|patent|permission|resulting|statement|the (library|program|software)|then|those|to|treaty)( |$)"
_MARKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def _plain(x: Column) -> Column:
    x = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ©" + _QUOTES, "abcdefghijklmnopqrstuvwxyzc" + _SPACES)
    return F.trim(F.regexp_replace(x, _MARKS, " "))


def _spelled(x: Column) -> Column:
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(x)


def plain_lines(text: Column) -> Column:
    """Lines of a text in lower case and without marks, less empty ones and lines that name holders."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _plain)
    return F.filter(lines, lambda x: (x != "") & (~x.rlike(_HOLDER) | x.rlike(_RUNNING)))


def canonical(lines: Column) -> Column:
    """The canonical form of a whole text, wherever its lines are broken."""
    return _spelled(F.array_join(lines, " "))


@functools.cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(licence, form) of the texts in ``FOLDER``, with and without titles, appendices and numbers of clauses."""
    forms = {}
    for name in sorted(os.listdir(FOLDER)):
        lic = name.removesuffix(".txt")
        with open(os.path.join(FOLDER, name), encoding="utf-8") as f:
            text = f.read()
        bodies = [text]
        if lic in HEADS:
            lines = text.split("\n")
            first = [i for i, x in enumerate(lines) if _canonical(x)][HEADS[lic]]
            bodies.append("\n".join(lines[first:]))
        for end in ("END OF TERMS AND CONDITIONS", "Creative Commons is not a party to its public"):
            bodies += [b[: b.index(end)] + tail for b in bodies if end in b for tail in ("", end) if tail != end or end.isupper()]
        if lic.startswith("BSD"):
            bodies += [re.sub(r"(?m)^[0-9]\. ", "", b) for b in bodies] + [re.sub(r"(?m)^([0-9])\. ", r"(\1) ", b) for b in bodies]
        for body in bodies:
            for title in ("", *(t + "\n" for t in TITLES.get(lic, ()))):
                forms.setdefault(_canonical(title + body), (lic, title + body))
    return tuple(forms.values())


@functools.cache
def known_forms() -> tuple[tuple[str, str], ...]:
    """(licence, form) of all notices and texts; a few thousand, fixed by the lists and files above."""
    forms = [(lic, form.format(name)) for lic, names in NAMES.items() for name in (lic, *names) for form in NOTICES]
    forms += [(lic, f"SPDX-License-Identifier: {lic}") for lic in NAMES] + list(TEXTS.items())
    forms += [(lic, form.format(name)) for lic, names in SPELLED.items() for name in names for form in (*NOTICES, "SPDX-License-Identifier: {}")]
    return (*{_canonical(form) + " " + lic: (lic, form) for lic, form in forms}.values(), *whole_texts())


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of all known forms."""
    rows = spark.createDataFrame(list(known_forms()), "license string, form string")
    rows = rows.select("license", canonical(plain_lines(F.col("form"))).alias("form"))
    return rows.groupBy(F.sha2("form", 256).alias("digest"), F.xxhash64("form").alias("key")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, digest, license, n_license_lines, line_licenses.

    ``digest`` is of the whole canonical text, ``license`` the known text that it equals
    or null. Lines are looked up one by one as well: their number, and the licences
    found, sorted and joined by commas. Null and empty texts have the digest of no words
    and no licence. Repeated rows, and rows without an id, are looked up each. A text is
    canonical as a whole, however long, in one row's memory.
    """
    table = known(docs.sparkSession).collect()  # a few thousand rows, fixed by the lists and files above
    name = F.map_from_arrays(*(F.split(F.lit(" ".join(r[c] for r in table)), " ") for c in ("digest", "license")))  # folded to one literal
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_lines(F.col("text").cast("string")).alias("lines"))
    # The hashes spare most lines a digest; a line that passes is looked up by its digest.
    hits = F.filter(F.transform("lines", _spelled), lambda x: F.xxhash64(x).isin([r["key"] for r in table]))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"), F.filter(F.transform(hits, lambda x: F.try_element_at(name, F.sha2(x, 256))), lambda x: x.isNotNull()).alias("found"))
    digests = F.broadcast(docs.sparkSession.createDataFrame([(r["digest"], r["license"]) for r in table], "digest string, license string"))
    rows = rows.join(digests, "digest", "left")
    return rows.select("doc_id", "digest", "license", F.size("found").cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _canonical(text: str) -> str:
    """What ``canonical`` does, in Python, for the known forms."""
    kept = []
    for x in text.split("\n"):
        x = x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ©" + _QUOTES, "abcdefghijklmnopqrstuvwxyzc" + _SPACES))
        x = re.sub(_MARKS, " ", x).strip(" ")
        if x and (not re.search(_HOLDER, x) or re.search(_RUNNING, x)):
            kept.append(x)
    out = f" {' '.join(kept)} "
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out.strip(" ")


def _oracle() -> str:
    best: dict[str, str] = {}
    for lic, form in known_forms():
        d = hashlib.sha256(_canonical(form).encode()).hexdigest()
        best[d] = min(best.get(d, lic), lic)
    line = f"trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ©{_QUOTES}', 'abcdefghijklmnopqrstuvwxyzc{_SPACES}'), '{_MARKS}', ' ', 'g'), ' ')"

    def spelled(x: str) -> str:
        x = f"' ' || {x} || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"trim({x}, ' ')"

    return f"""
WITH known(digest, license) AS (VALUES {', '.join(f"('{d}', '{x}')" for d, x in best.items())}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {line}), lambda x: x <> '' AND (NOT regexp_matches(x, '{_HOLDER}') OR regexp_matches(x, '{_RUNNING}'))) AS lines FROM documents),
w AS (SELECT rid, doc_id, sha256({spelled("array_to_string(lines, ' ')")}) AS digest FROM d),
l AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM (SELECT rid, unnest(lines) AS x FROM d) JOIN known ON digest = sha256({spelled('x')}) GROUP BY rid)
SELECT doc_id, digest, license, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(names, '') AS line_licenses FROM w LEFT JOIN l USING (rid) LEFT JOIN known USING (digest)
"""


ORACLE = _oracle()
