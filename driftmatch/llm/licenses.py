"""Licence scans: entire texts, and entire lines, looked up by the digest of a canonical form.

Canonical form: copyright lines are dropped, letters lower-cased, everything but a-z and 0-9 becomes one space,
equivalent spellings become one. Its MD5 is joined with the digests of known licence texts and notices; that table is
code, a few thousand rows, so its broadcast is bounded. Every known text holds one of a few anchor words in canonical form
(checked at import), so texts without any of them are settled without normalising.

A null or empty text has no licence. One row for each row of the input, repeated ids included; an empty table gives
none. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHORS = ("licen", "permission", "redistribution", "public domain", "warrant", "released", "distributed")
#: The same in a text as it stands: "public domain" may be spaced otherwise; its last word stands for it.
_ANCHORED = "licen|permission|redistribution|domain|warrant|released|distributed"
#: Whole words in canonical form, and what they become.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sublicence": "sublicense", "non infringement": "noninfringement", "noncommercial": "non commercial",
    "favour": "favor", "authorised": "authorized", "organisation": "organization", "merchantibility": "merchantability", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "per cent": "percent", "http": "https", "cc": "creative commons", "v": "version", "gpl": "general public license",
}
COPYRIGHT = r"(?m)^[^A-Za-z0-9\n]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]\b[^A-Za-z\n]*(?:\([Cc]\)|©|[0-9]{4})|©|\([Cc]\) ?[0-9]{4}|[Aa]ll [Rr]ights [Rr]eserved)[^\n]*$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, "MIT License " + _MIT, "The MIT License (MIT) " + _MIT, "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "ISC": (_ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"), "ISC License " + _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"), "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "0BSD": (_ISC.format(""), "SPDX-License-Identifier: 0BSD"),
    "BSD-2-Clause": (_BSD.format(""), "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (_BSD.format(" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."), "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "Apache-2.0": (_APACHE, "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "Zlib": (_ZLIB, "zlib License " + _ZLIB, "SPDX-License-Identifier: Zlib"),
    "GPL-2.0": (_GPL.format("2"), "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": (_GPL.format("3"), "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}


def canonical(text: str) -> str:
    """The canonical form in Python, for the catalogue; ``canonical_column`` is the same in the JVM."""
    s = re.sub(COPYRIGHT, "", text)
    s = " " + re.sub("[^a-z0-9]+", " ", s.translate({c: c + 32 for c in range(65, 91)})).strip() + " "
    for old, new in SPELLINGS.items():
        s = s.replace(f" {old} ", f" {new} ")
    return s.strip()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_column(text: Column) -> Column:
    s = F.regexp_replace(text, COPYRIGHT, "")
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        s = F.replace(s, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(s)


#: Digests of whole licence texts in canonical form: with the appendix or exhibits, and without where there are any.
FULL: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("ad08bc19e123883536d3a91ca0dc5793", "2ae115b53440246355f1d53f38dd56f2", "7c8783a7d71e381e60513a646f6526d7",),
    "GPL-2.0": ("6cbc6e578a0b412c9ed29d7644e79fbc", "040bf0284b985b0dc86df1757c7de2cb", "bfb48b539e2921356790f245c19aa8c8",),
    "GPL-3.0": ("d9836563361acbce4e38d7532f7bc15b", "d1fa8c9a5bb52eb7e5304bd6ae67ff63", "cf3703f14c2893b7796aa27284fe66a4",),
    "LGPL-2.1": ("cae675ccb3fcb165b1c6dea581897427", "f9e3bb3e8d8a3a8c5affbf8e5b7261ca", "ca63a64ce4cf790267820cc3cf1054c3",),
    "LGPL-3.0": ("993aef82f34a705d491848394cf21cd6",),
    "MPL-2.0": ("47daab7b99aa07cc72294488182970a7", "310bebfffc41fb4428c07a91abbe6c86",),
    "CC0-1.0": ("34d5888503b0fc9544a1bbde9a3b92ce",),
}

#: What stands after "under" in one-line notices.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "the MIT License", "the MIT License (MIT)", "MIT", "the MIT licence terms"),
    "ISC": ("ISC License", "the ISC License", "ISC"),
    "0BSD": ("the 0BSD License", "the BSD Zero Clause License", "the Zero-Clause BSD License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "the BSD-2-Clause License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License"),
    "Apache-2.0": tuple(f"{the}Apache License{v}" for the in ("", "the ") for v in (", Version 2.0", " 2.0", " v2.0", " v2", ", Version 2")) + ("the Apache 2.0 License", "the Apache-2.0 License", "Apache 2.0"),
    "Zlib": ("the zlib License", "the zlib/libpng License"),
    **{
        f"{key}-{v}.{w}": tuple(f"{the}{name}{x}{n}{later}" for the in ("", "the ") for name in names for x in (" version ", " v", " ") for n in ([v, f"{v}.0"] if w == "0" else [f"{v}.{w}"]) for later in ("", " or later", " or any later version"))
        for key, names, versions in (
            ("GPL", ("GNU General Public License", "GPL"), ("2.0", "3.0")),
            ("LGPL", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), ("2.1", "3.0")),
            ("AGPL", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), ("3.0",)),
        )
        for v, w in (x.split(".") for x in versions)
    },
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "the MPL, version 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 License", "the CC0 1.0 Universal License", "the CC0 1.0 Universal Public Domain Dedication"),
    **{
        f"CC-{code}-4.0": tuple(f"{the}{name} 4.0{end}" for the in ("", "a ", "the ") for name in (f"CC {code}", f"Creative Commons {words}") for end in ("", " International", " License", " International License"))
        for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    },
    "Unlicense": ("the Unlicense", "The Unlicense license"),
}
_DONE = ("licensed", "released", "distributed")
LEADS = (*_DONE, *(f"this {x} is {d}" for x in ("work", "project", "software", "program") for d in _DONE))


def notices():
    """(notice in canonical form, licence)."""
    for key, names in NAMES.items():
        for name in dict.fromkeys(canonical(x) for x in names):
            for lead in LEADS:
                for under in ("under", "under the terms of"):
                    yield f"{lead} {under} {name}", key


def digests() -> dict[str, str]:
    """MD5 of the canonical form -> licence."""
    known = {hashlib.md5(x.encode()).hexdigest(): k for x, k in notices()}
    known |= {d: k for k, ds in FULL.items() for d in ds}
    return known | {hashlib.md5(canonical(t).encode()).hexdigest(): k for k, ts in KNOWN.items() for t in ts}


assert all(any(a in canonical(t) for a in ANCHORS) for ts in KNOWN.values() for t in ts)
assert all(any(a in x for a in ANCHORS) for x in LEADS)


def _anchored(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER).rlike(_ANCHORED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license, line_licenses): of the whole text, where it has an anchor word; and of its lines, sorted
    and joined by a comma."""
    spark = docs.sparkSession
    known = digests()
    table = spark.createDataFrame(sorted(known.items()), "digest string, license string")
    by_digest = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    text = F.col("text")
    lines = F.transform(F.filter(F.split(text, "\n", -1), _anchored), lambda x: F.try_element_at(by_digest, F.md5(canonical_column(x).cast("binary"))))
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        F.when(_anchored(text), F.md5(canonical_column(text).cast("binary"))).alias("digest"),
        F.when(_anchored(text), F.array_join(F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))), ",")).otherwise("").alias("line_licenses"),
    )
    return work.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license", "line_licenses")


def scan_sql() -> str:
    """The same for DuckDB over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        s = f"regexp_replace({x}, {quote(COPYRIGHT)}, '', 'g')"
        s = f"' ' || trim(regexp_replace(translate({s}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS.items():
            s = f"replace({s}, ' {old} ', ' {new} ')"
        return f"trim({s})"

    anchor = lambda x: f"regexp_matches(translate({x}, '{_UPPER}', '{_LOWER}'), '{_ANCHORED}')"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in sorted(digests().items()))
    return f"""
WITH known(digest, license) AS (VALUES {values}),
d AS (SELECT doc_id, text, coalesce({anchor('text')}, false) AS hit FROM documents),
whole AS (SELECT doc_id, CASE WHEN hit THEN md5({canon('text')}) END AS digest FROM d),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d WHERE hit),
found AS (SELECT line.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS got
          FROM line JOIN known k ON k.digest = md5({canon('line.x')}) WHERE {anchor('line.x')} GROUP BY line.doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(f.got, '') AS line_licenses
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN found f ON f.doc_id = w.doc_id
"""
