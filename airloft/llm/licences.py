"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings) and its digest is joined with the digests of known
licences: the files of the folder `known`, named by licence identifier, and the
texts below. The same form of each single line is looked up among them too.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shielded, table

# Spellings that count as equal, as in the public matching guidelines for licence texts.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisation", "capitalization"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright holder", "copyright owner"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("merchantibility", "merchantability"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("optimisation", "optimization"), ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"),
    ("recognise", "recognize"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TOP = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Texts and notices of public licences, by licence identifier.
_SHORT = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TOP + _BSD_THIRD + _BSD_END),
    ("MIT-0", "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
     "is furnished to do so.\n\n" + _AS_IS),
    ("Zlib", "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, "
     "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of "
     "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
     "an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly "
     "marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any "
     "source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or "
     'organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, '
     "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
     "whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, "
     "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole "
     "or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
     'object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
     "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN "
     "NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, "
     "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "The Unlicense\n\nThis is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
     "or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
     "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
     "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
     'future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
     "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
     "AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or "
     'agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
     "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)



def _files() -> tuple[tuple[str, str], ...]:
    return tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted(Path(__file__).with_name("known").glob("*.txt")))


def _untitled(text: str) -> str:
    """text without a short first paragraph, which is a title, if more than a sentence follows."""
    head, _, rest = text.lstrip().partition("\n\n")
    return rest if len(head) <= 200 and head.count("\n") < 3 and len(rest) > 100 else text


def _variants(texts) -> tuple[tuple[str, str], ...]:
    return tuple(dict.fromkeys(x for name, t in texts for x in ((name, t), (name, _untitled(t)))))


#: All known texts, with and without their titles: a constant of some 20 licences, whose digests are broadcast.
TEXTS = _variants(_SHORT + _files())

#: A whole line that is a copyright statement: one with a sign, a year or a place for them, or a later year.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)([ \t]+(\(c\)|©|[0-9]|by |[\[<{])|[^\n]*(19|20)[0-9][0-9])[^\n]*"
#: A line that only reserves rights, with the line end before it.
RESERVED_LINE = r"(^|\n)[ \t]*all rights reserved[ \t.]*(\n|$)"
#: The title of a licence family, as the first line of a text with more lines.
TITLE = r"^[\s#*=_-]*(the )?(mit|expat|x11|isc|zlib|bsd|new bsd|modified bsd|simplified bsd|revised bsd|apache|boost|gnu|mozilla|eclipse|academic free|artistic)[^\n]{0,50}licen[cs]e[^\n]{0,40}\n"
#: Numbers, letters and bullets that open a line of a list.
MARK = r"(^|\n)[ \t]*([0-9]{1,2}[.)]|\([0-9a-z]{1,2}\)|[a-z][.)]|[*•-])[ \t]+"
#: Places of names, in the canonical form, and what stands there instead.
NAMES = (
    ("neither the name of .{1,100}? nor the names? of", "neither the name of the copyright owner nor the names of"),
    ("provided by .{1,100}? as is", "provided by the copyright owner as is"),
    ("in no event shall .{1,100}? be liable", "in no event shall the copyright owner be liable"),
)


def canonical(text: Column) -> Column:
    """Lowered (A-Z), without title, copyright lines and list marks, runs of other than letters, marks and digits as one space, one spelling each, one name for all holders."""
    out = F.regexp_replace(F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "\n"), RESERVED_LINE, "\n")
    out = F.regexp_replace(F.regexp_replace(out, TITLE, ""), MARK, "\n")
    out = F.btrim(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}]+", " "))
    for variant, kept in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(kept))
    for pattern, kept in NAMES:
        out = F.regexp_replace(out, pattern, kept)
    return out


def known_digests(spark, texts=TEXTS) -> DataFrame:
    """(digest, license): one row a known text, smallest identifier first where two have one form."""
    rows = spark.createDataFrame(list(texts), "license string, text string").select("license", canonical(F.col("text")).alias("form"))
    return rows.where("form <> ''").groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license"))


def cue(texts=TEXTS) -> str:
    """A pattern that every line whose form is that of a known text matches: a word of each text that its form keeps."""
    spelled = [part for pair in SPELLINGS for phrase in pair for part in (phrase.replace(" ", ""), *phrase.split())]
    found = set()
    for text in (_untitled(t) for _, t in texts):
        words = set(re.findall(r"[a-z0-9]+", text.lower()))
        if any("license" in w or "licence" in w for w in words):
            found.add("licen[cs]e")
            continue
        kept = [w for w in words if not any(s in w for s in spelled)]
        found.add(max(kept, key=lambda w: (len(w), w)) if kept else "")
    return "(?i)" + "|".join(sorted(found))


@shielded("text")
def scan_licences(docs: DataFrame, texts=TEXTS) -> DataFrame:
    """docs (text, ...) with digest, license (of the entire text) and notices (of single lines, sorted, distinct).

    Entire texts are all looked up; lines only where they have a word that
    some known text must have (see cue). The list of known texts is the
    caller's constant, so its digests are broadcast and the scan needs no
    shuffle. Null text counts as empty and matches nothing; equal texts get
    equal results, and texts of any length are read whole. Of known texts with
    one form the smallest identifier is given. Columns of docs with these names
    are replaced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    known = known_digests(spark, texts)
    held = docs.withColumn("digest", F.md5(canonical(text))).join(F.broadcast(known), "digest", "left")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(cue(texts)))
    listed = [(r["digest"], r["license"]) for r in known.collect()]
    names = F.create_map(*[F.lit(x) for pair in listed for x in pair])
    found = F.transform(lines, lambda line: F.element_at(names, F.md5(canonical(line))))
    return held.withColumn("notices", F.array_sort(F.array_distinct(F.array_compact(found))))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs).select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{RESERVED_LINE}', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{TITLE}', ''), '{MARK}', chr(10), 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
    for variant, kept in SPELLINGS:
        out = f"replace({out}, '{variant}', '{kept}')"
    for pattern, kept in NAMES:
        out = f"regexp_replace({out}, '{pattern}', '{kept}', 'g')"
    return out


def sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEXTS)
    return f"""
    WITH known AS (SELECT md5({_sql_canonical("t")}) AS digest, min(i) AS license FROM (VALUES {quoted}) AS v(i, t) WHERE {_sql_canonical("t")} <> '' GROUP BY 1),
    d AS (SELECT doc_id, md5({_sql_canonical("coalesce(text, '')")}) AS digest, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line FROM d),
    n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
          FROM l JOIN known ON md5({_sql_canonical("line")}) = known.digest GROUP BY 1)
    SELECT d.doc_id, d.digest, known.license, coalesce(n.notices, '') AS notices
    FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)
    """
