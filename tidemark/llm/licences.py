"""Licence scans by canonical digests, in DataFrame functions only.

A text's canonical form has lower case, no copyright lines, one spelling for words that licences spell in several ways,
and words parted by single spaces without punctuation. Whole texts are hash-joined on the digest of that form with the
digests of known licences. Each line of a text is looked up as a text of its own as well, which finds notices.

The known texts are those of ``NOTICES`` and of the files in ``licence_texts``. Each also counts with a title or "All
rights reserved." before it, without its appendix, with and without numbers before its items, and wrapped otherwise, as
a line that begins with "copyright" or "(c)" by its wrapping is left out of the canonical form.
"""

from __future__ import annotations

import hashlib
import re
import textwrap
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that begins so is a copyright line.
COPYRIGHT = r"(?i)^[^\p{L}\p{N}(©]*(copyright|\(c\)|©)[^\n]*$"
#: Spellings that count as the same word, after lower-casing.
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bsub-?licen[cs]e", "sublicense"),
    (r"&", " and "),
    (r"https://", "http://"),
    (r"\bauthorisation", "authorization"),
    (r"\bmerchantibility", "merchantability"),
    (r"\bnon-?commercial", "noncommercial"),
    (r"\bversion ([0-9])", "v$1"),
    (r"\bv\.? ?([0-9])", "v$1"),
)
#: Notices of well-known licences, and the shorter licences whole.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "The ASF licenses this file to You under the Apache License, Version 2.0",
        "to you under the Apache License, Version 2.0 (the",
        "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or",
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "AGPL-3.0": ("it under the terms of the GNU Affero General Public License as published by", "Licensed under the GNU Affero General Public License, version 3."),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "it under the terms of the GNU General Public License version 2 as", "under the terms of the GNU General Public License version 2 as published"),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "License, v. 2.0. If a copy of the MPL was not distributed with this",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "All-Rights-Reserved": ("All rights reserved.",),
}
#: The whole texts given in NOTICES, by place.
WHOLE = {"MIT": 2, "ISC": 0}
#: Title lines that stand before a licence's text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License", "The BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Wordings that a licence's text is also written in, as patterns and replacements.
WORDINGS = {
    "ISC": ((r"THE AUTHOR\b", "THE COPYRIGHT HOLDER"),),
    "BSD-2-Clause": ((r"COPYRIGHT\s+HOLDER\s+OR", "COPYRIGHT OWNER OR"),),
    "BSD-3-Clause": ((r"COPYRIGHT\s+HOLDER\s+OR", "COPYRIGHT OWNER OR"),),
    "Apache-2.0": ((r"(?m)^\s*\([a-z]\)\s+", ""),),
    "GPL-3.0": ((r"licenses/why-not-lgpl", "philosophy/why-not-lgpl"),),
}
#: The names whose SPDX lines are notices, besides those of NOTICES.
SPDX = tuple(f"{x}{y}" for x in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("", "-only", "-or-later"))
#: Where an appendix begins; texts of more characters aren't wrapped otherwise than as one line a paragraph.
APPENDIX, SHORT = r"(?im)^.*\bEND OF TERMS AND CONDITIONS\b.*$|^Exhibit A -", 5_000


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line ends; no rule reaches over a line end, so each line is that of the line alone.

    Spaces around a joined string of lines keep ^ and $ at line ends without a flag that differs between engines."""
    out = F.regexp_replace(text, "(?m)" + COPYRIGHT, F.lit(""))
    out = F.lower(out)
    for pattern, word in SPELLINGS:
        out = F.regexp_replace(out, pattern, F.lit(word))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", F.lit(" "))


def canonical_text(text: str) -> str:
    """The same form of a known text, where it has letters a-z only."""
    out = "\n".join(x for x in text.split("\n") if not re.match(r"(?i)[^\w(©]*(copyright|\(c\)|©)", x)).lower()
    for pattern, word in SPELLINGS:
        out = re.sub(pattern, word.replace("$1", r"\1"), out)
    return re.sub(r"[^a-z0-9]+", " ", out).strip(" ")


def _forms(name: str, body: str) -> list[str]:
    """The ways in which a whole text is written down, each canonical form once."""
    short, bodies = len(body) <= SHORT, [body]
    if short:
        unnumbered = re.sub(r"(?m)^\s*(?:[0-9]+\.|\*|-)\s+", "* ", body)
        numbers = iter(range(1, 10))
        bodies += [unnumbered, *(re.sub(r"(?m)^\* ", lambda _: mark % next(numbers), unnumbered) for mark in ("%d. ", "(%d) ") if (numbers := iter(range(1, 10))))]
    elif cut := re.search(APPENDIX, body):
        bodies += [body[: cut.start()], body[: cut.start()] + cut[0] if not cut[0].startswith("Exhibit") else body[: cut.start()]]
    wrapped = list(bodies)
    for b in bodies:
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n|\n(?=\s*(?:\*|\(?[0-9]+[.)]) )", b)]
        wrapped.append("\n".join(paragraphs))
        if short:
            wrapped += ["\n".join(textwrap.fill(p, width) for p in paragraphs) for width in range(60, 101)]
    distinct = list({canonical_text(w): w for w in reversed(wrapped)}.values())
    heads = [h for t in ("", *TITLES.get(name, ())) for h in ((t, f"{t}\nAll rights reserved.") if short else (t,))]
    return [f"{h}\n{w}" for h in heads for w in distinct]


def _known() -> dict[str, tuple[str, ...]]:
    out = {name: list(texts) for name, texts in NOTICES.items()}
    whole = [(name, NOTICES[name][k].replace("\n", "\n\n")) for name, k in WHOLE.items()]
    whole += [(f.stem.split("~")[0], f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    for name, body in whole:
        bodies = dict.fromkeys((body, *(re.sub(p, w, body) for p, w in WORDINGS.get(name, ()))))
        out.setdefault(name, []).extend(t for b in bodies for t in _forms(name, b))
    for name in dict.fromkeys((*out, *SPDX)):
        base = re.sub("-only$|-or-later$", "", name)
        if name != "All-Rights-Reserved":
            out.setdefault(base, []).append(f"SPDX-License-Identifier: {name}")
    return {name: tuple(texts) for name, texts in out.items()}


#: Notices and whole texts by licence.
KNOWN = _known()


def _canonical(known: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Canonical text to licence; the first licence in order where two have the same canonical text."""
    out: dict[str, str] = {}
    for name, texts in sorted(known.items()):
        for t in texts:
            out.setdefault(canonical_text(t), name)
    return out


@cache
def _canonical_known() -> dict[str, str]:
    return _canonical(KNOWN)


def known_digests(known: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Digest to licence. Those of KNOWN are worked out from texts that are made canonical once."""
    texts = _canonical(known) if known else _canonical_known()
    return {hashlib.sha256(t.encode()).hexdigest(): name for t, name in texts.items()}


def scan(docs: DataFrame, *, known: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with ``canonical_sha256``, ``license`` (of the whole text, else null), ``notices`` (licences of
    its lines, sorted, joined by commas), ``n_notices`` (lines that are notices) and ``n_copyright`` (copyright lines).

    Null counts as empty; an empty text has the digest of the empty form and no licence. Repeated rows each give a row.
    Other columns are not read; an empty table gives no rows. The table of known digests is of a fixed size.
    """
    spark = docs.sparkSession
    digests = known_digests(known)
    lengths = sorted({len(t) for t in (_canonical(known) if known else _canonical_known())})
    table = spark.createDataFrame(sorted(digests.items()), "canonical_sha256 string, license string")
    lookup = F.from_json(F.lit(_json(digests)), "map<string,string>")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", canonical_lines(F.col("text")).alias("form"), F.regexp_count("text", F.lit("(?m)" + COPYRIGHT)).cast("long").alias("n_copyright"))
    whole = F.trim(F.regexp_replace("form", r"[ \n]+", F.lit(" ")))
    # Hash sets of lengths and digests: few lines are hashed, and few of those get to the map.
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths))
    hashes = F.filter(F.transform(lines, lambda x: F.sha2(x, 256)), lambda x: x.isin(sorted(digests)))
    rows = rows.select("id", F.sha2(whole, 256).alias("canonical_sha256"), F.transform(hashes, lambda x: F.try_element_at(lookup, x)).alias("found"), "n_copyright")
    rows = rows.join(F.broadcast(table), "canonical_sha256", "left")
    return rows.select(F.col("id").alias(id_col), "canonical_sha256", "license", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"), "n_copyright")


def _json(digests: dict[str, str]) -> str:
    import json

    return json.dumps(digests)


def oracle() -> str:
    """The same scan for DuckDB."""

    def form(x: str) -> str:
        out = f"lower(regexp_replace({x}, '(?m){COPYRIGHT}', '', 'g'))"
        for pattern, word in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{word.replace('$1', chr(92) + '1')}', 'g')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"

    table = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    longest = max(map(len, _canonical_known()))
    return f"""
WITH known(digest, name) AS (VALUES {table}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, {form("l")} AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n FROM lines JOIN known ON digest = sha256(c) WHERE length(c) > 0 AND length(c) <= {longest} GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({form("t")}) AS canonical_sha256, CAST(len(regexp_extract_all(t, '(?m){COPYRIGHT}')) AS BIGINT) AS n_copyright FROM d)
SELECT w.doc_id, w.canonical_sha256, k.name AS license, coalesce(f.notices, '') AS notices, coalesce(f.n, 0) AS n_notices, w.n_copyright
FROM whole w LEFT JOIN known k ON k.digest = w.canonical_sha256 LEFT JOIN found f USING (doc_id)
"""
