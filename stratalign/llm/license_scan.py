"""License scan by canonical digests, DataFrame operations only.

A text is brought to a canonical form: lower case, copyright claims cut off (what follows the
holder's sentence, or the start of a grant, stays), equivalent spellings made one, punctuation and
white space made single blanks. The SHA-256 of the canonical lines of a whole text is looked up,
by a hash join, among the digests of known licence texts. Inside a longer document the same
lookup is made wherever the opening words of a known text stand, for as much of the document
as that text is long, and for single lines, so that a notice such as "Released under the MIT
License." is found too.

Scale: one pass over the documents, no shuffle. The known digests are a fixed catalogue,
broadcast after a check of its size.

Defined cases: null and empty texts, and texts of nothing but copyright lines, have no
licence. Repeated rows are judged alike. Two catalogue entries with one canonical form
count as the smaller name. Very long texts and lines are processed whole. Columns other than the
identifier and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalign.llm._util import ascii_lower, or_empty

CATALOGUE_LIMIT = 10_000

# Equivalent spellings (words, replacement), in the manner of the public SPDX matching guidelines.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("noncommercial", "non commercial"), ("organisation", "organization"),
    ("per cent", "percent"), ("programme", "program"), ("sublicence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"),
)

# Short notices by which a document names its licence.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
}

_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _long(name: str) -> str:
    """The published text of a long licence; only the driver reads it."""
    return (Path(__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8")


# Whole texts of licences.
TEXTS = {
    "BSD-2-Clause": "BSD 2-Clause License\n" + _REDISTRIBUTION + _DISCLAIMER,
    "BSD-3-Clause": "BSD 3-Clause License\n" + _REDISTRIBUTION + _NO_ENDORSEMENT + _DISCLAIMER,
    **{name: _long(name) for name in ("Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")},
    "MIT": """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Words of a text's first line, if that is a title.
TITLE_WORDS = 12
_TERMS_END = "END OF TERMS AND CONDITIONS"


def forms_of(name: str, text: str) -> Sequence[str]:
    """A licence text as it is found: as given and without its title; BSD texts without numbers too, and terms without the appendix on their use."""
    title, _, rest = text.strip().partition("\n")
    forms = [text, rest] if rest and len(title.split()) <= TITLE_WORDS else [text]
    if name.startswith("BSD-"):
        forms += [re.sub(r"(?m)^[0-9]\. ", "* ", x) for x in forms]
    for whole in [x for x in forms if _TERMS_END in x]:
        terms = whole.partition(_TERMS_END)[0]
        forms += [terms + _TERMS_END, terms]
    return forms


#: A line that may claim copyright; claims differ between copies of one licence.
COPYRIGHT_LINE = r"(?s)^[^a-z0-9]*(portions )?(copyright|©|\(c\))( *\(c\)| *©|.*[0-9]{4}|.*<year>|.*\[yyyy\]).*$|^[^a-z0-9]*all +rights +reserved[^a-z0-9]*$"

_RESERVED = r"(?s)^[^a-z0-9]*all +rights +reserved[^a-z0-9]*(?!.)"
_HEAD = r"[^a-z0-9]*(?:portions )?(?:copyright|©|\(c\))"
_YEAR = r"(?:[0-9]{4}|<year>|\[yyyy\])"
# A clause ends before a grant, after the holder's sentence (not after initials, or where the holders go on) or with the line.
_GRANT = r"(?<![a-z0-9])(?=permission (?:is|to) |(?:this [a-z]+ is )?(?:licensed|released|distributed) under |redistribution and use |spdx-license-identifier)"
_STOP = r"(?<![^a-z][a-z])(?<![^a-z](?:jr|dr|st|mr|ms))\.(?=[ \t])(?![ \t]*(?:and |or |&|<|\())"
_END = rf"(?:{_GRANT}|{_STOP}|(?!.))"
# Any length of text without the end of a sentence: one sign at a time, so that the engine runs it as a loop.
_HOLDER_FIRST = rf"(?:(?!(?<!inc|ltd|llc)(?<!co)\.[ \t]).)+?{_YEAR}[.,;: \t]*{_END}"

#: The claim at the head of a copyright line: marked (c), or its year comes first, or last in the clause.
COPYRIGHT_CLAUSE = rf"(?s)^{_HEAD}(?:(?: *\(c\)| *©|[^a-z0-9]*?{_YEAR}).*?{_END}|{_HOLDER_FIRST})(?:[ \t.,;:]*all +rights +reserved[ \t.,;:]*)?"


def spelled(line: Column) -> Column:
    for word, instead in SPELLINGS:
        line = F.replace(line, F.lit(f" {word} "), F.lit(f" {instead} "))
    return line


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text; empty ones are dropped. Only texts that may claim copyright are cut up for that."""

    def lines(low: Column) -> Column:
        claims = low.contains("copyright") | low.contains("©") | low.contains("(c)") | low.contains("reserved")
        kept = F.filter(F.split(low, "\n", -1), lambda x: ~x.rlike(_RESERVED))
        cut = F.transform(kept, lambda x: F.when(x.rlike(COPYRIGHT_LINE), F.regexp_replace(x, COPYRIGHT_CLAUSE, "")).otherwise(x))
        words = F.regexp_replace(F.when(claims, F.array_join(cut, "\n")).otherwise(low), r"[^\p{L}\p{N}\n]+", " ")
        padded = F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
        return F.filter(F.transform(F.split(spelled(padded), "\n", -1), lambda x: F.btrim(x)), lambda x: x != "")

    # the lower-case text is a variable: an expression would be worked out wherever it stands
    return F.get(F.transform(F.array(ascii_lower(or_empty(text))), lines), F.lit(0))


def canonical_text(text: str) -> str:
    """The canonical form of a catalogue text, on the driver; equals ``canonical_lines`` joined by blanks."""
    out = []
    for line in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split("\n"):
        if not re.search(_RESERVED, line):
            line = re.sub(COPYRIGHT_CLAUSE, "", line) if re.search(COPYRIGHT_LINE, line) else line
            # letters and numbers as \p{L} and \p{N} define them
            words = " " + " ".join("".join(c if _is_word(c) else " " for c in line).split()) + " "
            for word, instead in SPELLINGS:
                words = words.replace(f" {word} ", f" {instead} ")
            out.append(words.strip(" "))
    return " ".join(x for x in out if x)


def _is_word(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] in "LN"


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def catalogue(texts: Mapping[str, str] = TEXTS, notices: Mapping[str, tuple] = NOTICES) -> tuple[dict[str, str], dict[str, str]]:
    """(digest of a whole text or notice -> licence, canonical notice -> licence)."""
    whole: dict[str, str] = {}
    lines: dict[str, str] = {}
    for name, forms in sorted(notices.items(), reverse=True):
        for form in forms:
            lines[canonical_text(form)] = name
            whole[digest_of(form)] = name
    for name, text in sorted(texts.items(), reverse=True):
        for form in forms_of(name, text):
            whole[digest_of(form)] = name
    if len(whole) > CATALOGUE_LIMIT:
        raise ValueError("the catalogue of licences is too large to broadcast")
    return whole, lines


ANCHOR_WORDS = 6


def blocks(texts: Mapping[str, str] = TEXTS) -> dict[str, dict[int, dict[str, str]]]:
    """Opening words of the catalogue's texts -> length of the canonical text -> digest -> licence."""
    out: dict[str, dict[int, dict[str, str]]] = {}
    for name, text in sorted(texts.items(), reverse=True):
        for form in forms_of(name, text):
            c = canonical_text(form)
            anchor = " ".join(c.split(" ")[:ANCHOR_WORDS])
            out.setdefault(anchor, {}).setdefault(len(c), {})[hashlib.sha256(c.encode()).hexdigest()] = name
    return out


def _from_openings(inside: Column, anchor: str, longest: int) -> Column:
    """What follows each place where the anchor stands, itself included, with the blank before it: as much as ``longest`` asks for.

    A part begins with the anchor, so few parts hold that much; and of each no more is copied than may be needed.
    """
    parts = F.split(inside, "(?= " + re.escape(anchor) + " )", -1)
    short = F.transform(parts, lambda x: F.substring(x, 1, longest + 2))
    few = -(-(longest + 2) // (len(anchor) + 1))

    def tails(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, few), ""))

    return F.filter(_once(short, tails), lambda x: x.startswith(f" {anchor} "))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digests_at(starts: Column, length: int) -> Column:
    """Digests of the first ``length`` characters after the blank, where a blank ends them."""
    whole = F.filter(starts, lambda x: F.substring(x, length + 2, 1) == " ")
    return F.transform(whole, lambda x: F.sha2(F.substring(x, 2, length), 256))


def _digests_of(lengths: Sequence[int]) -> Callable[[Column], Column]:
    return lambda starts: F.flatten(F.array(*[_digests_at(starts, n) for n in lengths]))


def _cover(anchors: Iterable[str]) -> list[str]:
    """Few words of which every anchor holds one: a text without them holds no anchor."""
    left, out = [set(a.split(" ")) for a in sorted(anchors)], []
    while left:
        best = max(sorted(set().union(*left)), key=lambda w: (sum(w in a for a in left), len(w)))
        out.append(best)
        left = [a for a in left if best not in a]
    return out


def embedded(canon: Column, known: Mapping[str, Mapping[int, Mapping[str, str]]]) -> Column:
    """Sorted licences whose whole canonical text stands in a canonical text, by the digests of what follows each of their openings."""
    names = F.create_map(*[F.lit(x) for by in known.values() for d in by.values() for kv in d.items() for x in kv])
    inside = F.concat(F.lit(" "), canon, F.lit(" "))
    likely = F.lit(False)
    for word in _cover(known):
        likely = likely | F.contains(canon, F.lit(word))
    none = F.expr("cast(array() as array<string>)")
    found = []
    for anchor, lengths in sorted(known.items()):
        found.append(F.when(F.contains(inside, F.lit(f" {anchor} ")), _once(_from_openings(inside, anchor, max(lengths)), _digests_of(sorted(lengths)))).otherwise(none))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.when(likely, F.concat(*found)).otherwise(none), lambda x: names[x]), lambda x: x.isNotNull())))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: Mapping[str, str] = TEXTS,
    notices: Mapping[str, tuple] = NOTICES,
) -> DataFrame:
    """One row per row of ``docs``: id, digest, n_lines (canonical), license (of the whole text, or null), blocks (sorted
    licences whose whole text stands somewhere in it) and notices (sorted licences of single lines)."""
    whole, lines = catalogue(texts, notices)
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(whole.items()) or [("-", "-")], "digest string, license string")
    line_set = [F.lit(x) for x in sorted(lines)]
    names = F.create_map(*[F.lit(x) for kv in sorted(lines.items()) for x in kv]) if lines else None
    longest = max(map(len, lines), default=0)
    canon = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    found = F.filter("lines", lambda x: (F.length(x) <= longest) & x.isin(*line_set)) if lines else F.expr("array()")
    inner = blocks(texts)
    joined = canon.select("id", "lines", F.array_join("lines", " ").alias("canon"))
    digested = joined.select(
        "id", F.size("lines").alias("n_lines"), F.sha2("canon", 256).alias("digest"),
        (embedded(F.col("canon"), inner) if inner else F.expr("cast(array() as array<string>)")).alias("blocks"),
        (F.array_sort(F.array_distinct(F.transform(found, lambda x: names[x]))) if lines else F.expr("cast(array() as array<string>)")).alias("notices"),
    )
    return digested.join(F.broadcast(known), "digest", "left").select(
        F.col("id").alias(id_col), "digest", F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("n_lines") > 0, F.col("license")).alias("license"), "blocks", "notices",
    )
