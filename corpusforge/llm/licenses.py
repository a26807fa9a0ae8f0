"""License scans by template markup compiled to token automata.

A template is a license text with ``<<opt>> ... <<end>>`` around wording that
may be missing, ``<<var>>`` where words of any kind and number may stand,
``<<var n>>`` where up to n may, and ``<<alt a | b>>`` where one of some wordings
must stand. All templates are compiled to one nondeterministic
automaton over words, which reads a text once. A place matches if every mandatory
word stands there in order, with nothing else between but what the markup allows.

Defined results: a null or empty text has no words and no labels; repeated
places count each; of tags, and of names with versions, that begin at one word the longest
counts (a tag of ``GPL-2.0-only`` is none of ``GPL-2.0``, and version 2.1 none of 2.0); where two starts of a template lead to the same place of it,
the later one counts, so a text is read in time in proportion to its words; a text
may carry several labels; texts are scanned whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm import common

# Phrases that the base scan counts, and public license wording.
BASE_PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

_AS_IS = """
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties
of merchantability fitness for a particular purpose and noninfringement in no event shall <<var>> be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software
"""
_MIT_GRANT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights
to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
the software is furnished to do so subject to the following conditions the above copyright notice and this permission
notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software
"""
_ISC_GRANT = """
permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies
"""
_ISC_AS_IS = """
the software is provided as is and <<var>> disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall <<var>> be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software
"""
_BSD_TWO = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright
notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution
"""
_BSD_NAME = """
<<opt>>3<<end>> neither the name of <<var>> nor the names of <<opt>>its<<end>> <<var>> contributors may be used to
endorse or promote products derived from this software without specific prior written permission
"""
_BSD_AS_IS = """
this software is provided by <<var>> as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var>> be liable for
any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use
of this software even if advised of the possibility of such damage
"""
_APACHE = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at <<opt>>http<<end>> <<opt>>https<<end>> www apache org licenses license 2 0
<<opt>>unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
as is basis without warranties or conditions of any kind either express or implied see the license for the specific language
governing permissions and limitations under the license<<end>>
"""
_GPL = """
is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either version %d of the license or at your option any later version <<var>>
is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu general public license for more details
"""
_ZLIB = """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this
software must not be misrepresented you must not claim that you wrote the original software if you use this software in a
product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must
be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or
altered from any source distribution
"""
_UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
commercial and by any means
"""

_LESSER, _AFFERO = (_GPL.replace("gnu general", f"gnu {kind} general") for kind in ("lesser", "affero"))
_BOOST = """
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license the software to use reproduce display distribute execute and transmit the software and
to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all
subject to the following the copyright notices in the software and this entire statement including the above license grant
this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all
derivative works of the software unless such copies or derivative works are solely in the form of machine executable object
code generated by a source language processor the software is provided as is without warranty of any kind express or implied
including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in
no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether
in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
software
"""
_ZERO_BSD = """
permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted
"""
_CC0_WAIVER = "to the extent possible under law <<var>> <<alt has | have>> waived all copyright and related or neighboring rights to"
_MPL = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
this file you can obtain one at <<opt>>http<<end>> <<opt>>https<<end>> <<alt mozilla org | www mozilla org>> mpl 2 0
"""
#: Licenses that are named with a version: label, ways to name it, versions.
_NAMED = [
    ("lgpl", "lgpl | gnu lgpl | gnu lesser general public license | gnu library general public license", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl | gnu agpl | gnu affero general public license", ("3.0",)),
    ("gpl", "gpl | gnu gpl", ("2.0", "3.0")),
    ("mpl", "mpl | mozilla public license", ("1.1", "2.0")),
    ("epl", "epl | eclipse public license", ("1.0", "2.0")),
    ("cddl", "cddl | common development and distribution license", ("1.0", "1.1")),
    ("bsl", "boost software license", ("1.0",)),
    ("cc0", "cc0", ("1.0",)),
    ("artistic", "artistic license", ("1.0", "2.0")),
]
_CC_KINDS, _CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Identifiers that a tag may name.
_SPDX = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSL-1.0 Zlib Unlicense Apache-1.1 Apache-2.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CC0-1.0 Artistic-2.0 WTFPL "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"
).split()


def _spoken(version: str) -> str:
    """A version as words: 2.1 is 2 1, and 3.0 may be 3 alone."""
    major, minor = version.split(".")
    return f"{major} {minor}" if minor != "0" else f"{major} <<opt>>0<<end>>"


def _by_rule() -> dict[str, tuple[float, str]]:
    """Templates of licenses that differ by their version or kind alone."""
    out = {}
    for label, names, versions in _NAMED:
        for v in versions:
            joined = " | ".join(f"{n.strip()}{gap}v{v.split('.')[0]}" for n in names.split("|") for gap in ("", " "))  # as in LGPLv2.1
            tail = "" if v.endswith(".0") else v.split(".")[1]
            out[f"{label}-{v}-named"] = (0.8, f"<<alt {names}>> <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> <<opt>>version<<end>> <<opt>>v<<end>> {_spoken(v)}")
            out[f"{label}-{v}-short"] = (0.8, f"<<alt {joined}>> {tail}")
    for kind in _CC_KINDS:
        for v in _CC_VERSIONS:
            under = "<<alt licensed under | released under | available under | distributed under | published under>> <<opt>>a<<end>> <<opt>>the<<end>> <<opt>>creative commons<<end>>"
            words = kind.replace("-", " ")
            out.setdefault(f"cc-{kind}-{v}-named", (0.8, f"{under} cc {words} {v}"))
            long = words.replace("by", "attribution").replace("sa", "sharealike").replace("nc", "noncommercial").replace("nd", "noderivatives")
            out[f"cc-{kind}-{v}-deed"] = (0.8, f"creative commons {long} {v} <<alt international | unported | generic>> <<opt>>public<<end>> license")
    for tag in _SPDX + [f"CC-{k.upper()}-{v}" for k in _CC_KINDS for v in _CC_VERSIONS]:
        out[f"spdx-{tag.lower()}"] = (0.9, f"spdx license identifier {tag.lower()}")
    return out


#: label: (score, template). Full texts score 1, a grant without its disclaimer 0.9, notices that name a license 0.8.
TEMPLATES = {
    "mit": (1.0, _MIT_GRANT + _AS_IS),
    "isc": (1.0, _ISC_GRANT + _ISC_AS_IS),
    "bsd-2-clause": (1.0, _BSD_TWO + _BSD_AS_IS),
    "bsd-3-clause": (1.0, _BSD_TWO + _BSD_NAME + _BSD_AS_IS),
    "apache-2.0-header": (1.0, _APACHE),
    "gpl-2.0-header": (1.0, _GPL.replace("%d", "2")),
    "gpl-3.0-header": (1.0, _GPL.replace("%d", "3")),
    **{f"{k}-header": (1.0, t.replace("%d", "2 1" if v == "2.1" else v[0])) for k, v, t in (("lgpl-2.1", "2.1", _LESSER), ("lgpl-3.0", "3.0", _LESSER), ("agpl-3.0", "3.0", _AFFERO))},
    "bsl-1.0": (1.0, _BOOST),
    "0bsd": (1.0, _ZERO_BSD + _ISC_AS_IS),
    "mpl-2.0-header": (1.0, _MPL),
    "cc0-1.0-waiver": (0.9, _CC0_WAIVER),
    "zlib": (1.0, _ZLIB),
    "unlicense": (1.0, _UNLICENSE),
    "mit-grant": (0.9, _MIT_GRANT),
    "isc-grant": (0.9, _ISC_GRANT),
    "bsd-conditions": (0.9, _BSD_TWO),
    "mit-notice": (0.8, "<<opt>>released<<end>> <<opt>>licensed<<end>> <<opt>>distributed<<end>> under the <<opt>>terms of the<<end>> mit license"),
    "apache-2.0": (0.8, "licensed under the apache license <<opt>>version<<end>> 2 0 <<opt>>the license you may not use this file except in compliance with the license<<end>>"),
    "gpl-2.0": (0.8, "gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 2 <<opt>>of the license<<end>> <<opt>>or at your option any later version<<end>>"),
    "gpl-3.0": (0.8, "gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3 <<opt>>of the license<<end>> <<opt>>or at your option any later version<<end>>"),
    "cc-by-4.0": (0.8, "licensed under <<opt>>a creative commons attribution license<<end>> cc by 4 0"),
    "cc-by-sa-4.0": (0.8, "licensed under <<opt>>a creative commons attribution license<<end>> cc by sa 4 0"),
    "cc-by-nc-4.0": (0.8, "licensed under <<opt>>a creative commons attribution license<<end>> cc by nc 4 0"),
    "cc-by-nd-4.0": (0.8, "licensed under <<opt>>a creative commons attribution license<<end>> cc by nd 4 0"),
    "mpl-2.0": (0.8, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    **_by_rule(),
    "copyright-notice": (0.6, "copyright <<opt>>c<<end>> <<var 12>> all rights reserved"),
}
BASE_SCORE = 0.5

_TAG = re.compile(r"<<(opt|end|var(?: \d+)?|alt [^>]*)>>")


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words: [0-9a-z] and everything outside ASCII."""
    return data.translate(common.ALNUM_WORDS).split()


def _family(label: str) -> str | None:
    """Labels of one family differ in how much of a version or tag they read; the longest is meant."""
    if label.startswith("spdx-"):
        return "spdx"
    return label.split("-")[0] if label.endswith(("-named", "-short")) else None


class TokenAutomaton:
    """One automaton for all templates; its states are places in them."""

    def __init__(self, templates: dict[str, str]):
        self.moves: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.skips: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        self.anchors: set[bytes] = set()
        firsts = [self._compile(label, template) for label, template in templates.items()]
        # where a word leads from a state, skips included
        closed = [self._closed(s) for s in range(len(self.moves))]
        self.next = [{w: self._joined(closed, to) for w, to in m.items()} for m in self.moves]
        self.other = [self._joined(closed, to) for to in self.any]
        self.starts: dict[bytes, tuple[int, ...]] = {}
        for first in firsts:
            for state in closed[first]:
                for w, to in self.next[state].items():
                    self.starts[w] = tuple({*self.starts.get(w, ()), *to})

    def _state(self) -> int:
        self.moves.append({})
        self.any.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _skip(self, at: int) -> int:
        new = self._state()
        self.skips[at].append(new)
        return new

    def _compile(self, label: str, template: str) -> int:
        at = first = self._state()
        opened: list[int] = []
        mandatory: list[bytes] = []
        for i, piece in enumerate(_TAG.split(template)):
            if i % 2 == 0:
                for w in words_of(piece.encode()):
                    new = self._state()
                    self.moves[at].setdefault(w, []).append(new)
                    at = new
                    if not opened:
                        mandatory.append(w)
            elif piece == "opt":
                at = self._skip(at)
                opened.append(at)
            elif piece == "end":
                self.skips[opened.pop()].append(at)
                at = self._skip(at)
            elif piece == "var":
                at = self._skip(at)
                self.any[at].append(at)
                at = self._skip(at)
            elif piece.startswith("alt "):
                end = self._state()
                for wording in piece[4:].split("|"):
                    here = self._skip(at)
                    for w in words_of(wording.encode()):
                        new = self._state()
                        self.moves[here].setdefault(w, []).append(new)
                        here = new
                    self.skips[here].append(end)
                at = end
            else:
                end = self._state()
                for _ in range(int(piece.split()[1])):
                    self.skips[at].append(end)
                    new = self._state()
                    self.any[at].append(new)
                    at = new
                self.skips[at].append(end)
                at = end
        choices = [p[4:].split("|") for p in _TAG.split(template)[1::2] if p.startswith("alt ")]
        if opened or not (mandatory or choices):
            raise ValueError(f"template {label}: unclosed region or no mandatory word")
        self.accepts[at] = label
        # a text without any of these words can't match: the longest mandatory one, or one of each wording
        self.anchors.update([max(mandatory, key=len)] if not choices or (mandatory and len(max(mandatory, key=len)) > 3) else [max(words_of(c.encode()), key=len) for c in choices[0]])
        return first

    def _closed(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    @staticmethod
    def _joined(closed: list[set[int]], states: list[int]) -> tuple[int, ...]:
        return tuple(sorted(set().union(*(closed[s] for s in states))))

    def may_match(self, data: bytes) -> bool:
        """Whether translated text holds some template's longest mandatory word."""
        return any(a in data for a in self.anchors)

    def places(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, past-the-last word), the longest of each label and start, in one pass."""
        found: dict[tuple[str, int], int] = {}
        starts, accepts = self.starts, self.accepts
        active: dict[int, int] = {}  # state: the latest start that leads there
        for i, w in enumerate(words):
            if not active and w not in starts:
                continue
            now: dict[int, int] = {}
            for state, start in active.items():
                for to in (*self.next[state].get(w, ()), *self.other[state]):
                    if now.get(to, -1) < start:
                        now[to] = start
            for to in starts.get(w, ()):
                now[to] = i
            for state, start in now.items():
                if state in accepts:
                    found[accepts[state], start] = i + 1
            active = now
        longest: dict[tuple[str, int], int] = {}
        for (label, i), j in found.items():
            if family := _family(label):
                longest[family, i] = max(longest.get((family, i), 0), j)
        return [(label, i, j) for (label, i), j in found.items() if j == longest.get((_family(label), i), j)]


@lru_cache(maxsize=1)
def _automata() -> tuple[TokenAutomaton, TokenAutomaton]:
    return TokenAutomaton(BASE_PHRASES), TokenAutomaton({k: t for k, (_, t) in TEMPLATES.items()})


def scan(text: bytes) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The number of words, the places of base phrases, and those of templates."""
    base, templates = _automata()
    data = text.translate(common.ALNUM_WORDS)
    words = data.split()
    return len(words), base.places(words) if base.may_match(data) else [], templates.places(words) if templates.may_match(data) else []


_PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_licenses(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), ``license_words``, and the places of both kinds."""

    def rows_of(places):
        return [{"label": label, "start": i, "end": j} for label, i, j in sorted(places, key=lambda p: (p[1], p[0]))]

    def run(texts: list[bytes]) -> list[list]:
        found = [scan(t) for t in texts]
        return [[n for n, _, _ in found], [rows_of(p) for _, p, _ in found], [rows_of(p) for _, _, p in found]]

    return common.map_text(df, text, keep, [("license_words", T.LongType()), ("base_places", _PLACES), ("template_places", _PLACES)], lambda: run)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    scores = F.create_map(*[F.lit(x) for k, (s, _) in TEMPLATES.items() for x in (k, s)])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, more = F.col("base_places.label"), F.col("template_places.label")
    return found.select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.start").cast("long").alias("first_word"),
        F.array_max("base_places.start").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.greatest(
            F.when(F.size(base) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)),
            F.coalesce(F.array_max(F.transform(more, lambda x: F.element_at(scores, x))), F.lit(0.0)),
        ).alias("score"),
    )
