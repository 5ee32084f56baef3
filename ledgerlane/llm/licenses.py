"""License scan by template markup.

A template is a text of words with marks, after the markup used for license lists:
``[words]`` is a region taken as a whole or left out, ``(this|that)`` a region with a choice of
wordings, and ``{n}`` stands for up to n words of any kind (names, years). Regions may
hold regions and places. A template is compiled into an automaton over words without
loops; a text is accepted where all mandatory words stand in order, with only optional
regions left out, only replaceable ones chosen and only free places filled freely. The
longest accepted stretch from a start is kept, so optional parts are taken where present.

FULL holds whole licenses and whole notices: one word altered, added or left out in the
mandatory wording, and the text is not accepted. NOTICES are references in one line. PARTIAL holds
openings of licenses; one is reported, with its own label, only where no text of FULL
is accepted from the same word. Words after an accepted stretch are not judged.

Automata run only from words that can begin a template, found by comparing hash arrays of
whole batches; each hash hit is confirmed by the word's bytes. Sets of states are made
deterministic as texts need them and are kept for the next text, so a step costs one
dictionary lookup; words outside the template share one entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import words as W
from ledgerlane.llm.jobs import ready

#: The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_AS_IS = "(as is|“as is”|‘as is’)"
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[1|a] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[2|b] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_THIRD = (
    "[3|c] neither the (name|names) of {12} nor the names of (its|their|the) contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission "
)
_BSD_DISCLAIMER = (
    f"this software is provided by {{12}} {_AS_IS} and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage"
)
_MIT_WARRANTY = (
    f"the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall {12} be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] "
    "to deal in the software without restriction"
)
_MIT_RIGHTS = (
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so"
)


def _gnu_notice(license: str, versions: str, later: bool) -> str:
    """The notice that files under a GNU license carry; ``later`` allows later versions."""
    name, issued = f"gnu {license}", "as published by the free software foundation"
    if later:
        which = f"the {name} {issued} either version {versions} of the license or [at your option] any later version"
    else:
        which = f"(the {name} {issued} version {versions} [of the license]|the {name} version {versions} {issued}|version {versions} of the {name} {issued})"
    return (
        f"(program|library|software|file) is free software you can redistribute it and or modify it under the terms of {which} "
        "{4} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        f"merchantability or fitness for a particular purpose see the {name} for more details"
    )


_GPL, _LGPL, _AGPL = "general public license", "(lesser|library) general public license", "affero general public license"

#: Label and template of whole licenses and notices, lower case. No template begins with a free place.
FULL = (
    ("mit-text", f"{_MIT_GRANT} {_MIT_RIGHTS} subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software {_MIT_WARRANTY}"),
    ("mit-0-text", f"{_MIT_GRANT} {_MIT_RIGHTS} {_MIT_WARRANTY}"),
    ("bsd-2-clause-text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-clause-text", _BSD_CONDITIONS + _BSD_THIRD + _BSD_DISCLAIMER),
    ("isc-text", f"permission to use copy modify (and|and or) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided {_AS_IS} and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("0bsd-text", f"permission to use copy modify (and|and or) distribute this software for any purpose with or without fee is hereby granted the software is provided {_AS_IS} and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib-text", f"this software is provided {_AS_IS} without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [1] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be removed or altered from any source distribution"),
    ("apache-2.0-notice", f"licensed under the apache license version 2 0 the (license|“license”) you may not use (this file|this work|these files) except in compliance with the license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an {_AS_IS} basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2.0-or-later-notice", _gnu_notice(_GPL, "2", later=True)),
    ("gpl-2.0-only-notice", _gnu_notice(_GPL, "2", later=False)),
    ("gpl-3.0-or-later-notice", _gnu_notice(_GPL, "3", later=True)),
    ("gpl-3.0-only-notice", _gnu_notice(_GPL, "3", later=False)),
    ("lgpl-2.0-or-later-notice", _gnu_notice(_LGPL, "2", later=True)),
    ("lgpl-2.1-or-later-notice", _gnu_notice(_LGPL, "2 1", later=True)),
    ("lgpl-3.0-or-later-notice", _gnu_notice(_LGPL, "3", later=True)),
    ("agpl-3.0-or-later-notice", _gnu_notice(_AGPL, "3", later=True)),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at (http|https) mozilla org mpl 2 0"),
)

_CC = "licensed under [a|the] [creative commons] cc by"
#: Label and template of references.
NOTICES = (
    ("apache-2.0", "licensed under the apache license [version] 2 [0] [the license]"),
    ("gpl-3.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3 [or later]"),
    ("gpl-2.0", "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2 [or later]"),
    ("lgpl", "licensed under the [terms of the] gnu lesser general public license [version (2|2 1|3|3 0)] [or later]"),
    ("mit", "released under the [terms of the] mit license"),
    ("mit", "licensed under the [terms of the] mit license"),
    ("bsd", "licensed under the [terms of the] [new|modified|simplified|2 clause|3 clause|two clause|three clause] bsd [2 clause|3 clause] license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license [v] [version] 2 0"),
    ("cc-by-nc", f"{_CC} nc [sa|nd] [4 0|3 0]"),
    ("cc-by-sa", f"{_CC} sa [4 0|3 0]"),
    ("cc-by-nd", f"{_CC} nd [4 0|3 0]"),
    ("cc0", "licensed under [a|the] [creative commons] cc0 [1 0] [universal]"),
    ("all-rights-reserved", "copyright [c] {6} all rights reserved"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("gpl-2.0", "spdx license identifier gpl 2 0 [only|or later]"),
    ("gpl-3.0", "spdx license identifier gpl 3 0 [only|or later]"),
    ("isc", "spdx license identifier isc"),
    ("mit", "spdx license identifier mit"),
    ("mpl-2.0", "spdx license identifier mpl 2 0"),
)

#: Label and opening of licenses whose whole text is in FULL.
PARTIAL = (
    ("mit-partial", _MIT_GRANT),
    ("bsd-partial", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc-partial", "permission to use copy modify (and|and or) distribute this software for any purpose with or without fee is hereby granted"),
    ("gnu-partial", "(program|library|software|file) is free software you can redistribute it and or modify it under the terms of (the|version {2} of the) gnu [lesser|library|affero] general public license"),
)
#: Score of a document whose best evidence is an opening, or bare phrases.
PARTIAL_SCORE = 0.5
PHRASE_SCORE = 0.25
#: Sets of states an automaton keeps between texts; beyond it, they are made anew.
KEPT_SETS = 20_000

Templates = tuple[tuple[str, str], ...]


class Automaton:
    """The automaton of one template; states are numbers, and every edge leads forward.

    ``edges[s]`` lists (word or None for any word, next state), ``skips[s]`` the states
    reached without a word. ``mandatory`` is the least number of template words in any
    accepted stretch, ``first`` the words that every accepted stretch begins with.
    """

    def __init__(self, label: str, template: str) -> None:
        self.label = label
        self.edges: list[list[tuple[bytes | None, int]]] = []
        self.skips: list[list[int]] = []
        self._tokens = re.findall(r"[\[\]()|]|\{\d+\}|[^\s\[\](){}|]+", template)
        if "".join(self._tokens) != "".join(template.split()):
            raise ValueError(f"marks of a template do not fit: {template}")
        self._at = 0
        self.end, self.mandatory = self._sequence(self._state())
        if self._at < len(self._tokens):
            raise ValueError(f"regions of a template do not close: {template}")
        self.words = {w for edges in self.edges for w, _ in edges if w is not None}
        self._forget()
        live = self._closed({0})
        if self.end in live or any(w is None for s in live for w, _ in self.edges[s]):
            raise ValueError(f"a template must begin with a word of its own: {template}")
        #: Words that can come first, each with the one that must follow it, if only one can.
        self.first = sorted({(w, *self._next(self._closed({t}))) for s in live for w, t in self.edges[s]})

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _sequence(self, at: int) -> tuple[int, int]:
        """Reads up to a closing mark or a bar; its last state and its least number of words."""
        least = 0
        while self._at < len(self._tokens) and self._tokens[self._at] not in ("]", ")", "|"):
            token = self._tokens[self._at]
            self._at += 1
            after = self._state()
            if token in ("[", "("):
                words = self._region(at, after, "]" if token == "[" else ")")
                if token == "[":
                    self.skips[at].append(after)
                else:
                    least += words
            elif token.startswith("{"):
                self.skips[at].append(after)
                for _ in range(int(token[1:-1])):
                    filled = self._state()
                    self.edges[at].append((None, filled))
                    self.skips[filled].append(after)
                    at = filled
            else:
                self.edges[at].append((token.encode(), after))
                least += 1
            at = after
        return at, least

    def _region(self, start: int, after: int, closing: str) -> int:
        """Reads wordings divided by bars, up to ``closing``; the least number of words of any."""
        least = []
        while True:
            # Each wording has a first state of its own, so that none runs into another.
            own = self._state()
            self.skips[start].append(own)
            last, words = self._sequence(own)
            self.skips[last].append(after)
            least.append(words)
            mark = self._tokens[self._at] if self._at < len(self._tokens) else ""
            self._at += 1
            if mark == closing:
                return min(least)
            if mark != "|":
                raise ValueError(f"a region is not closed by {closing}")

    def _closed(self, live: set[int]) -> frozenset[int]:
        todo, out = list(live), set(live)
        while todo:
            new = [t for t in self.skips[todo.pop()] if t not in out]
            out.update(new)
            todo += new
        return frozenset(out)

    def _next(self, live: frozenset[int]) -> list[bytes]:
        words = {w for s in live for w, _ in self.edges[s]}
        return [*words] if len(words) == 1 and None not in words and self.end not in live else []

    def _forget(self) -> None:
        start = self._closed({0})
        self._sets, self._number = [start], {start: 0}
        self._accepts, self._steps = [self.end in start], [{}]

    def _step(self, n: int, word: bytes | None) -> int:
        """The number of the set after ``word`` (None: a word that the template does not have); -1 for none."""
        reached = {t for s in self._sets[n] for w, t in self.edges[s] if w is None or w == word}
        if not reached:
            out = -1
        else:
            live = self._closed(reached)
            out = self._number.setdefault(live, len(self._sets))
            if out == len(self._sets):
                self._sets.append(live)
                self._accepts.append(self.end in live)
                self._steps.append({})
        self._steps[n][word] = out
        return out

    def longest(self, words: Iterator[bytes]) -> int | None:
        """Length of the longest accepted stretch at the beginning of ``words``, read only as far as needed."""
        if len(self._sets) > KEPT_SETS:
            self._forget()
        n, best = 0, None
        for length, word in enumerate(words, 1):
            known = word if word in self.words else None
            n = self._steps[n][known] if known in self._steps[n] else self._step(n, known)
            if n < 0:
                break
            if self._accepts[n]:
                best = length
        return best


def _hash_word(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    found = W.find_words(data, np.array([0, len(data)]), W.alphanumeric(), lower=False)
    return found.hashes()[0]


class Scanner:
    """Phrases and templates made ready to search pieces of text."""

    def __init__(self, phrases: dict[str, str], templates: Templates, partial: Templates) -> None:
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        self.hash = {w: _hash_word(w) for ws, _ in self.phrases for w in ws}
        # An automaton is run from the places of the one or two words that it begins with.
        self.firsts: dict[tuple[bytes, ...], list[tuple[Automaton, bool]]] = {}
        for group, opening in ((templates, False), (partial, True)):
            for label, template in group:
                automaton = Automaton(label, template)
                for first in automaton.first:
                    self.firsts.setdefault(first, []).append((automaton, opening))
                    self.hash |= {w: _hash_word(w) for w in first}

    def _places(self, found: W.Words, hashes: np.ndarray, sequence: list[bytes]) -> np.ndarray:
        """Word numbers where the sequence stands within one text."""
        at = np.flatnonzero(hashes == self.hash[sequence[0]])
        for j, word in enumerate(sequence[1:], 1):
            at = at[at + j < len(hashes)]
            at = at[hashes[at + j] == self.hash[word]]
        if not len(at):
            return at
        text = np.searchsorted(found.first, at, "right") - 1
        at = at[at + len(sequence) <= found.first[text + 1]]
        return np.array([i for i in at if all(found.word(i + j) == w for j, w in enumerate(sequence))], np.int64)

    def scan(self, found: W.Words) -> list[dict]:
        hashes = found.hashes()
        out = [
            {"n_words": int(n), "places": [], "spans": [], "score": 0.0} for n in found.counts
        ]
        for sequence, label in self.phrases:
            at = self._places(found, hashes, sequence)
            for i, t in zip(at, np.searchsorted(found.first, at, "right") - 1, strict=True):
                out[t]["places"].append((int(i - found.first[t]), label))
        for first, automata in self.firsts.items():
            at = self._places(found, hashes, list(first))
            for i, t in zip(at, np.searchsorted(found.first, at, "right") - 1, strict=True):
                base, end = int(found.first[t]), int(found.first[t + 1])
                for automaton, opening in automata:
                    size = automaton.longest(found.word(j) for j in range(i, end))
                    if size is not None:
                        start = int(i) - base
                        out[t]["spans"].append((automaton.label, start, start + size, automaton.mandatory, opening))
        for r in out:
            whole = {start for _, start, _, _, opening in r["spans"] if not opening}
            kept = {x[:4] if not x[4] else (*x[:3], 0) for x in r["spans"] if not (x[4] and x[1] in whole)}
            r["spans"] = sorted(kept)
            strong = max((m for *_, m in r["spans"]), default=0)
            # Bare phrases and openings are weak evidence; an accepted template grows with its mandatory words.
            weak = PARTIAL_SCORE if r["spans"] else PHRASE_SCORE if r["places"] else 0.0
            r["score"] = max(weak, 1 - 0.5 ** (strong / 2)) if strong else weak
        return out


_OUT = (
    "n_words bigint, places array<struct<start:bigint,label:string>>, "
    "template_spans array<struct<label:string,start:bigint,end:bigint>>, score double"
)


def scan(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: Templates = FULL + NOTICES,
    partial: Templates = PARTIAL,
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: the key, its words, phrase places and template spans.

    Columns: ``key``, n_words, places (start word, label; by start), template_spans
    (label, start, end in words, end exclusive), score. Score is 0 without evidence, 0.25
    for phrases alone, 0.5 for an opening alone, else 1 - 0.5 ** (m / 2), at least 0.5
    beside an opening, with m mandatory words of the best template. Null and empty texts have no words; repeated rows and keys, null keys
    included, are scanned row by row; other columns are not read.
    """
    ready(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, partial)
        for batch in batches:
            for low, high, found in W.word_pieces(batch.column(1), W.alphanumeric(), lower=True):
                rows = scanner.scan(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array([r["n_words"] for r in rows], pa.int64()),
                        pa.array(
                            [[{"start": s, "label": x} for s, x in sorted(r["places"])] for r in rows],
                            pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])),
                        ),
                        pa.array(
                            [[{"label": x, "start": s, "end": e} for x, s, e, _ in r["spans"]] for r in rows],
                            pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
                        ),
                        pa.array([r["score"] for r in rows], pa.float64()),
                    ],
                    names=["key", "n_words", "places", "template_spans", "score"],
                )

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, {_OUT}").withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.array_sort(
        F.array_distinct(F.concat(base, F.transform("template_spans", lambda s: s["label"])))
    )
    return found.select(
        key,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(more, ",").alias("labels"),
        "score",
    )
