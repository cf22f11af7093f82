"""License scans: template markup compiled to token automata.

A template is a whole licence text or a short notice with markup: ``[[...]]`` is an optional
region (may nest), and ``{{a-b}}`` a replaceable region of a to b free words. The template compiles to an automaton
over word hashes whose plain steps are the mandatory wording; a text is accepted where a
path spells all of it. Automata start only where the template's first mandatory words
stand, found for all texts of a block at once by rolling hashes.

Defined results for odd input: null counts as the empty text; texts without words have no
places, null first and last word and empty labels; repeated rows are judged on their own.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import NOT_ALNUM, Block, U, inside, member, per_block, windows

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licences in template markup, by label. What authors fill in is
#: a replaceable region, what some copies leave out an optional one.
AS_IS = "provided [[by]] [[the]] {{0-9}} as is and [[without]] any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NAMES = "[[3]] neither [[the name]] [[the names]] of {{1-10}} nor the names of {{1-4}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
NO_WARRANTY = "[[but]] without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {{0-2}} general public license for more details"
WHOLE = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice [[s]] and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{1-10}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause", f"{BSD_HEAD} this software is {AS_IS}"),
    ("bsd-3-clause", f"{BSD_HEAD} {BSD_NAMES} this software is {AS_IS}"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 [[txt]] [[html]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl-3.0-or-later", f"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version {{{{0-8}}}} is distributed in the hope that it will be useful {NO_WARRANTY}"),
    ("gpl-2.0-or-later", f"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version {{{{0-8}}}} is distributed in the hope that it will be useful {NO_WARRANTY}"),
    ("agpl-3.0-or-later", f"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version {{{{0-8}}}} is distributed in the hope that it will be useful {NO_WARRANTY}"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ),
]

#: Short notices, by label. A label may have several.
TEMPLATES = [
    ("mit", "[[this work is]] released under the [[terms of the]] mit license"),
    ("mit", "[[this work is]] licensed under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "[[this work is]] released under the apache license version 2 0"),
    ("gpl-3.0", "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2.0", "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation [[either]] version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation [[either]] version 2"),
    ("lgpl", "under the [[terms of the]] gnu lesser general public license"),
    ("agpl", "under the [[terms of the]] gnu affero general public license"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[the]] cc by nc sa 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 international [[license]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("copyright", "copyright [[c]] {{1-8}} all rights reserved"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
]

FIELDS = [
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
    ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
    ("notices", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))),
]


@cache
def word_hashes(words: tuple[str, ...]) -> np.ndarray:
    data = " ".join(words).encode()
    return Block(np.frombuffer(data, np.uint8), np.array([0, len(data)])).words(NOT_ALNUM).hashes()


class Automaton:
    """States 0..n; from each state the words it can read and the states reached for free."""

    def __init__(self, label: str, template: str, lead: int = 3):
        self.label = label
        self.read: list[tuple[int | None, int]] = []  # per step: hash (None: any word), state behind it
        self.free: dict[int, list[int]] = {}
        self.plain: list[int] = []  # steps of mandatory wording
        state, opened, n = 0, [], 0
        words: list[str] = []
        for token in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
            if token == "[[":
                opened.append(state)
            elif token == "]]":
                self.free.setdefault(opened.pop(), []).append(state)
            elif token[0] == "{":
                least, most = map(int, token[2:-2].split("-"))
                ends = []
                for i in range(most):
                    if i >= least:
                        ends.append(state)
                    self._step(state, None)
                    state += 1
                for e in ends:
                    self.free.setdefault(e, []).append(state)
            else:
                self._step(state, int(word_hashes((token,))[0]))
                if not opened:
                    self.plain.append(state)
                    words.append(token)
                state += 1
            n += 1
        self.last = state
        self.mandatory = len(self.plain)
        # the longest run of plain words at the first mandatory word, up to lead words
        run = 1
        while run < min(lead, len(self.plain)) and self.plain[run] == self.plain[run - 1] + 1 and self.plain[run - 1] + 1 not in self.free:
            run += 1
        self.lead = tuple(words[:run])
        self.start = self.plain[0]

    def _step(self, state: int, value: int | None) -> None:
        assert len(self.read) == state
        self.read.append((value, state + 1))

    def _closure(self, states: dict[int, int]) -> dict[int, int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for to in self.free.get(s, ()):
                if states.get(to, -1) < states[s]:
                    states[to] = states[s]
                    todo.append(to)
        return states

    def run(self, h: list[int]) -> tuple[int, int]:
        """Words read up to the first accepting end (0: none), most mandatory words spelled."""
        plain = set(self.plain)
        states, best = self._closure({self.start: 0}), 0
        for i, x in enumerate(h):
            then: dict[int, int] = {}
            for s, done in states.items():
                if s < self.last:
                    value, to = self.read[s]
                    if value is None or value == x:
                        done += s in plain
                        best = max(best, done)
                        if then.get(to, -1) < done:
                            then[to] = done
            states = self._closure(then)
            if self.last in states:
                return i + 1, best
            if not states:
                break
        return 0, best


@cache
def automata() -> list[Automaton]:
    return [Automaton(*t) for t in [*TEMPLATES, *WHOLE]]


def scan(block: Block, *_):
    w = block.words(NOT_ALNUM)
    h = w.hashes()
    n, row = block.n, w.row
    first_word, last_word = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    n_base = np.zeros(n, np.int64)
    base: dict[int, set[str]] = {}
    more: dict[int, set[str]] = {}
    notices: dict[int, list[dict]] = {}
    score = np.zeros(n)
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(words: tuple[str, ...]) -> np.ndarray:
        k = len(words)
        if k not in grams:
            grams[k] = (windows(h, k), inside(row, k))
        key, ok = grams[k]
        want = windows(word_hashes(words), k)
        return np.flatnonzero(member(key, want) & ok)

    for phrase, label in PHRASES.items():
        at = places(tuple(phrase.split()))
        r = row[at]
        local = at - w.first[:-1][r]
        np.add.at(n_base, r, 1)
        np.minimum.at(first_word, r, local)
        np.maximum.at(last_word, r, local)
        for i in np.unique(r).tolist():
            base.setdefault(i, set()).add(label)
            score[i] = max(score[i], 0.5)
    for a in automata():
        longest = len(a.read)
        for at in places(a.lead).tolist():
            i = int(row[at])
            length, done = a.run(h[at : min(at + longest, int(w.first[i + 1]))].tolist())
            share = done / a.mandatory
            if length:
                more.setdefault(i, set()).add(a.label)
                notices.setdefault(i, []).append({"label": a.label, "first_word": at - int(w.first[i]), "n_words": length})
            # unfinished wording counts less than any complete notice
            score[i] = max(score[i], 1.0 if length else 0.9 * share)
    join = lambda x: ",".join(sorted(x))
    none = n_base == 0
    return [
        w.count, n_base, pa.array(np.where(none, 0, first_word), mask=none), pa.array(np.where(none, 0, last_word), mask=none),
        [join(base.get(i, ())) for i in range(n)], [join(base.get(i, set()) | more.get(i, set())) for i in range(n)], score,
        [sorted(notices.get(i, []), key=lambda x: (x["first_word"], x["label"])) for i in range(n)],
    ], None


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base phrase places, labels, score and the notices with their places."""
    return per_block(docs, [id_col], text_col, scan, FIELDS, lower=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("notices")
