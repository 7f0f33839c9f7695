"""Licence scans by a positional rare-token index.

Licence texts, notices and short statements are indexed by word and position. How rare a word is comes from
the corpus: one pass counts, for the words of the index alone, the documents that hold them. A file's licence
words are then looked up from the rarest down. A template whose mandatory key phrases can stand in the
file takes the first few of those words that it has; each of their postings gives a place where it would have to start, and it
is a candidate where they agree on that place. A candidate counts if its key phrases stand in the
file there, and the share of its words found around gives its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_text, table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, text and key phrases of well-known licence statements and of the openings of licence texts.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses license 2 0")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("terms of the gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification")),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    ("cc-by", "this work is licensed under the creative commons attribution license", ("creative commons attribution license",)),
)
#: Label, full text and key phrases of licences that are short enough to be put in whole; fixed by their authors. Names and years are left out.
FULL_TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee is hereby granted",)),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", ("redistributions of source code must retain", "used to endorse or promote products", "without specific prior written permission")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""", ("origin of this software must not be misrepresented", "altered source versions must be plainly marked")),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""", ("any person or organization obtaining a copy", "generated by a source language processor")),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""", ("free and unencumbered software", "detriment of our heirs and successors")),
    ("wtfpl", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""", ("do what the fuck you want to",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2 0", "in compliance with the license")),
    ("gpl-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""", ("terms of the gnu general public license", "free software foundation")),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2 0",)),
    ("epl-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""", ("eclipse public license 2 0",)),
)
#: Of the file's rarest licence words so many vote on a template's place, and this share of them must agree.
RARE = 4
AGREE = 0.6
#: Words by which parts of a template may be shifted against each other: so many, or this share of its length.
SHIFT = 3
SHIFT_SHARE = 0.05
#: Least share of a template's words that must stand around the place.
LEAST_SHARE = 0.7


@dataclass
class Template:
    label: str
    words: list[str]
    keys: list[list[str]]
    exact: bool
    #: the words of the key phrases; a file without one of them has no such statement
    needed: frozenset[str]


@dataclass
class Index:
    templates: list[Template]
    #: word -> template -> its positions there
    postings: dict[str, dict[int, list[int]]]
    #: how rare each word is: the larger, the rarer
    idf: dict[str, float]


def build_index(phrases: dict[str, str] = PHRASES, templates: Sequence[tuple] = (*TEMPLATES, *FULL_TEXTS), frequencies: dict[str, int] | None = None, documents: int = 0) -> Index:
    """The positional index of all words of all templates.

    ``frequencies`` says how many of ``documents`` hold each word; without it, templates are counted instead. Which words are looked up follows from it, what is found there is verified all the same.
    """
    made = [Template(label, p.split(), [p.split()], True, frozenset(p.split())) for p, label in phrases.items()]
    for label, text, keys in templates:
        split = [k.split() for k in keys]
        made.append(Template(label, file_words(text), split, False, frozenset(w for k in split for w in k)))
    postings: dict[str, dict[int, list[int]]] = defaultdict(dict)
    for i, t in enumerate(made):
        for k, w in enumerate(t.words):
            postings[w].setdefault(i, []).append(k)
    df = {w: len(at) for w, at in postings.items()} if frequencies is None else frequencies
    n = len(made) if frequencies is None else documents
    return Index(made, dict(postings), {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in postings})


@lru_cache(maxsize=1)
def default_index() -> Index:
    return build_index()


def file_words(text: str) -> list[str]:
    """Words of the text with A-Z, and no other letters, lower-cased."""
    return WORDS.findall(text.encode().lower().decode())


def _stands(words: list[str], phrase: list[str], start: int, stop: int) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + n] == phrase for i in range(max(0, start), min(stop, len(words) - n + 1)))


def scan_words(words: list[str], index: Index) -> tuple[list[tuple[str, int]], dict[str, float]]:
    """Places (label, first word) of the base phrases, and the best score of every label found."""
    templates = index.templates
    licence_words = set(words) & index.postings.keys()
    if not licence_words:
        return [], {}
    possible = {i for i, t in enumerate(templates) if t.needed <= licence_words}
    # from the file's rarest licence word down: a template takes the first ones that it has, a phrase of the base the first
    chosen: dict[int, list[str]] = {}
    for w in sorted(licence_words, key=lambda w: (-index.idf[w], w)):
        for t in index.postings[w]:
            if t in possible and len(chosen.setdefault(t, [])) < (1 if templates[t].exact else RARE):
                chosen[t].append(w)
    takers: dict[str, list[int]] = defaultdict(list)
    for t, of in chosen.items():
        for w in of:
            takers[w].append(t)
    votes: dict[int, Counter] = defaultdict(Counter)
    for at, w in enumerate(words):
        for t in takers.get(w, ()):
            for k in index.postings[w][t]:
                votes[t][at - k] += 1
    places: list[tuple[str, int]] = []
    scores: dict[str, float] = {}
    for t, starts in votes.items():
        template = templates[t]
        n = len(template.words)
        if template.exact:
            found = [s for s in starts if s >= 0 and words[s : s + n] == template.words]
            places += [(template.label, s) for s in found]
            if found:
                scores[template.label] = 1.0
            continue
        need = math.ceil(AGREE * len(chosen[t]))
        shift = max(SHIFT, int(SHIFT_SHARE * n))
        near = deque()
        ordered = sorted(starts)
        ahead = 0
        total = 0
        own = Counter(template.words)
        for s in ordered:
            while ahead < len(ordered) and ordered[ahead] <= s + shift:
                near.append(ordered[ahead])
                total += starts[ordered[ahead]]
                ahead += 1
            while near[0] < s - shift:
                total -= starts[near.popleft()]
            if total < need or scores.get(template.label, 0.0) == 1.0:
                continue
            a, b = s - shift, s + n + shift
            if not all(_stands(words, k, a, b) for k in template.keys):
                continue
            share = sum((own & Counter(words[max(0, a) : max(0, b)])).values()) / n
            if share >= LEAST_SHARE:
                scores[template.label] = max(scores.get(template.label, 0.0), share)
    return places, scores


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan_text(text: str, index: Index) -> tuple:
    words = file_words(text)
    places, scores = scan_words(words, index)
    starts = [s for _, s in places]
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for label, _ in places})),
        ",".join(sorted(scores)),
        max(scores.values(), default=0.0),
    )


def word_frequencies(df: DataFrame, vocabulary: frozenset[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """How many of all documents hold each word of the vocabulary, and how many documents there are.

    Tasks count within their batches; what is shuffled and collected is bounded by the vocabulary, a few hundred words of the index.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                held.update(vocabulary.intersection(file_words(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}, df.count()


def scan_documents(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), index: Index | None = None) -> DataFrame:
    """Licence statements of every whole text, in one narrow pass after one that counts the index's words (none with an ``index`` given).

    Null and empty texts have no words and no labels: zero counts, null places, empty strings, score
    0. Equal texts get equal rows. Other columns go; kept ones named as a result give way. An empty table gives an empty one. The index has a few
    thousand postings, whatever the data.
    """
    if index is None:
        index = build_index()
        frequencies, n = word_frequencies(df, frozenset(index.postings), text_col)
        index = build_index(frequencies=frequencies, documents=n)
    use = index

    def make():
        return lambda texts: [list(c) for c in zip(*(scan_text(t, use) for t in texts), strict=True)]

    return map_text(df, make, RESULT, text_col, keep)


def op7_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all ``documents``; nulls, empty and long texts as in scan_documents."""
    return scan_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_rare_token_index": op7_rare_token_index}
ORACLES: dict[str, str] = {}
