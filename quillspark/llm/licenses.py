"""License scans: an exact set-similarity join of text blocks with license templates, in built-in functions only.

Words: the text with A-Z lower-cased, runs of letters, digits and anything beyond ASCII. Templates are of any length, whole license
texts included. Each is searched for in blocks of its own size: `step` is the smallest power of two (`LEAST_STEP` or more) with
at most step + 1 words in the template; a block has 2 * step words and one begins at every step-th word, so that any step + 1
consecutive words stand together in some block (a text of one block or less is one). Template and block are compared as sets of
words: a template is found if a block holds at least `threshold` of its distinct words. A row needs nothing from other rows but
the global word frequencies.

How the join is pruned, without losing a match:
* frequencies: how many documents hold each template word (words in no template can't count). One aggregate over all
  documents with a row for each template word, which is why it is collected.
* both sides are ordered from rare to frequent. If at least `need` words are common, the first
  `len(template) - need + 1` words of the template meet the block (prefix filter).
* length filter: a block with fewer than `need` template words is out.
* positional filter: at the first common word, what is left on the shorter side must still reach `need`.
* what remains is verified by the size of the intersection.

Base labels: places where the words of a phrase stand consecutively.

Defined results: null text is empty: no words, no labels ("" for both label columns), score 0.0. Texts of any length are
scanned whole; a text holds the memory of its words. Rows are judged each on its own, so ties, repeated rows and null ids
pass through. Further columns are left out unless named in `keep`. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the labels they give.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Widely used license notices and texts, and the labels they give.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
        OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("all-rights-reserved", "All rights reserved"),
)

THRESHOLD = 0.9
LEAST_STEP = 8


def word_list(text: str) -> list[str]:
    """The same words, of a template."""
    import re

    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words_column(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Array of (start, label), only computed where the last word of some phrase occurs."""
    split = [(p.split(" "), label) for p, label in phrases]
    at = lambda i, k: F.get(words, (i + F.lit(k)).cast("int"))

    def label(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for parts, name in split:
            cond = F.lit(True)
            for k, w in enumerate(parts):
                cond = cond & F.coalesce(at(i, k) == F.lit(w), F.lit(False))
            out = F.when(cond, F.lit(name)).otherwise(out)
        return out

    starts = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.cast("long").alias("start"), label(i).alias("label")))
    last = F.array(*[F.lit(x) for x in sorted({parts[-1] for parts, _ in split})])
    return F.when(F.arrays_overlap(words, last), F.filter(starts, lambda s: s["label"].isNotNull())).otherwise(
        F.array().cast("array<struct<start:bigint,label:string>>")
    )


def step_of(n_words: int) -> int:
    """Words between the beginnings of the blocks in which a template is searched for."""
    return max(LEAST_STEP, 1 << max(0, n_words - 2).bit_length())


def template_sets(templates: Sequence[tuple[str, str]]) -> list[tuple[str, frozenset[str], int]]:
    """(label, distinct words, step) of each."""
    out = [(label, frozenset(w := word_list(text)), step_of(len(w))) for label, text in templates]
    if not all(s for _, s, _ in out):
        raise ValueError("a template has words")
    return out


def read_templates(table: DataFrame) -> list[tuple[str, str]]:
    """Templates from a table of label, text; they become part of the plan, so thousands are too many. Null rows are left out."""
    rows = table.where("label is not null and text is not null").select("label", "text").distinct().collect()
    return sorted((r["label"], r["text"]) for r in rows)


def frequencies(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows each word of the vocabulary stands. A row for each template word comes back, whatever the input."""
    hit = F.array_intersect(F.col("words"), F.array(*map(F.lit, vocabulary)))
    rows = words.select(F.explode(hit).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The columns of `keep`, n_words, places (start, label), matches (label, containment)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    worded = docs.select(*keep, words_column(docs[text]).alias("words"))
    sets = template_sets(templates)
    vocabulary = sorted(frozenset().union(*(s for _, s, _ in sets)))
    df = frequencies(worded, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df.get(w, 0), w)))}
    words = F.col("words")
    found = [_matches(words, [x for x in sets if x[2] == step], step, rank, threshold) for step in sorted({x[2] for x in sets})]
    matches = F.array_distinct(F.concat(*found))
    return worded.select(
        *keep, F.size(words).cast("long").alias("n_words"), _places(words, phrases).alias("places"), matches.alias("matches")
    )


def _matches(words: Column, sets: list[tuple[str, frozenset[str], int]], step: int, rank: dict[str, int], threshold: float) -> Column:
    """Array of (label, containment): the templates of one step that some block holds."""
    needs = [max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s, _ in sets]
    ordered = [sorted(rank[w] for w in s) for _, s, _ in sets]
    name = {r: w for w, r in rank.items()}
    index: dict[int, list[tuple[int, int]]] = {}
    for t, (ranks, need) in enumerate(zip(ordered, needs, strict=True)):
        for pos, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.setdefault(r, []).append((t, pos))

    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    table = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(need).alias("need"), ints(ranks).alias("ranks"))
        for t, ((label, _, _), need, ranks) in enumerate(zip(sets, needs, ordered, strict=True))
    ])
    prefix_words = F.array(*[F.lit(name[r]) for r in sorted(index)])
    posting = F.create_map(*[
        x for r, entries in sorted(index.items())
        for x in (F.lit(r), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("pos")) for t, p in entries]))
    ])
    own = sorted({r for ranks in ordered for r in ranks})
    to_rank = F.create_map(*[x for r in own for x in (F.lit(name[r]), F.lit(r))])
    vocab = F.array(*[F.lit(name[r]) for r in own])
    least, size = min(needs), 2 * step

    n_blocks = F.greatest(F.lit(1), F.ceil((F.size(words) - F.lit(size)) / F.lit(float(step))).cast("int") + 1)
    block_words = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice(words, k * step + 1, size))
    met = F.filter(block_words, lambda b: F.arrays_overlap(b, prefix_words))
    blocks = F.filter(
        F.transform(met, lambda b: F.array_sort(F.transform(F.array_intersect(b, vocab), lambda w: F.element_at(to_rank, w)))),
        lambda b: F.size(b) >= least,
    )

    def candidates(block: Column) -> Column:
        """Templates met in the prefix at a place from which `need` can still be reached."""
        size_of = lambda t: F.size(F.element_at(table, t + 1)["ranks"])
        probed = F.flatten(F.transform(block, lambda r, i: F.transform(
            F.coalesce(F.element_at(posting, r), F.array().cast("array<struct<t:int,pos:int>>")),
            lambda e: F.struct(
                e["t"].alias("t"),
                (F.least(size_of(e["t"]) - e["pos"], F.size(block) - i.cast("int"))).alias("bound"),
            ),
        )))
        return F.array_distinct(F.transform(
            F.filter(probed, lambda e: e["bound"] >= F.element_at(table, e["t"] + 1)["need"]), lambda e: e["t"]
        ))

    def verified(block: Column) -> Column:
        found = F.transform(candidates(block), lambda t: F.struct(
            F.element_at(table, t + 1)["label"].alias("label"),
            (F.size(F.array_intersect(block, F.element_at(table, t + 1)["ranks"])) / F.size(F.element_at(table, t + 1)["ranks"])).alias("containment"),
            (F.size(F.array_intersect(block, F.element_at(table, t + 1)["ranks"])) >= F.element_at(table, t + 1)["need"]).alias("ok"),
        ))
        return F.transform(F.filter(found, lambda m: m["ok"]), lambda m: F.struct(m["label"].alias("label"), m["containment"].alias("containment")))

    none = F.array().cast("array<struct<label:string,containment:double>>")
    return F.when(F.arrays_overlap(words, prefix_words), F.array_distinct(F.flatten(F.transform(blocks, verified)))).otherwise(none)


def labelled(scan: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a scan."""
    starts = F.transform(F.col("places"), lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform(F.col("places"), lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform(F.col("matches"), lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform(F.col("matches"), lambda m: m["containment"])), F.lit(0.0))
    return scan.select(
        *keep,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
