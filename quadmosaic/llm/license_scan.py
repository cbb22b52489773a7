"""License scans: an exact set-similarity join between text blocks and license templates.

Texts are cut into overlapping blocks of words; how long they are follows from a template's length. A block matches a template if it has at least
``threshold`` of the template's distinct words (containment). The words of all templates are put in one global order, rarest in the corpus
first, and both a template and a block are sorted by it. A block that meets the threshold must have one of a template's first ``n - need + 1`` words (prefix
filter) and at least ``need`` of the templates' words (length filter); from the first common word on, both orders must have ``need`` words left
(positional filter). The few pairs that remain are counted exactly.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmosaic.llm.common import WORD_SEPARATORS, fold_ascii_col, per_text, table, words_of

#: The shortest stride of blocks. A block starts at every stride and is twice as long, so a passage of up to a stride and one word lies whole in one block.
STRIDE = 64
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """``phrase``: the words must also stand consecutively, and each place is reported."""

    label: str
    text: str
    threshold: float = THRESHOLD
    phrase: bool = False

    @cached_property
    def words(self) -> tuple[str, ...]:
        return tuple(words_of(self.text))

    @property
    def need(self) -> int:
        return max(1, ceil(self.threshold * len(set(self.words)) - 1e-9))

    @property
    def stride(self) -> int:
        """The stride of the blocks for this template: the shortest one, doubled until the template fits."""
        stride = STRIDE
        while stride + 1 < len(self.words):
            stride *= 2
        return stride


# The phrases of the scan's contract, notices, and whole license texts, as they are published.
_DISCLAIMER = """IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
""" + _DISCLAIMER.format(who="COPYRIGHT HOLDER OR CONTRIBUTORS")
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
TEMPLATES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-notice", "licensed under the apache license version 2 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version"),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    Template("mit-text", MIT_TEXT),
    Template("bsd-text", BSD_TEXT),
    Template("isc-text", ISC_TEXT),
    Template("apache-text", APACHE_NOTICE),
    Template("gpl-text", GPL_NOTICE),
)


def word_ranks(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[str, int]:
    """The templates' words (a set bounded by the templates), rarest in the whole corpus first; ties by the word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    wanted = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    words = docs.select(F.explode(F.split(fold_ascii_col(F.col(text_col)), WORD_SEPARATORS, -1)).alias("word"))
    rows = words.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).collect()
    times = {r.word: r.n for r in rows}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (times.get(w, 0), w)))}


class Matcher:
    """The join's index over the templates; blocks of one text at a time are probed against it. ``pruned`` counts pairs that the positional filter has dropped."""

    def __init__(self, templates: tuple[Template, ...], ranks: dict[str, int]):
        self.templates, self.ranks, self.pruned = templates, ranks, 0
        self.sorted = [sorted({ranks[w] for w in t.words}) for t in templates]
        prefix: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # word: stride: templates with the word in their prefix
        for k, (t, order) in enumerate(zip(templates, self.sorted)):
            first = set(order[: len(order) - t.need + 1])
            for w in set(t.words):
                if ranks[w] in first:
                    prefix[w][t.stride].append(k)
        self.prefix = {w: [(s, ks) for s, ks in by.items()] for w, by in prefix.items()}

    def meets(self, k: int, block: list[int]) -> int:
        """The words that a block (sorted ranks) and a template have in common, or 0 if they are too few."""
        order, need = self.sorted[k], self.templates[k].need
        if len(block) < need:
            return 0
        i = j = 0
        while order[i] != block[j]:  # to the first common word
            if order[i] < block[j]:
                i += 1
            else:
                j += 1
            if i == len(order) or j == len(block):
                return 0
        if min(len(order) - i, len(block) - j) < need:
            self.pruned += 1
            return 0
        common = len(set(order[i:]).intersection(block[j:]))
        return common if common >= need else 0

    def blocks(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word of the block, template, common words) for every block that meets the template's threshold."""
        prefix, candidates = self.prefix, defaultdict(set)
        for i, w in enumerate(words):
            if w in prefix:
                for stride, templates in prefix[w]:
                    at = i // stride
                    candidates[stride, at].update(templates)
                    if at:
                        candidates[stride, at - 1].update(templates)
        found, ranks = [], self.ranks
        for (stride, at), templates in sorted(candidates.items()):
            first = at * stride
            if at and first + stride >= len(words):
                continue  # its words all stand in the block before
            block = sorted({ranks[w] for w in words[first : first + 2 * stride] if w in ranks})
            found += [(first, k, n) for k in sorted(templates) if (n := self.meets(k, block))]
        return found

    def places(self, words: list[str], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(first word, last word, template) wherever the words of a phrase template stand consecutively in a block that meets it."""
        out = set()
        for first, k, _ in found:
            t = self.templates[k]
            if t.phrase:
                phrase = list(t.words)
                out |= {(i, i + len(phrase) - 1, k) for i in range(first, min(first + 2 * t.stride, len(words)) - len(phrase) + 1) if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase}
        return sorted(out)


MATCHES = "n_words long, matches array<struct<label:string,first_word:long,last_word:long,containment:double,phrase:boolean>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_words, matches``: for each row of ``docs`` all blocks that meet a template, and all places of phrases.

    A null or empty text has no words and no matches; null ids and repeated rows come back as they are, and an empty table gives no rows. Templates may have any
    length, and each text is searched whole, however long. Of overlapping blocks that meet a template all are given. Other columns are not read.
    The templates' words, not the corpus, bound what tasks are sent.
    """
    matcher = Matcher(templates, word_ranks(docs, templates, text_col))

    def run(texts: list) -> list:
        sizes, matches = [], []
        for text in texts:
            words = words_of(text)
            found = matcher.blocks(words)
            rows = [(templates[k].label, i, j, 1.0, True) for i, j, k in matcher.places(words, found)]
            rows += [(templates[k].label, i, min(i + 2 * templates[k].stride, len(words)) - 1, n / len(matcher.sorted[k]), False) for i, k, n in found if not templates[k].phrase]
            sizes.append(len(words))
            matches.append([dict(zip(("label", "first_word", "last_word", "containment", "phrase"), r)) for r in rows])
        return [sizes, matches]

    return per_text(docs, lambda: run, MATCHES, id_col, text_col)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    places = F.filter("matches", lambda m: m["phrase"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(places, lambda m: m["first_word"])).alias("last_word"),
        labels(places).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


def _op2_sql() -> str:
    values = ", ".join(f"('{t.label}', {list(t.words)!r}, {t.need}, {str(t.phrase).lower()}, {t.stride})" for t in TEMPLATES)
    return rf"""
with tpl(label, words, need, phrase, stride) as (values {values}),
d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents
), pos as (
  select rid, w, unnest(generate_series(1, len(w))) i from d
), places as (
  select rid, i - 1 as i, label from pos join tpl on phrase and words[1] = w[i] and w[i : i + len(words) - 1] = words
), strides as (
  select distinct stride from tpl
), blocks as (
  select rid, stride, list_distinct(w[i : i + 2 * stride - 1]) b from pos, strides where (i - 1) % stride = 0 and (i = 1 or i - 1 + stride < len(w))
), hits as (
  select rid, label, max(len(list_intersect(b, list_distinct(words))) / len(list_distinct(words))) c from blocks join tpl using (stride)
  where not phrase and len(list_intersect(b, list_distinct(words))) >= need group by rid, label
), p as (
  select rid, count(*) n, min(i) a, max(i) z, string_agg(distinct label, ',' order by label) l from places group by rid
), a as (
  select rid, string_agg(distinct label, ',' order by label) l, max(c) c from (select rid, label, 1.0 c from places union all select rid, label, c from hits) group by rid
)
select doc_id, len(w)::bigint n_words, coalesce(p.n, 0)::bigint n_base, p.a::bigint first_word, p.z::bigint last_word,
  coalesce(p.l, '') base_labels, coalesce(a.l, '') labels, coalesce(a.c, 0)::double score
from d left join p using (rid) left join a using (rid)
"""


OP2_SQL = _op2_sql()
