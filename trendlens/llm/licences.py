"""Operator 10: licence scans.

DataFrame operations only.  A text is normalised to lower-case words, and every
window of its words is compared with licence templates by the Dice coefficient
of their bags of word bigrams: twice the bigrams in common over the sum of both
sizes.  Windows slide over the whole text, across lines, so a notice within a
sentence, a wrapped one and a whole licence are found alike.

With threshold ``d`` a window can match a template of ``t`` bigrams only when it
has at most ``t (2 - d) / d`` of them and ``t d / (2 - d)`` in common.  So every
matching window holds one of a template's *prefix*, a few of its longest
bigrams: texts without any are dropped by set look-ups in the scan.  What is
left are the places of template bigrams in few texts; a window's best start
and end are such places.  A bigram counts in a window as often as the template
has it: when its place that many occurrences before lies ahead of the window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlens.llm.common import prepare, settled

#: Usual notices, headers and whole texts, as (licence, form, text).
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("GPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", "header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)
PERCENT = 80
WORDS = r"[^a-z0-9]+"


class Template:
    """A template's bigrams with their counts, its prefix and what a matching window needs."""

    def __init__(self, licence: str, form: str, text: str, percent: int):
        words = [w for w in re.split(WORDS, text.lower()) if w]
        self.licence, self.form = licence, form
        self.bag = Counter(map(" ".join, zip(words, words[1:])))
        self.size = self.bag.total()
        self.common = -(-percent * self.size // (200 - percent))      # bigrams in common at least
        self.longest = self.size * (200 - percent) // percent          # bigrams of a window at most
        self.prefix, left = [], self.size
        for g in sorted(self.bag, key=lambda g: (-min(map(len, g.split())), -len(g), g)):
            if left < self.common:
                break
            self.prefix.append(g)
            left -= self.bag[g]


def words_of(text: Column) -> Column:
    """Lower-case words of letters a-z and digits."""
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def _placed_bigrams(words: Column, wanted: Sequence[str]) -> Column:
    """``(pos, g)`` of every pair of neighbouring words that is in ``wanted``, in order."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                        lambda w, i: F.struct(i.cast("int").alias("pos"), F.concat_ws(" ", F.get(words, i), w).alias("g")))
    return F.filter(pairs, lambda p: p["g"].isin(list(wanted)))


def scan_licences(df: DataFrame, id_col: str, text_col: str, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``doc_id, licence, form, start, n_words, dice``: for every text and
    template that some window matches to ``percent``, the best window (first
    word from 0, number of words); ties go to the first, then the shortest.

    Null and empty texts, and texts or templates with fewer than two words,
    match nothing.  Repeated rows are scanned apiece, a null id stays null; an
    empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    known = [t for t in (Template(*x, percent) for x in templates) if t.size]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    if not known:
        return rows.where("false").select("doc_id", F.lit("").alias("licence"), F.lit("").alias("form"), F.lit(0).alias("start"),
                                          F.lit(0).alias("n_words"), F.lit(0.0).alias("dice"))
    every = sorted({g for t in known for g in t.bag})
    prefixes = sorted({g for t in known for g in t.prefix})
    words = settled(rows, "w", words_of(F.col("text"))).select("doc_id", "_row", "w")
    hits = settled(words, "hits", _placed_bigrams(F.col("w"), every)).select("doc_id", "_row", "hits")
    hits = hits.where(F.exists("hits", lambda h: h["g"].isin(prefixes)))

    def is_one_of(grams):
        return lambda h: h["g"].isin(sorted(grams))

    mine = F.array(*[F.struct(F.lit(k).alias("k"), F.filter("hits", is_one_of(t.bag)).alias("h"),
                              F.exists("hits", is_one_of(t.prefix)).alias("found")) for k, t in enumerate(known)])
    enough = F.array(*[F.lit(t.common) for t in known])
    each = hits.select("doc_id", "_row", F.explode(mine).alias("t")).where(
        F.col("t.found") & (F.size("t.h") >= enough[F.col("t.k")]))
    flat = each.select("doc_id", "_row", "t.k", F.explode("t.h").alias("h")).select("doc_id", "_row", "k", "h.*")
    # the same bigram's place as many occurrences before as the template has it
    spark = df.sparkSession
    times = spark.createDataFrame([(k, g, m) for k, t in enumerate(known) for g, m in t.bag.items()], "k int, g string, m int")
    before = Window.partitionBy("_row", "k", "g").orderBy("pos")
    lag = F.lit(None).cast("int")
    for m in sorted({m for t in known for m in t.bag.values()}):
        lag = F.when(F.col("m") == m, F.lag("pos", m).over(before)).otherwise(lag)
    flat = flat.join(F.broadcast(times), ["k", "g"]).withColumn("prev", F.coalesce(lag, F.lit(-1)))
    place = F.struct(F.col("pos"), F.col("prev"))
    texts = flat.groupBy("_row", "k").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(place)).alias("h"))
    of = lambda values: F.array(*[F.lit(v) for v in values])[F.col("k")]
    texts = texts.withColumns({"size": of([t.size for t in known]), "common": of([t.common for t in known]),
                               "longest": of([t.longest for t in known])})
    # places from which enough hits lie within the longest window
    starts = F.filter(F.sequence(F.lit(1), F.size("h") - F.col("common") + 1),
                      lambda i: F.get("h", i + F.col("common") - 2)["pos"] < F.get("h", i - 1)["pos"] + F.col("longest"))
    texts = settled(texts.where(F.size("h") >= F.col("common")), "starts", starts)

    def best_from(i):
        a = F.get("h", i - 1)["pos"]
        counted = F.filter(F.slice("h", i, F.col("longest")),
                           lambda p: (p["pos"] < a + F.col("longest")) & (p["prev"] < a))
        windows = F.transform(counted, lambda p, c: F.struct(
            (F.lit(2.0) * (c + 1) / (p["pos"] - a + 1 + F.col("size"))).alias("dice"), (-a).alias("start"),
            (-(p["pos"] - a + 2)).alias("n_words"), (c + 1).alias("c")))
        return F.array_max(windows)

    best = settled(texts.where(F.size("starts") > 0), "b", F.array_max(F.transform("starts", best_from)))
    best = best.where(200 * F.col("b.c") >= percent * (-F.col("b.n_words") - 1 + F.col("size")))
    return best.select("doc_id", of([t.licence for t in known]).alias("licence"), of([t.form for t in known]).alias("form"),
                       (-F.col("b.start")).alias("start"), (-F.col("b.n_words")).alias("n_words"), F.col("b.dice").alias("dice"))
