"""Licence scans with column expressions only.

Runs of words of a text, whatever its lines and comment marks, are compared with
licence templates by the Dice coefficient of their word bigrams.  A run starts and
ends with a bigram of its template.  Two sets of sizes a and b reach at most
2 * min(a, b) / (a + b), so a run must hold a least number of a template's bigrams
within a greatest length: texts, templates and starts that cannot are not compared.
Templates are a bounded table of the code; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.bind import let

#: Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        'specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received "
        "a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def normalised(text: str) -> list[str]:
    """Words of a template: runs of ASCII letters and digits in lower case."""
    return re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(words: list[str], least: float) -> tuple[int, int, int, int]:
    """Of a template: distinct bigrams, least number of them in a run, and the two lengths of runs in bigrams.

    With c of n bigrams the Dice coefficient is at most 2c / (c + n), reached where
    nothing else stands between them; with s distinct ones it is at most 2n / (s + n).
    """
    n, share = len(bigrams(words)), least / (2 - least)
    return n, math.ceil(n * share - 1e-9), len(words) - 1, max(len(words) - 1, math.floor(n / share + 1e-9))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values) -> str:
    """SQL text of a constant array; one expression builds much faster than a column per value."""
    return f"array({', '.join(map(_quoted, values))})"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Bigram at each position; for two words or more."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _runs(grams: Column, t: Column) -> Column:
    """``(dice, n, name, back)`` of the runs of a text that may reach the template ``t``; ``back`` is minus the first word's position."""

    def run(at: Column, j: Column, length: Column) -> Column:
        start = F.get(at, j)
        end = F.array_max(F.filter(F.slice(at, j + 1, length), lambda p: p < start + length))
        held = let(
            F.array_distinct(F.slice(grams, start, end - start + 1)),
            lambda g: 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"]),
        )
        return F.struct(held.alias("dice"), t["n"].alias("n"), t["name"].alias("name"), (-start).alias("back"))

    def from_starts(at: Column) -> Column:
        # the bigrams a run needs at least, counted from its start, must lie within the greatest length
        dense = lambda j: F.get(at, j + t["need"] - 1) < F.get(at, j) + t["longest"]
        starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), dense)
        return F.flatten(F.transform(starts, lambda j: F.array(run(at, j, t["length"]), run(at, j, t["longest"]))))

    places = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(t["grams"], F.get(grams, i - 1)))
    return let(places, from_starts)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, licence, dice, first_word, licences, n_licences)``, one row per input row.

    Words are runs of ASCII letters and digits in lower case, so lines, comment
    marks and case do not matter.  For each place of a template's bigram in the text
    two runs are compared: from there to the last of the template's bigrams within
    the template's own length, and within the greatest length that can still reach
    ``least``.  ``licence`` is the template of the run of greatest Dice coefficient,
    if it reaches ``least``: the larger template among equals, then the last by name;
    ``first_word`` is the position (from 1) of that run's first word, the first among
    equals.  ``licences`` are the names of all templates reached, sorted, with commas,
    ``n_licences`` their number.  Without any the first three are null, ``licences``
    is empty.  A text or template of under two words, null and empty texts match
    nothing.  Other columns are not read.
    """
    rows, vocabulary, every = [], set(), set()
    for name, text in templates.items():
        words = normalised(text)
        if len(words) > 1:
            n, need, length, longest = bounds(words, least)
            grams = bigrams(words)
            vocabulary.update(words)
            every.update(grams)
            halves = [gram.split() for gram in grams]
            rows.append(
                f"named_struct('name', {_quoted(name)}, 'grams', {_texts(grams)}, 'lefts', {_texts(a for a, _ in halves)}, "
                f"'rights', {_texts(b for _, b in halves)}, 'n', {n}, 'need', {need}, 'length', {length}, 'longest', {longest})"
            )
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    if not rows:
        nothing = {"licence": "string", "dice": "double", "first_word": "long"}
        return docs.select(doc_id, *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()], F.lit("").alias("licences"), F.lit(0).cast("long").alias("n_licences"))
    table = F.expr(f"array({', '.join(rows)})")

    def reached(words: Column) -> Column:
        """All runs of a text that reach ``least``; null where its words rule out every template."""

        def compared(near: Column) -> Column:
            def by_grams(grams: Column) -> Column:
                fits = lambda present: F.filter(near, lambda t: F.size(F.array_intersect(t["grams"], present)) >= t["need"])
                close = let(F.array_intersect(grams, F.expr(_texts(sorted(every)))), fits)
                return F.filter(F.flatten(F.transform(close, lambda t: _runs(grams, t))), lambda r: r["dice"] >= least)

            return F.when(F.size(near) > 0, let(_bigrams(words), by_grams))

        def by_words(present: Column) -> Column:
            both = lambda t: F.zip_with(t["lefts"], t["rights"], lambda a, b: F.array_contains(present, a) & F.array_contains(present, b))
            near = F.filter(table, lambda t: F.size(F.filter(both(t), lambda held: held)) >= t["need"])
            return F.when(F.size(present) > 0, let(near, compared))

        return let(F.array_intersect(words, F.expr(_texts(sorted(vocabulary)))), by_words)

    def summary(runs: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(runs, lambda r: r["name"])))
        return F.struct(F.array_max(runs).alias("top"), F.coalesce(names, F.array().cast("array<string>")).alias("names"))

    found = docs.select(doc_id, let(let(_words(F.col(text_col)), reached), summary).alias("s"))
    return found.select(
        "doc_id", F.col("s.top.name").alias("licence"), F.col("s.top.dice").alias("dice"), (-F.col("s.top.back")).cast("long").alias("first_word"),
        F.concat_ws(",", "s.names").alias("licences"), F.size("s.names").cast("long").alias("n_licences"),
    )


def oracle(least: float = 0.8) -> str:
    known = {name: normalised(text) for name, text in TEMPLATES.items()}
    grams = ", ".join(f"('{name}', '{gram}')" for name, words in known.items() for gram in bigrams(words))
    sizes = ", ".join(f"('{name}', {n}, {length}), ('{name}', {n}, {longest})" for name, words in known.items() for n, _, length, longest in [bounds(words, least)])
    return f"""
with t(name, gram) as (values {grams}),
z(name, n, len) as (select distinct * from (values {sizes})),
d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
g as (select r, i, w[i] || ' ' || w[i + 1] as gram from (select r, w, unnest(range(1, len(w))) as i from d)),
h as (select r, name, i, gram from g join t using (gram)),
p as (select h.r, h.name, h.i, z.n, z.len, max(k.i) as e, count(distinct k.gram) as c
      from h join z using (name) join h k on k.r = h.r and k.name = h.name and k.i between h.i and h.i + z.len - 1
      group by all having 2.0::double * count(distinct k.gram) / (count(distinct k.gram) + z.n) >= {least}),
m as (select p.r, p.name, p.i, p.n, 2.0::double * any_value(p.c) / (count(distinct g.gram) + p.n) as dice
      from p join g on g.r = p.r and g.i between p.i and p.e group by p.r, p.name, p.i, p.n, p.len),
c as (select r, max({{'dice': dice, 'n': n, 'name': name, 'back': -i}}) as top, string_agg(distinct name, ',' order by name) as licences,
      count(distinct name) as n_licences from m where dice >= {least} group by 1)
select doc_id, c.top.name as licence, c.top.dice as dice, -c.top.back as first_word, coalesce(licences, '') as licences,
  coalesce(n_licences, 0) as n_licences from d left join c using (r)
"""
