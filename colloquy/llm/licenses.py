"""Operator 1, license scans: Dice coefficient over word bigrams against license templates.

Each unit of a text (its lines, its paragraphs and the whole) is normalised and compared with
every template that its size lets reach the threshold: Dice of at least t needs the smaller set
to have t / (2 - t) times the bigrams of the larger one. A license that is wrapped over lines,
stands behind comment marks or lies among other paragraphs is no unit; it is a run of the text's
words. Long templates have three anchors each (their first, middle and last four words): where one
occurs, the run of words around it, as long as the template, is a unit for this template.
Built-in expressions, no shuffle, no Python; the templates are literals of fixed size in the plan.

Defined cases: a null or empty text, or one that matches nothing, has a null license, Dice 0,
no notices and no runs; of equal scores the template with more bigrams wins, then the first by
name; a run that the text's ends or the same anchor cut off is compared as it is; repeated rows
are scanned each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public license notices and texts.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD notice": "Licensed under the BSD License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
_BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Complete texts of the shorter licenses, after their openings above.
FULL_TEXTS = {
    "BSD-2-Clause text": TEMPLATES["BSD-2-Clause"] + _BSD_DISCLAIMER,
    "BSD-3-Clause text": TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_DISCLAIMER,
    "ISC text": TEMPLATES["ISC"] + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT text": TEMPLATES["MIT"] + """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense text": TEMPLATES["Unlicense"] + """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org""",
}
#: Dice at which a unit counts as a notice.
THRESHOLD = 0.8


def template_bigrams(text: str) -> list[tuple[str, str]]:
    """The distinct word bigrams of a template, normalised as texts are."""
    words = re.sub(r"[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
    return sorted(set(zip(words, words[1:])))


#: What a scan compares with, and its SQL.
KNOWN = TEMPLATES | FULL_TEXTS
#: Words in an anchor, and words of a template that is looked for in runs.
ANCHOR, RUN_WORDS = 4, 20


def anchors(text: str) -> list[tuple[int, str, int]]:
    """The anchors of a template: words before, the phrase, words after; none for a short one."""
    words = re.sub(r"[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
    n = len(words)
    at = sorted({0, (n - ANCHOR) // 2, n - ANCHOR}) if n >= RUN_WORDS else []
    return [(i, " ".join(words[i : i + ANCHOR]), n - i - ANCHOR) for i in at]


def family(name: Column) -> Column:
    """The license that a template belongs to."""
    return F.regexp_replace(name, " (notice|text)$", "")


def normalised(text: Column) -> Column:
    """Lower-case words of A-Z and 0-9 with one space between."""
    return F.lower(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")))


def _bigrams(units: Column) -> Column:
    """The distinct bigram hashes of each unit, given as arrays of words."""
    pair = lambda w: lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))
    return F.transform(units, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), pair(w))))


def _runs(text: Column, before: int, phrase: str, after: int) -> Column:
    """The words around each occurrence of a phrase in a normalised text with a space at both ends."""
    words = lambda piece: F.filter(F.split(piece, " "), lambda w: w != "")
    first = lambda w: F.slice(w, 1, after)
    last = lambda w: F.slice(w, F.greatest(F.size(w) - before + 1, F.lit(1)), before)
    held = F.array(*[F.lit(w) for w in phrase.split(" ")])
    around = lambda p: lambda i: F.concat(last(words(F.get(p, i - 1))), held, first(words(F.get(p, i))))
    pieces = F.transform(F.array(F.split(text, f" {phrase} ")), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), around(p)))
    return F.when(text.contains(f" {phrase} "), F.flatten(pieces)).otherwise(F.array().cast("array<array<string>>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, license, dice, n_notices, family, n_runs``: the best template at or over the threshold, how
    many lines match one, what license the best one belongs to and how many licenses runs match."""
    templates = KNOWN if templates is None else templates
    texts = {k: template_bigrams(v) for k, v in sorted(templates.items())}
    each = [
        F.struct(
            F.lit(-i).alias("order"),
            F.lit(name).alias("name"),
            F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in grams]).alias("grams"),
            F.lit(len(grams)).alias("n"),
        )
        for i, (name, grams) in enumerate(texts.items())
    ]
    known = F.array(*each)
    low, ratio = min(map(len, texts.values())), threshold / (2 - threshold)
    high = max(map(len, texts.values()))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cut = lambda by: F.transform(F.split("_text", by), lambda x: F.split(normalised(x), " "))
    rows = rows.withColumn("_clean", normalised(F.col("_text"))).withColumn("_padded", F.concat(F.lit(" "), "_clean", F.lit(" ")))
    whole = F.when(F.col("_text").contains("\n"), F.array(F.split("_clean", " "))).otherwise(F.array().cast("array<array<string>>"))
    blocks = F.when(F.col("_text").rlike(r"\n\s*\n"), cut(r"\n\s*\n")).otherwise(F.array().cast("array<array<string>>"))
    # A unit of fewer words than these has too few bigrams for any template.
    enough = lambda units: F.filter(units, lambda w: F.size(w) - 1 >= max(1, ratio * low))
    runs = {name: [_runs(F.col("_padded"), *a) for a in anchors(templates[name])] for name in texts}
    runs = {f"_run{i}": F.concat(*found) for i, found in enumerate(runs.values()) if found}
    rows = rows.select(id_col, enough(cut("\n")).alias("_lines"), enough(F.concat(blocks, whole)).alias("_more"), *[c.alias(n) for n, c in runs.items()])
    rows = rows.select(id_col, *[_bigrams(F.col(c)).alias(c) for c in rows.columns if c != id_col])
    fits = lambda n: (F.size(n) >= ratio * low) & (F.size(n) <= high / ratio)

    def best(grams: Column, among: Column = known) -> Column:
        size = F.size(grams)
        near = F.filter(among, lambda t: (size >= ratio * t["n"]) & (t["n"] >= ratio * size))
        dice = lambda t: 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (size + t["n"])
        return F.array_max(F.transform(near, lambda t: F.struct(dice(t).alias("dice"), t["n"].alias("n"), t["order"].alias("order"), t["name"].alias("name"))))

    reached = lambda found: F.filter(found, lambda b: b.isNotNull() & (b["dice"] >= threshold))
    hits = lambda units: reached(F.transform(F.filter(units, fits), lambda grams: best(grams)))
    of = lambda n: F.array_max(F.transform(n, lambda grams: best(grams, F.array(each[int(n.removeprefix("_run"))]))))
    found = reached(F.array(*[of(n) for n in runs])) if runs else F.filter(hits(F.array_repeat(F.array(F.lit(0).cast("bigint")), 0)), lambda b: F.lit(False))
    rows = rows.select(id_col, hits(F.col("_lines")).alias("_lines"), hits(F.col("_more")).alias("_more"), found.alias("_runs"))
    top = F.array_max(F.concat("_lines", "_more", "_runs"))
    counted = lambda c: F.size(c).cast("bigint")
    return rows.select(
        id_col, top["name"].alias("license"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), counted("_lines").alias("n_notices"),
        family(top["name"]).alias("family"), counted(F.array_distinct(F.transform("_runs", lambda b: family(b["name"])))).alias("n_runs"),
    )
