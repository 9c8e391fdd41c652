"""Licence scan: normalised passages compared to licence templates by Dice over word bigrams.

Everything runs as built-in column expressions. A passage is a line, a paragraph (between blank
lines), the whole text, or a window: as many words as the template has, wherever one of the template's
bigrams stands, so a licence is found inside a longer line or over several paragraphs. A passage is
compared with a template only if the two bigram counts allow the threshold (size bound). Texts come to
that in two steps, each a proven necessary condition: they hold one of a few trigger words, chosen so
that a passage without them has too few bigrams in common with every template; and they hold, anywhere,
as many of a template's bigrams as the threshold needs.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import documents

THRESHOLD = 0.8
#: Slack of the size bounds, so that rounding leaves out no pair at the threshold itself.
ROUNDING = 1e-9

# Licence notices and short licence texts, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "MIT-0": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}


def words_of(text: str) -> list[str]:
    """Words of a passage: runs of ASCII letters and digits in lower case."""
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m.group().lower(), text))


def bigrams_of(text: str) -> set[str]:
    """Distinct word bigrams; a single word counts as one bigram by itself."""
    w = words_of(text)
    return {" ".join(p) for p in zip(w, w[1:])} or set(w)


# Words that stand in any text; they are taken as triggers last.
COMMON = frozenset("a and any are as at be by for from in is it may not of on or that the this to under use with you".split())


def triggers(threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> list[str]:
    """Words of which any passage that reaches the threshold with some template has at least one.

    With n bigrams in a template, Dice >= t needs at least t n / (2 - t) of them, so a set of words
    that touches more than the remaining ones cannot be avoided. Words that are taken already come
    first, then rare words that touch many bigrams.
    """
    chosen: set[str] = set()
    for text in (t for ts in templates.values() for t in ts):
        grams = [g.split() for g in bigrams_of(text)]
        need = len(grams) - _least(len(grams), threshold) + 1
        touched = {w: sum(1 for g in grams if w in g) for g in grams for w in g}
        for w in sorted(touched, key=lambda w: (w not in chosen, w in COMMON, len(w) < 4, -touched[w], -len(w), w)):
            if sum(1 for g in grams if chosen.intersection(g)) >= need:
                break
            chosen.add(w)
    return sorted(chosen)


def _least(n: int, threshold: float) -> int:
    """Bigrams that a passage must have in common with a template of ``n``."""
    return math.ceil(threshold * n / (2 - threshold) - ROUNDING)


def _words(passage: Column) -> Column:
    lower = F.translate(passage, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Word bigrams in order; a single word counts as one."""
    n = F.size(words)
    return F.when(n < 2, words).otherwise(F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _let(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, licence, dice, unit, n_places``: licences that a document's passages name, one row each.

    ``dice`` is the best over the document's lines, paragraphs, whole text and windows and over the
    licence's templates, rounded to six digits; ``unit`` is the kind of the best passage (line, paragraph,
    text, window, in this order on ties); ``n_places`` counts the lines, paragraphs and whole texts that
    reach the threshold. A single word counts as one bigram. Null and empty texts have no passage; rows
    with the same ``doc_id`` (null is one, too) are scanned each and reported as one document. Other
    columns are ignored; an empty table gives an empty result.
    """
    table = [(name, sorted(bigrams_of(t)), max(1, len(words_of(t)) - 1)) for name, ts in TEMPLATES.items() for t in ts]
    known = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(len(g)).alias("size"), F.lit(_least(len(g), threshold)).alias("least"), F.lit(width).alias("width"), F.array(*map(F.lit, g)).alias("grams")) for n, g, width in table])
    every = F.array(*map(F.lit, sorted({x for _, g, _ in table for x in g})))
    words = triggers(threshold)
    rows = documents(docs).where(F.exists(F.array(F.lower("text")), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])))
    rows = _let(rows, grams=_pairs(_words(F.col("text"))))
    rows = _let(rows, hits=F.array_intersect("grams", every))
    rows = _let(rows, near=F.filter(known, lambda t: F.size(F.array_intersect("hits", t["grams"])) >= t["least"]))
    rows = rows.where(F.size("near") > 0)

    def units(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("unit"), F.array_distinct(_pairs(_words(p))).alias("grams")))

    # a text of one line is the same passage three times: only the first kind of it is kept
    blank = r"\n[\x20\t\r]*\n"
    paragraphs = F.filter(F.split("text", blank), lambda p: p.contains("\n"))
    rows = _let(rows, units=F.concat(units(0, F.split("text", "\n")), units(1, paragraphs), units(2, F.filter(F.array("text"), lambda p: p.rlike(blank)))))
    rows = rows.select("doc_id", "grams", "units", F.explode("near").alias("t"))

    def dice(grams: Column, t: Column) -> Column:
        n = F.size(grams)
        fits = (t["size"] * (2 - threshold) >= n * threshold - ROUNDING) & (n * (2 - threshold) >= t["size"] * threshold - ROUNDING)
        return F.when(fits, F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (n + t["size"])).otherwise(0.0)

    t = F.col("t")
    whole = F.transform("units", lambda u: F.struct(dice(u["grams"], t).alias("dice"), (-u["unit"]).alias("unit")))
    starts = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(t["grams"], g) & (i + t["width"] <= F.size("grams")), i + 1)), lambda i: i.isNotNull())
    windows = F.transform(starts, lambda i: F.struct(dice(F.array_distinct(F.slice("grams", i, t["width"])), t).alias("dice"), F.lit(-3).alias("unit")))
    rows = _let(rows, found=F.filter(F.concat(whole, windows), lambda p: p["dice"] >= threshold - ROUNDING))
    rows = rows.where(F.size("found") > 0).select("doc_id", t["licence"].alias("licence"), F.array_max("found").alias("best"), F.size(F.filter("found", lambda p: p["unit"] > -3)).alias("places"))
    best = rows.groupBy("doc_id", "licence").agg(F.max("best").alias("best"), F.sum("places").alias("n_places"))
    unit = F.element_at(F.array(*map(F.lit, ("line", "paragraph", "text", "window"))), 1 - F.col("best.unit"))
    return best.select("doc_id", "licence", F.round("best.dice", 6).alias("dice"), unit.alias("unit"), "n_places")
