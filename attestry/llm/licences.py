"""Licence scan: units of a text compared to licence templates by the Dice coefficient over word bigrams.

A unit is a line, or a paragraph (lines up to an empty one), or the whole text. It is normalised (lower case, everything but
letters and digits one space) and cut into words. Dice is twice the number of distinct bigrams that unit and template share over the sum of
their numbers. Since the coefficient can't be over 2 min / (a + b), a unit with a distinct bigrams can reach t only on templates with b between
a t / (2 - t) and a (2 - t) / t; templates outside these bounds are pruned, and a unit that is too long or short for any template is
dropped by its number of words before its bigrams are made. The templates are fixed, small and part of the plan (a literal array),
so nothing is joined or shuffled. Only DataFrame functions are used.

Defined results: every row gets a row; licence and score are null where no unit reaches the threshold. Of equal scores the licence
that sorts first wins. A null or empty text has no units. A very long text is scanned whole. Repeated rows each get their row. Extra columns are not
read, so no name clashes. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices, opening paragraphs and, where they are short, whole texts of public licences.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_ZLIB_REST = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
_FREE = "This is free and unencumbered software released into the public domain."
_FREE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GNU_COPY = "GNU %s Version 3, %s Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_CC = "This work is licensed under a Creative Commons %s 4.0 International License."

TEMPLATES = {
    "agpl-3.0": [_GNU % "Affero General Public License", _GNU_COPY % ("AFFERO GENERAL PUBLIC LICENSE", "19 November 2007")],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, _APACHE_REST, f"{_APACHE} {_APACHE_REST}"],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", _BSD_TWO, f"{_BSD_OPEN} {_BSD_TWO} {_BSD_AS_IS}"],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", _BSD_OPEN, _BSD_NAME, _BSD_AS_IS, f"{_BSD_TWO} {_BSD_NAME}", f"{_BSD_OPEN} {_BSD_TWO} {_BSD_NAME} {_BSD_AS_IS}"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", _CC % "Attribution"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", _CC % "Attribution-NonCommercial"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", _CC % "Attribution-ShareAlike"],
    "cc0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU % "General Public License", _GNU_COPY % ("GENERAL PUBLIC LICENSE", "29 June 2007")],
    "isc": ["Released under the ISC License.", _ISC, _ISC_AS_IS, f"{_ISC} {_ISC_AS_IS}"],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU % "Lesser General Public License", _GNU_COPY % ("LESSER GENERAL PUBLIC LICENSE", "29 June 2007")],
    "mit": ["Released under the MIT License.", _GRANT, _MIT_REST, _MIT_AS_IS, f"{_GRANT} {_MIT_REST} {_MIT_AS_IS}"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "public-domain": ["This work has been released into the public domain."],
    "unlicense": [_FREE, f"{_FREE} {_FREE_REST}"],
    "zlib": ["Released under the zlib License.", _ZLIB, _ZLIB_REST, f"{_ZLIB} {_ZLIB_REST}"],
}


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, list[str], int]]:
    """(licence, distinct bigrams, number of words) of each template."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
            out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}), len(words)))
    return out


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    """Distinct; words has two words at least."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: id, licence, score, n_units (units that reach the threshold)."""
    known = template_bigrams(TEMPLATES if templates is None else templates)
    sizes = [len(b) for _, b, _ in known]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.when(F.instr(text, "\n") > 0, F.filter(F.split(text, r"\n\s*\n"), lambda p: F.instr(p, "\n") > 0)).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.instr(text, "\n\n") > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    units = F.transform(F.concat(lines, paragraphs, whole), _words)
    # a unit with w words has at most w - 1 distinct bigrams; repeats only lower that, so only the lower bound can prune by words
    kept = F.filter(units, lambda w: F.size(w) - 1 >= F.lit(least))
    bigrams = F.filter(F.transform(kept, _bigrams), lambda b: F.size(b).between(F.lit(least), F.lit(most)))
    against = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n")) for name, b, _ in known])

    def scores(b: Column) -> Column:
        possible = F.filter(against, lambda t: t["n"].between(F.size(b) * F.lit(threshold / (2 - threshold)), F.size(b) * F.lit((2 - threshold) / threshold)))
        dice = F.transform(possible, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + t["n"])).alias("minus"), t["licence"].alias("licence")))
        return F.array_min(dice)

    best = F.filter(F.transform(bigrams, scores), lambda s: s["minus"] <= -threshold)
    found = docs.select(F.col(id_col), best.alias("_found"))
    top = F.array_min("_found")
    return found.select(id_col, top["licence"].alias("licence"), (-top["minus"]).alias("score"), F.size("_found").alias("n_units"))
