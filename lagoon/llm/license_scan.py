"""Operator 3: licence scans by Dice coefficient over word bigrams, in DataFrame functions alone."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.storage import materialize

#: Public licence statements and notices, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]


def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> Counter:
    w = words(text)
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def pieces_of(text: Column) -> Column:
    """Lines and sentences of a text, lower-cased, each as words of letters and digits with a blank between; empty ones left out."""
    lines = F.regexp_replace(F.lower(text), r"([.!?;:])[ \t]+", "$1\n")
    plain = F.split(F.regexp_replace(lines, r"[^\p{L}\p{N}\n]+", " "), "\n")
    return F.filter(F.transform(plain, lambda p: F.trim(p)), lambda p: p != "")


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, license, dice, start, words``: the licences that a text states, one row for each of them.

    A text is cut at line breaks and sentence ends, and every run of consecutive pieces is compared: a line, a paragraph, part of one, or the
    whole text. Case and punctuation don't count. A run states the licence of the template whose word bigrams (repeats
    counted) have the greatest Dice coefficient with its own, from ``threshold`` on, and none if templates of two
    licences share it. With a and b bigrams that needs b * t / (2 - t) <= a <= b * (2 - t) / t and as many common ones as the
    left side, which prunes templates by size before anything is compared. The best run of a licence is returned: the earliest, then the shortest, of the greatest ``dice``;
    ``start`` is its first word's number, ``words`` its length.

    A best run begins and ends with pieces that share a bigram with the template (without a piece that shares none
    the coefficient is higher), so only such runs are looked at. Texts and
    templates that share too few bigrams drop out before runs are made. The templates are a
    parameter: their table is broadcast, a few rows for each.

    Null and empty texts state nothing; rows with the same id count as one text; a null id is an id.
    """
    spark = docs.sparkSession
    names = sorted({g for _, t in templates for g in bigrams(t)})
    code = {g: i for i, g in enumerate(names)}
    made = [(i, name, sum(bigrams(t).values()), [(code[g], n) for g, n in sorted(bigrams(t).items())]) for i, (name, t) in enumerate(templates) if bigrams(t)]
    listed = spark.createDataFrame(made or [(-1, "", 1, [(0, 0)])], "template int, license string, b int, grams array<struct<g:int,there:int>>")
    known = listed.select("template", "b", F.explode("grams").alias("x")).select("template", "b", F.col("x.g").alias("g"), F.col("x.there").alias("there"))
    codes = spark.createDataFrame(list(code.items()) or [("", 0)], "gram string, g int")
    grams = materialize(known.join(codes, "g").select("gram", "g", "template", "b", "there"))
    ratio = (2 - threshold) / threshold + 1e-9  # bounds that rounding doesn't tighten

    key = ["__k", "__l"]
    given = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("__text"), F.xxhash64(id_col, text_col).alias("__k"), F.hash(text_col, id_col).alias("__l"))

    # how many of each template's bigrams a text may have, by hashes of pairs of words
    w = F.split(F.lower("__text"), r"[^\p{L}\p{N}]+")
    two = F.explode(F.arrays_zip(w.alias("x"), F.slice(w, 2, F.size(w)).alias("y")))
    pairs = given.select(*key, two.alias("two")).select(*key, F.xxhash64("two.x", "two.y").alias("pair"))
    marks = grams.select(F.xxhash64(F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1)).alias("pair"), "template", "b", "there")
    counted = pairs.join(F.broadcast(marks), "pair").groupBy(*key, "template", "b", "pair").agg(F.least(F.count("*"), F.max("there")).alias("n"))
    enough = counted.groupBy(*key, "template", "b").agg(F.sum("n").alias("n")).filter(F.col("n") * ratio >= F.col("b"))
    wanted = materialize(enough.groupBy(*key).agg(F.collect_set("template").alias("templates")))

    pieces = F.col("__p")
    # each piece with the first word of the next one, so that bigrams across the border belong to the piece they begin in
    longer = F.transform(pieces, lambda x, i: F.concat_ws(" ", x, F.substring_index(F.get(pieces, i + 1), " ", 1)))
    left = given.join(wanted, key).dropDuplicates(key).withColumn("__p", pieces_of(F.col("__text")))
    cut = left.select(id_col, *key, "templates", F.posexplode(longer).alias("p", "piece"), (F.size(pieces) - 1).alias("last"))
    w = F.split("piece", " ")
    by = Window.partitionBy(*key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sized = cut.withColumn("n", F.size(w) - (F.col("p") < F.col("last")).cast("int"))
    placed = sized.withColumn("off", F.coalesce(F.sum("n").over(by), F.lit(0)))
    each = placed.select(id_col, *key, "p", "n", "off", "templates", F.posexplode(F.arrays_zip(w.alias("x"), F.slice(w, 2, F.size(w)).alias("y"))).alias("i", "two")).filter("two.y IS NOT NULL")
    found = (
        each.withColumn("gram", F.concat("two.x", F.lit(" "), "two.y")).join(F.broadcast(grams), "gram")
        .filter(F.array_contains("templates", F.col("template")))
        .groupBy(id_col, *key, "template", "b", "p", "n", "off")
        .agg(F.collect_list(F.when(F.col("i") < F.col("n") - 1, F.col("g"))).alias("inner"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("g"))).alias("across"))
    )
    # from each piece on, the pieces with hits within the longest run
    reach = int(max([b for _, _, b, _ in made] or [1]) * ratio) + 1
    ahead = Window.partitionBy(*key, "template").orderBy("off").rangeBetween(0, reach)
    runs = found.withColumn("ahead", F.collect_list(F.struct("off", "n", "inner", "across")).over(ahead)).join(F.broadcast(listed.select("template", "license", "grams")), "template")

    hits = F.aggregate("ahead", F.lit(0), lambda acc, x: acc + F.size(x["inner"]) + 1)
    runs = runs.filter(hits * ratio >= F.col("b"))

    def matched(j: Column) -> Column:
        """The run up to the j-th of the pieces ahead: its bigrams, and how many it has in common with the template."""
        end = F.get("ahead", j)
        a = end["off"] + end["n"] - F.col("off") - 1
        fits = (a <= F.col("b") * ratio) & (a * ratio >= F.col("b"))
        before = F.flatten(F.transform(F.slice("ahead", 1, j), lambda x: F.concat(x["inner"], F.array_compact(F.array(x["across"])))))
        held = F.concat(before, end["inner"])
        fits = fits & (F.size(held) * ratio >= F.col("b"))
        common = F.aggregate("grams", F.lit(0), lambda acc, g: acc + F.least(g["there"], F.size(F.filter(held, lambda h: h == g["g"]))))
        return F.when(fits, F.struct((a + 1).alias("words"), (2.0 * common / (a + F.col("b"))).alias("dice")))

    each = runs.select(
        id_col, *key, "template", "license", "off", F.explode(F.transform(F.sequence(F.lit(0), F.size("ahead") - 1), matched)).alias("run")
    ).filter(F.col("run.dice") >= threshold).select(id_col, *key, "template", "license", F.col("off").alias("start"), "run.words", "run.dice")
    best = F.max("dice").over(Window.partitionBy(*key, "start", "words"))
    stated = each.withColumn("__best", best).filter("dice = __best").groupBy(id_col, *key, "start", "words").agg(F.max("dice").alias("dice"), F.min("license").alias("license"), F.max("license").alias("__other"))
    clear = stated.filter("license = __other")
    return clear.groupBy(id_col, "license").agg(F.min(F.struct((-F.col("dice")).alias("d"), F.col("start").cast("long").alias("start"), F.col("words").cast("long").alias("words"))).alias("m")).select(
        id_col, "license", (-F.col("m.d")).alias("dice"), "m.start", "m.words"
    )
