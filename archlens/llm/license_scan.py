"""License scans by MinHash bands over text windows (operator 5), in DataFrame functions throughout.

A text's words (letters and digits, A-Z lower-cased) give shingles of five words. For each size class of templates (of at
most `cap` shingles and more than cap / sqrt(2)) windows of cap + stride - 1 shingles overlap, one beginning at every
stride-th shingle, a quarter of cap, so any stretch as long as a template lies inside a window. A window that holds 80 %
of a template's shingles has a Jaccard similarity of at least 0.8 / (1.25 * sqrt(2) + 0.2) = 0.4 with it.

A band has two rows, the least and the greatest value of one hash function over the shingles, and agrees with the
probability that both are shared: about the similarity's square, 0.16 or more. With BANDS = 64 bands a window is
retrieved with a probability of 1 - (1 - 0.16) ** 64 > 0.9999. What is retrieved is verified: exact containment of the
template's shingles, as strings, in the window.

Licences have much text in common (GPL-3.0's notice holds nine tenths of LGPL-3.0's), so templates that hold at one
place compete: of a held template the stretch of its own length with the most of its shingles is its place, and its
score the shingles there less those that are missing (for templates of one length, the order of containment). A
template is no finding if at more than half of the shingles of its place another licence's has a higher score.

A window with fewer shingles of any template than 80 % of its class's shortest can hold none: a bit set of templates' shingles
counts too many at most, so signatures are made of the other windows only.

Defined results: null and empty texts match nothing; templates of fewer than five words have none; rows come back as
often as they are given, whatever their doc_id; empty tables and an empty list of templates give no matches; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import cut, id_and_text
from archlens.llm.native import NOT_ALNUM, ascii_lower, filter_words, hits, shingle_hashes, words

SHINGLE, BANDS, CONTAINED = 5, 64, 0.8
#: Distinct shingles of all templates up to which their bands and shingles are broadcast (some 100 bytes each, and 2 kB a
#: template for its bands); beyond, the joins shuffle.
BROADCAST_SHINGLES = 1 << 15
#: Name, words before "Public License" and version of GNU licences; GPL-3.0's notices stand below.
GNU = [("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.0", "Library General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")]
CREATIVE = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
_EXCEPT = "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_IF = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER'
#: Public licence notices as they stand in files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *[(n, f"This {x} is free software: you can redistribute it and/or modify it under the terms of the GNU {k} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for n, k, v in GNU for x in ("program", "library")],
    *[(n, f"This {x} is free software; you can redistribute it and/or modify it under the terms of the GNU {k} Public License version {v} as published by the Free Software Foundation") for n, k, v in GNU for x in ("program", "library")],
    *[(n, f"This work is licensed under the GNU {k} Public License, version {v}.") for n, k, v in GNU],
    *[(f"CC-{n}-{v}", f"This work is licensed under {a} Creative Commons {words} {v} {where} License") for n, words in CREATIVE for v, where in (("4.0", "International"), ("3.0", "Unported")) for a in ("a", "the")],
    *[(f"CC-{n}-{v}", f"Licensed under CC {n} {v}.") for n, _ in CREATIVE for v in ("4.0", "3.0")],
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Apache-2.0", f'Licensed under the Apache License, Version 2.0 (the "License"); {_EXCEPT} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{_MIT} {_MIT_IF} {_MIT_WARRANTY}"),
    ("MIT-0", f"{_MIT} {_MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", f'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); {_EXCEPT} http://www.mozilla.org/MPL/'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def _strings(column: Column) -> Column:
    """The distinct shingles of a word array, as strings."""
    n = F.greatest(F.size(column) - SHINGLE + 1, F.lit(0))
    each = F.transform(F.slice(column, F.lit(1), n), lambda _, i: F.array_join(F.slice(column, i + 1, SHINGLE), " "))
    return F.array_distinct(each)


def _bands(hashes: Column) -> Column:
    """The key of each band: the least and the greatest value of its hash function."""

    def key(b: Column) -> Column:
        each = F.transform(hashes, lambda h: F.xxhash64(h, b))
        return _once(each, lambda x: F.xxhash64(F.array_min(x), F.array_max(x)))

    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), key)


def template_table(templates: DataFrame) -> DataFrame:
    """template (a number), name, cap, shingles (strings) and hashes of each row of `templates` (name, text) that has any."""
    texts = templates.select(F.monotonically_increasing_id().alias("template"), "name", words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))
    shaped = texts.withColumn("hashes", F.array_distinct(shingle_hashes("w", SHINGLE))).withColumn("shingles", _strings(F.col("w"))).filter("size(hashes) > 0")
    # A template's stretch has as many shingles as its text, repeats included.
    n = F.size("w") - (SHINGLE - 1)
    return shaped.select("template", "name", "shingles", "hashes", F.ceil(F.pow(F.lit(2.0), F.ceil(2 * F.log2(n)) / 2)).cast("int").alias("cap"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of `value`, which is computed once: as a column it would be computed anew in each step of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _best(held: DataFrame) -> DataFrame:
    """row, cap, low, template, name and whether no other licence holds better at its place; see the module."""
    n = F.size("shingles")
    every = F.transform(F.slice("own", F.lit(1), F.size("own") - SHINGLE + 1), lambda _, i: F.array_join(F.slice("own", i + 1, SHINGLE), " "))
    at = F.array_compact(F.transform(every, lambda x, i: F.when(F.array_contains("shingles", x), F.col("low") + i)))
    stretch = lambda a, p: F.filter(a, lambda q: (q >= p) & (q < p + n))
    first = lambda a: F.array_max(F.transform(a, lambda p: F.struct(F.size(stretch(a, p)).alias("n"), (-p).alias("low"))))
    place = _once(at, lambda a: _once(first(a), lambda x: stretch(a, -x["low"])))
    each = held.select("row", "cap", "low", "template", "name", _once(place, lambda a: F.struct(a.alias("at"), (2 * F.size(a) - n).alias("score"))).alias("place"))
    each = each.select("row", "cap", "low", "template", "name", "place.score", F.explode("place.at").alias("pos"))
    top = F.max(F.struct("score", "name")).over(Window.partitionBy("row", "pos"))
    beaten = (F.col("top.score") > F.col("score")) & (F.col("top.name") != F.col("name"))
    return each.withColumn("top", top).groupBy("row", "cap", "low", "template", "name").agg((2 * F.count_if(beaten) <= F.count("*")).alias("best"))


def _windows(cap: int, need: int) -> Column:
    """The windows of a size class with at least `need` shingles that pass the filter, in order of their place."""
    stride = max(1, cap // 4)
    size = cap + stride - 1

    def around(p: Column, j: Column) -> Column:
        """The windows that hold both this passing shingle and the one that is `need` - 1 further."""
        low = F.greatest(F.floor((F.get("hits", j + (need - 1)) - size) / stride) + 1, F.lit(0)).cast("int")
        high = F.floor(p / stride).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    numbers = F.array_distinct(F.flatten(F.transform(F.slice("hits", F.lit(1), F.greatest(F.size("hits") - (need - 1), F.lit(0))), around)))
    return F.transform(numbers, lambda k: F.struct(F.lit(cap).alias("cap"), (k * stride).alias("low"), F.slice("h", k * stride + 1, size).alias("hashes"), F.slice("w", k * stride + 1, size + SHINGLE - 1).alias("own")))


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_windows (distinct windows that hold a template) and licenses (sorted names found) of each row.

    `templates` has name and text, one row for each notice or licence; TEMPLATES if it isn't given.
    """
    if templates is None:
        templates = docs.sparkSession.createDataFrame(TEMPLATES, "name string, text string")
    known = cut(template_table(templates))
    total = known.agg(F.sum(F.size("shingles"))).first()[0] or 0
    way = "broadcast" if total <= BROADCAST_SHINGLES else "merge"
    # A row for each size class, so two for each doubling of the longest template's length.
    classes = {r.cap: max(1, math.ceil(CONTAINED * r.least)) for r in known.groupBy("cap").agg(F.min(F.size("shingles")).alias("least")).collect()}
    bits = filter_words(known.select(F.explode("hashes").alias("h")).distinct())
    none = F.array().cast("array<struct<cap:int,low:int,hashes:array<bigint>,own:array<string>>>")
    shaped = id_and_text(docs, id_col, text_col).withColumn("w", words(ascii_lower(F.col("text")), NOT_ALNUM)).withColumn("h", shingle_hashes("w", SHINGLE)).withColumn("hits", hits("h", bits))
    found = F.when(F.size("hits") >= min(classes.values(), default=1), F.concat(none, *[_windows(c, n) for c, n in sorted(classes.items())])).otherwise(none)
    listed = cut(shaped.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("windows")))
    each = listed.select("row", F.explode("windows").alias("x")).select("row", "x.*")
    signed = each.select("row", "cap", "low", F.posexplode(_bands(F.col("hashes"))).alias("band", "key"))
    its = known.select("template", "cap", F.posexplode(_bands(F.col("hashes"))).alias("band", "key"))
    retrieved = signed.join(its.hint(way), ["cap", "band", "key"]).select("row", "cap", "low", "template").distinct()
    paired = retrieved.join(each.select("row", "cap", "low", "own"), ["row", "cap", "low"]).join(known.select("template", "name", "shingles").hint(way), "template")
    held = paired.filter(F.size(F.array_intersect(_strings(F.col("own")), "shingles")) >= CONTAINED * F.size("shingles"))
    matches = _best(held).groupBy("row").agg(F.count_distinct("cap", "low").alias("n_windows"), F.array_sort(F.collect_set(F.when(F.col("best"), F.col("name")))).alias("licenses"))
    return listed.join(matches, "row", "left").select("doc_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
