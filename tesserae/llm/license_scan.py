"""License scans in DataFrame functions only.

Words are runs of ASCII letters, digits and any characters outside ASCII, in lower case; a shingle is five words. A text and the
templates are cut into overlapping windows of shingles. The MinHash of a window under each band's hash function
(one row a band) retrieves the templates that have a window with an equal MinHash; a template found so is kept if
the text holds at least `containment` of its distinct shingles, compared as strings.

Two window sizes are used. Templates of fewer than WIDE shingles use windows of one shingle, at every place: a
text that holds one of their shingles is sure to be retrieved. Longer ones use windows of WIDE shingles, in texts at
every second half, in templates at every place. A text with 80 % of such a template's shingles has a
window of which a template window shares 80 % or more, a Jaccard similarity of 2/3; BANDS bands of one row miss it
with a probability of (1/3)**BANDS, and an unedited window never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WIDE = 16
BANDS = 4
CONTAINMENT = 0.8
#: Up to so many keys the index is part of the plan.
LITERAL_KEYS = 50_000
#: Short notices by which texts state their license, and opening parts of license texts. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("GPL-2.0-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0-text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("MIT-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-clause-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
)
#: Between words stands any ASCII character but letters and digits.
GAP = r"[^0-9a-z\x{80}-\x{10ffff}]+"


def words(text: Column) -> Column:
    """Words of a text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once; inside another lambda function it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over(n: Column, step: int, body) -> Column:
    """body(1), body(1 + step), ... up to n."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n, F.lit(step))).otherwise(F.array().cast("array<int>")), body)


def shingles(w: Column) -> Column:
    """Shingles at every place; none if there are fewer words."""
    return _let(w, lambda v: _over(F.size(v) - (SHINGLE - 1), 1, lambda i: F.array_join(F.slice(v, i, SHINGLE), " ")))


def hashed(w: Column) -> Column:
    """64-bit hashes of the shingles at every place."""
    return _let(w, lambda v: _over(F.size(v) - (SHINGLE - 1), 1, lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(-1, SHINGLE - 1)])))


def _longs(*values: Column) -> Column:
    return F.array(*values).cast("array<bigint>")


def _windows(own: Column, inside: bool, of, one) -> Column:
    """The least (of, one: of an array, of two values) of windows of WIDE hashes, at the places _wide names."""
    half = WIDE // 2
    if inside:
        return _let(own, lambda m: _over(F.size(m) - (WIDE - 1), 1, lambda i: of(F.slice(m, i, WIDE))))

    def pairs(b: Column) -> Column:
        return _over(F.size(b) - 1, 1, lambda i: one(F.get(b, i - 1), F.get(b, i)))

    def windows(m: Column) -> Column:
        last = F.when(F.size(m) >= WIDE, _longs(of(F.slice(m, F.size(m) - (WIDE - 1), WIDE)))).otherwise(_longs())
        return F.concat(_let(_over(F.size(m) - (half - 1), half, lambda i: of(F.slice(m, i, half))), pairs), last)

    return _let(own, windows)


def _wide(h: Column, inside: bool) -> list[Column]:
    """Per band the MinHashes of windows of WIDE shingles: with inside at every place, else every half a window and at
    the end. Two bands take the least and the greatest hash, two the same of the hashes hashed again: four orders."""
    again = F.transform(h, lambda x: F.xxhash64(x))
    return [_windows(own, inside, of, one) for own in (h, again) for of, one in ((F.array_min, F.least), (F.array_max, F.greatest))]


def templates(spark: SparkSession, rows: tuple = TEMPLATES) -> DataFrame:
    """(license_id, text), a table of bounded size."""
    return spark.createDataFrame(list(rows), "license_id string, text string")


def index(known: DataFrame) -> DataFrame:
    """(band, key, ids): per band the retrieval keys of the templates (license_id, h) and the licenses they stand for,
    comma-joined. Band 0 has the windows of one shingle. It has at most BANDS keys for a template's word."""
    narrow = known.where(F.size("h") < WIDE).select("license_id", F.lit(0).alias("band"), F.explode("h").alias("key"))
    wide = [known.where(F.size("h") >= WIDE).select("license_id", F.lit(b).alias("band"), F.explode(k).alias("key")) for b, k in enumerate(_wide(F.col("h"), True), 1)]
    rows = narrow
    for w in wide:
        rows = rows.union(w)
    return rows.groupBy("band", "key").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("ids"))


def _hits(keys: Column, ids: dict[int, str]) -> Column:
    """The licenses of those keys that are in the index, as comma-joined strings."""
    if not ids:
        return F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return F.transform(F.filter(keys, lambda x: x.isin(*ids)), lambda x: F.element_at(table, x))


def _by_literals(at: DataFrame, keys: list[Column], held: list) -> DataFrame:
    """(doc_id, text, license_id) of the texts at (doc_id, text, h) and the licenses that share a key with them."""
    ids: dict[int, dict[int, str]] = {b: {} for b in range(BANDS + 1)}
    for r in sorted(held, key=lambda r: (r["band"], r["key"])):
        ids[r["band"]][r["key"]] = r["ids"]
    hits = F.concat(*[_hits(k, ids[b]) for b, k in enumerate(keys)])
    # the row number keeps the optimizer from evaluating the hits a second time in a pushed-down filter
    found = at.select("doc_id", "text", F.array_distinct(F.split(F.array_join(hits, ","), ",")).alias("ids"), F.monotonically_increasing_id().alias("row"))
    return found.where(F.element_at("ids", 1) != "").select("doc_id", "text", F.explode("ids").alias("license_id"))


def _by_join(at: DataFrame, keys: list[Column], held: DataFrame) -> DataFrame:
    """The same for an index of any size, by a join on the keys."""
    def of_band(band: int):
        return lambda x: F.struct(F.lit(band).alias("band"), x.alias("key"))

    own = F.array_distinct(F.concat(*[F.transform(k, of_band(b)) for b, k in enumerate(keys)]))
    numbered = at.withColumn("row", F.monotonically_increasing_id())
    of_text = numbered.select("doc_id", "text", "row", F.inline(own)).join(held, ["band", "key"])
    hits = of_text.select("row", "doc_id", "text", F.explode(F.split("ids", ",")).alias("license_id"))
    return hits.groupBy("row", "license_id").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text")).drop("row")


def scan(docs: DataFrame, known: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """A row per row of docs (doc_id, text) and license found in it: doc_id, license_id, n_found, n_template, the
    distinct shingles of the template and how many of them the text holds.

    Null and empty texts, and those of fewer than five words, hold no license and give no row; very long texts are
    scanned whole. Repeated rows give one row for each license they hold; an empty table gives an empty one; other
    columns are left out. `known` (license_id, text) holds the templates, with ids free of commas; no template of fewer
    than five words is found. An index of up to LITERAL_KEYS keys is part of the plan, which then shuffles no
    documents; a larger one is joined on its keys, as is the list of templates.
    """
    spark = docs.sparkSession
    known = (known if known is not None else templates(spark)).select("license_id", words(F.col("text")).alias("w"))
    known = known.select("license_id", F.array_distinct(shingles(F.col("w"))).alias("template"), hashed(F.col("w")).alias("h")).where(F.size("template") > 0)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at, keys, held = text.select("doc_id", "text", hashed(words(F.col("text"))).alias("h")), [F.col("h"), *_wide(F.col("h"), False)], index(known)
    small = held.limit(LITERAL_KEYS + 1).collect()
    few = len(small) <= LITERAL_KEYS  # then the templates are few as well
    found = _by_literals(at, keys, small) if few else _by_join(at, keys, held)
    found = found.select("doc_id", F.array_distinct(shingles(words(F.col("text")))).alias("own"), "license_id")
    own = known.select("license_id", "template")
    found = found.join(F.broadcast(own) if few else own, "license_id")
    found = found.select("doc_id", "license_id", F.size(F.array_intersect("own", "template")).cast("long").alias("n_found"), F.size("template").cast("long").alias("n_template"))
    return found.where(F.col("n_found") >= F.lit(containment) * F.col("n_template"))
