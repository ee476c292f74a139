"""Operator 8 - license scans, with DataFrame functions only.

A template matches a text if a window holds at least ``CONTAINED`` of the template's shingles of five words - one of fewer
words is a single shingle of its whole sequence - and all of its telling words, those by which licenses with nearly the same text
differ. Windows of twice a size class overlap by half, so any run of words up to the class, the least power of two that holds
the template, lies whole in one of them.

* Gate: for each template some words are picked whose shingles are more than the fifth that a match may
  lack; a text without any of these words can't match. This is a test of whole texts and loses nothing.
* Bands: the ``SKETCH`` least hashes of a window's shingles are its MinHash signature, each of them a band. Windows and templates of
  one size class that share a band are retrieved. Windows of the two least classes have no more shingles than that, so they share one with whatever they hold
  a part of; in the others a match makes up at least 0.18 of window and template together, and misses all bands once in 1e8.
* Containment: each retrieved template's shingles are counted in the window exactly, and its telling words are looked for.
* Overlaps: a place in a text belongs to the fullest match that covers it, and a match stays if the places that its license
  owns still hold enough of the template. So a license whose text is part of another's is not found within that one, and a clause that several
  licenses share is found under its family's name where none of them is. Of two licenses of which one's text has the other's, both within one window,
  the fuller is named.

The templates are a parameter; their table is small by its kind, and is refused beyond ``MOST_SHINGLES``
shingles, up to which it is broadcast.

Edge cases: a null or empty text has no license. Copies of a row get equal rows; rows of one doc_id but
different texts are scanned apart. A null doc_id is like any other. A template without words is refused.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE, CONTAINED, SKETCH, LEAST_CLASS = 5, 0.8, 96, 16
MOST_SHINGLES = 20_000
#: Notices and whole texts by license. Fixed values.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see""",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation""",
    ],
    "lgpl-3.0": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see""",
    ],
    "agpl-3.0": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see""",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-2-clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "bsd-3-clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "zlib": [
        """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.""",
    ],
    "all-rights-reserved": ["All rights reserved."],
}
#: Words in a row that tell a license from others with nearly the same text; a template must have those in the text that it has itself. Fixed values.
TELLING = {
    "gpl-3.0": ["gnu general public license", "version 3"],
    "gpl-2.0": ["gnu general public license", "version 2"],
    "lgpl-3.0": ["gnu lesser general public license", "version 3"],
    "agpl-3.0": ["gnu affero general public license", "version 3"],
    "cc-by-4.0": ["cc by 4", "attribution 4"],
    "cc-by-nc-4.0": ["by nc", "attribution noncommercial"],
    "apache-2.0": ["apache license", "version 2"],
    "mit": ["mit license"],
    "bsd-3-clause": ["neither the name"],
    "mpl-2.0": ["mozilla public license"],
}
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_GAPS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def template_table(templates: dict[str, list[str]], telling: dict[str, list[str]] | None = None) -> list[tuple[str, int, int, int, list[str], list[str]]]:
    """(license, number of the text, size class, width of its shingles, its distinct shingles, its telling words)"""
    out = []
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                raise ValueError(f"a template of {name} has no words")
            width, size, whole = min(SHINGLE, len(words)), LEAST_CLASS, f" {' '.join(words)} "
            while size < len(words):
                size *= 2
            told = [t for t in (telling or {}).get(name, []) if f" {t} " in whole]
            out.append((name, k, size, width, sorted({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}), told))
    if sum(len(t[4]) for t in out) > MOST_SHINGLES:
        raise ValueError(f"more than {MOST_SHINGLES} shingles of templates")
    return out


def gate_words(table: list[tuple], contained: float = CONTAINED) -> list[str]:
    """Words of which every text that matches a template has one: the longest first, until the rest of the shingles is too few."""
    out: set[str] = set()
    for _, _, _, _, shingles, _ in table:
        left = [s for s in shingles if not out & set(s.split())]
        while len(left) >= contained * len(shingles):
            out.add(max({w for s in left for w in s.split()}, key=lambda w: (len(w), w)))
            left = [s for s in left if not out & set(s.split())]
    return sorted(out)


def _sketch(shingles):
    """The signature of an array of shingles: its least hashes, each a band."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(shingles, lambda x: F.xxhash64(x)))), 1, SKETCH)


def _grams(words, width):
    """The runs of ``width`` words, a column, with their places from 0."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.concat_ws(" ", F.slice(words, i, width)).alias("shingle")))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, telling: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, comma-joined) and best (the largest containment): a row for each of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    table = template_table(templates or TEMPLATES, TELLING if templates is None else telling)
    known = spark.createDataFrame(table, "license string, k int, size int, width int, wanted array<string>, telling array<string>")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # one pass over the text, which looks closer only where a word begins
    gate = F.col("text").rlike(rf"(?i)(?<![0-9a-z])(?:{'|'.join(gate_words(table))})")
    texts = rows.where(gate).select(F.struct("doc_id", "t").alias("row"), F.filter(F.split(lower, _GAPS), lambda w: w != "").alias("w"))

    def windows(size: int):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / size).cast("int") - 1, F.lit(0))), lambda j: F.struct(F.lit(size).alias("size"), j.alias("window"), F.slice("w", j * size + 1, F.lit(2 * size)).alias("own")))

    def shingles(size: int):
        widths = sorted({t[3] for t in table if t[2] == size})
        return F.flatten(F.array(*[F.transform(_grams(F.col("own"), F.lit(n)), lambda g: g["shingle"]) for n in widths]))

    sizes = sorted({t[2] for t in table})
    held = texts.select("row", F.explode(F.concat(*map(windows, sizes))).alias("x")).select("row", "x.*")
    signed = F.coalesce(*[F.when(F.col("size") == n, _sketch(shingles(n))) for n in sizes])
    bands = held.select("row", "size", "window", F.explode(signed).alias("band"))
    posted = known.select("license", "k", "size", F.explode(_sketch(F.col("wanted"))).alias("band"))
    met = bands.join(F.broadcast(posted), ["size", "band"]).select("row", "size", "window", "license", "k").distinct()

    own = F.slice("w", F.col("window") * F.col("size") + 1, 2 * F.col("size"))
    match = ["row", "license", "k", "size", "window"]
    tried = met.join(texts, "row").join(F.broadcast(known), ["license", "k", "size"]).withColumn("own", own)
    spots = F.filter(_grams(F.col("own"), F.col("width")), lambda g: F.array_contains("wanted", g["shingle"]))
    tried = tried.where(F.forall("telling", lambda t: F.contains(F.concat(F.lit(" "), F.concat_ws(" ", "own"), F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))).select(*match, F.size("wanted").alias("of"), spots.alias("spots"))
    tried = tried.withColumn("n", F.size(F.array_distinct(F.transform("spots", lambda g: g["shingle"])))).where(F.col("n") / F.col("of") >= CONTAINED)
    places = tried.select(*match, "of", "n", F.explode("spots").alias("g")).select(*match, "of", "n", (F.col("window") * F.col("size") + F.col("g.at")).alias("at"), "g.shingle")
    owner = F.max(F.struct("n", "license")).over(Window.partitionBy("row", "at"))
    found = places.withColumn("owner", owner["license"]).where("owner = license").groupBy(*match).agg(F.count_distinct("shingle").alias("left"), F.first("n").alias("n"), F.first("of").alias("of")).where(F.col("left") / F.col("of") >= CONTAINED)
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("names"), F.max(F.col("n") / F.col("of")).alias("best"))
    return (
        rows.select(F.struct("doc_id", "t").alias("row"))
        .join(by_row, "row", "left")
        .select("row.doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    listed = lambda x: f"[{', '.join(repr(s) for s in x)}]::varchar[]"
    rows = ", ".join(f"('{name}', {k}, {size}, {width}, {listed(shingles)}, {listed(told)})" for name, k, size, width, shingles, told in template_table(TEMPLATES, TELLING))
    return rf"""
with k(license, k, size, width, wanted, telling) as (values {rows}),
d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
s as (select r, width, i - 1 pos, array_to_string(w[i:i + width - 1], ' ') s from (select r, w, width, unnest(range(1, len(w) - width + 2)) i from d, (select distinct width from k) where len(w) >= width)),
h as (select r, pos, s.s, license, k.k, size, s.width, of from s join (select license, k, size, width, len(wanted) of, unnest(wanted) s from k) k on s.s = k.s and s.width = k.width),
v as (select *, pos // size - o win from h, (values (0), (1)) t(o) where pos // size - o >= 0 and pos + width <= (pos // size - o + 2) * size),
c as (select r, license, k, size, win, count(distinct s) n, any_value(of) of from v group by all having count(distinct s) / any_value(of) >= {CONTAINED}),
m as (select c.* from c join d using (r) join k using (license, k, size) where len(list_filter(telling, lambda t: not contains(' ' || array_to_string(w[win * size + 1:(win + 2) * size], ' ') || ' ', ' ' || t || ' '))) = 0),
p as (select v.r, v.license, v.k, v.size, v.win, v.pos, v.s, m.n, m.of from v join m using (r, license, k, size, win)),
o as (select *, first_value(license) over (partition by r, pos order by n desc, license desc) owned from p),
f as (select r, license, any_value(n) / any_value(of) share from o where owned = license group by r, license, k, size, win having count(distinct s) / any_value(of) >= {CONTAINED}),
g as (select r, count(distinct license) n, string_agg(distinct license, ',' order by license) l, max(share) b from f group by 1)
select d.doc_id, coalesce(n, 0) n_licenses, coalesce(l, '') licenses, coalesce(b, 0.0) best from d left join g using (r)
"""


OP8_SQL = _sql()
