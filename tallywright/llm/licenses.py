"""License scans by MinHash bands over overlapping text windows.

Words are lower-cased runs of letters and digits; shingles are five words.
Blocks of ``BLOCK`` shingles are sketched once; two adjacent blocks make a
window, so windows overlap by half. A sketch has ``BANDS`` one-row bands, the
minima of the shingle hashes under as many XOR masks. The index holds (band,
key, license) for the windows of a template at every offset; the windows'
(band, key) are joined with it, and each retrieved pair of document and
template is verified by exact shingle containment.

What bounds a miss: to lack a fifth of its shingles, a template of n shingles
can be edited in n/25 places within it (an edit takes five shingles) and at its
ends, so some run of at least eight shingles (four, in a template of five to
nine) stands unedited. A window of eight that starts every four shares six of
such a run (four of the short one) with a template's window, of ten (nine) in
all: no band collides with a probability under (4/10)**BANDS = 0.00004 %
((5/9)**BANDS = 0.008 %). Templates of fewer than five shingles must be there
whole to reach the containment, so each has one more key, its own minimum under
the first mask, which every window of one shingle is tried for: it always
collides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, saved

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK = 4
BANDS = 16

# Short public notices, the opening grants of common licenses, and whole texts of the short ones.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _shingles(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words; fewer words give none."""

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), hashes)


def _masks() -> list[int]:
    """BANDS points spread over the 64-bit hashes; the minimum under XOR with one is the hash nearest to it."""
    step, out, x = 0x9E3779B97F4A7C15, [], 0
    for _ in range(BANDS):
        x = (x + step) & (2**64 - 1)
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


def _template_shingles(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[int]]:
    """The templates' distinct shingle hashes, in order of text."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", _shingles(F.col("text")).alias("shingles")).collect()
    known = {r["license"]: list(dict.fromkeys(r["shingles"])) for r in rows}
    if short := [k for k, s in known.items() if not s]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return known


def template_keys(known: dict[str, list[int]]) -> list[tuple[int, int, str]]:
    """(band, key, license) of all windows of each template at every offset; band -1 is that of single shingles."""
    out = set()
    for name, shingles in known.items():
        if len(shingles) < 5:
            out.add((-1, min(h ^ _masks()[0] for h in shingles), name))
            continue
        for i in range(max(1, len(shingles) - 2 * BLOCK + 1)):
            part = shingles[i : i + 2 * BLOCK]
            out |= {(b, min(h ^ m for h in part), name) for b, m in enumerate(_masks())}
    return sorted(out)


def _sketches(h: Column) -> Column:
    """By block: the minima under the masks, unrolled over the block's shingles."""

    def sketch(block: Column) -> Column:
        part = F.struct(*[F.get(h, block * BLOCK + j).alias(f"x{j}") for j in range(BLOCK)])
        least = lambda s, m: F.least(*[s[f"x{j}"].bitwiseXOR(F.lit(m)) for j in range(BLOCK)])  # noqa: E731  skips nulls past the end
        return let(part, lambda s: F.array(*[least(s, m) for m in _masks()]))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / BLOCK).cast("int")), sketch)


def _keys(h: Column, known: set[int], single: set[int]) -> Column:
    """Distinct structs (band, key) of the windows that the index has in some band; most texts have none.

    A window is a block and the next one; the last block is also in the window before it.
    """

    def of_windows(blocks: Column) -> Column:
        n = F.size(blocks)
        minima = lambda i: F.zip_with(F.element_at(blocks, i), F.element_at(blocks, F.least(i + 1, n)), lambda a, b: F.least(a, b))
        hits = lambda i: F.filter(F.transform(minima(i), lambda v, band: F.when(v.isin(sorted(known)), F.struct(band.alias("band"), v.alias("key")))), lambda x: x.isNotNull())
        return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), hits))

    none = F.array().cast("array<struct<band:int,key:bigint>>")
    mask = F.lit(_masks()[0])
    ones = F.transform(F.filter(h, lambda x: x.bitwiseXOR(mask).isin(sorted(single))), lambda x: F.struct(F.lit(-1).alias("band"), x.bitwiseXOR(mask).alias("key"))) if single else none
    found = F.concat(ones, let(_sketches(h), of_windows)) if known else ones
    return F.when(F.size(h) > 0, F.array_distinct(found)).otherwise(none)


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment: each document and template whose shingles it contains to the given share.

    One row a document row and template, so repeated rows give repeated
    answers and a text may match several templates. Null and empty texts match
    nothing. Texts of any length are read whole; other columns are not read; an
    empty table gives an empty result. Templates are a fixed table, of which
    the driver makes the index; those under five words are refused.
    """
    spark = docs.sparkSession
    known = _template_shingles(spark, templates)
    keys = template_keys(known)
    sketch = lambda h: F.struct(h.alias("h"), _keys(h, {k for b, k, _ in keys if b >= 0}, {k for b, k, _ in keys if b < 0}).alias("keys"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(_shingles(F.col("text").cast("string")), sketch).alias("s"))
    # only texts with a known key go on; once stored, their numbers are facts
    stored = read.where(F.size("s.keys") > 0).select("doc_id", F.array_distinct("s.h").alias("h"), F.col("s.keys").alias("keys"))
    rows = saved(stored.withColumn("row", F.monotonically_increasing_id()))
    index = spark.createDataFrame(keys, "band int, key bigint, license string")
    met = rows.select("row", F.explode("keys").alias("k")).select("row", "k.band", "k.key").join(index, ["band", "key"]).select("row", "license").distinct()
    whole = spark.createDataFrame(list(known.items()), "license string, t array<bigint>")
    pairs = met.join(whole, "license").join(rows.select("row", "doc_id", "h"), "row")
    share = F.size(F.array_intersect("h", "t")) / F.size("t")
    return pairs.withColumn("containment", share).where(F.col("containment") >= containment).select("doc_id", "license", "containment")
