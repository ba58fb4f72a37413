"""Operator 8, license scans: MinHash bands over overlapping text windows retrieve templates, containment verifies.

Words are lower-case runs of letters and digits. A template is the set of its shingles of five words (of all its words,
if it has fewer). Templates are classed by the length of their shingles and by size (powers of two of their numbers of
shingles). A class has windows of its own: 2 * span words, one every span words, span being its longest template's length,
so any passage as long as a template lies whole in some window. A window's MinHash is taken over all of its shingles,
whatever they are, in bands of one hash each; a template is retrieved where the two agree in a band. The number of bands
follows from the worst case of the class: the least template, just contained enough, in a full window of other words. With
that Jaccard similarity j they meet in some band with probability 1 - (1 - j) ** bands, which is 1 - MISS at least. Exact
containment of the template's shingles in the window then decides.

A window and a template agree in a band only through a shingle that both have. So windows without any shingle of their
class's templates are left out before they are signed: that loses nothing, and most of a corpus is never signed.

Defined cases: null and empty texts match nothing and keep their row; each row is scanned on its own, whole; ties
between templates are all reported; repeated rows share their result; an empty table gives an empty result; text is
replaced by the results and other columns are carried, but those named like a result (licenses, n_windows, containment)
give way to it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, text_of

SHINGLE = 5
MISS = 1e-6
MIN_CONTAINMENT = 0.8
BROADCAST = 1_000_000  # shingles times bands of the templates
SEPARATORS = r"[^\p{L}\p{N}]+"

#: Notices as authors put them into files, and whole license texts, by license.
TEMPLATES = {
    "rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_shingles(text: str) -> list[list[str]]:
    w = template_words(text)
    k = min(SHINGLE, len(w))
    return [list(x) for x in dict.fromkeys(tuple(w[i : i + k]) for i in range(len(w) - k + 1))]


@dataclass(frozen=True)
class Kind:
    """A class of templates: its number, the length of its shingles, its span, bands and templates by name."""

    number: int
    k: int
    span: int
    bands: int
    templates: dict[str, list[str]]


def kinds(templates: dict[str, str], least: float = MIN_CONTAINMENT) -> list[Kind]:
    grouped: dict[tuple[int, int], dict[str, list[str]]] = {}
    for name, t in templates.items():
        g = template_shingles(t)
        grouped.setdefault((len(g[0]), len(g).bit_length()), {})[name] = [" ".join(x) for x in g]
    out = []
    for number, ((k, _), held) in enumerate(sorted(grouped.items())):
        span = max(len(template_words(templates[n])) for n in held)
        window = 2 * span - k + 1  # shingles of a full one
        shared = lambda n: max(1, math.ceil(least * n - 1e-9))
        worst = min(shared(n) / (window + n - shared(n)) for n in map(len, held.values()))
        out.append(Kind(number, k, span, 1 if worst >= 1 else math.ceil(math.log(MISS) / math.log1p(-worst)), held))
    return out


def met_windows(words: Column, kind: Kind) -> Column:
    """The windows of a class that have a shingle of one of its templates: structs of class, window and the window's shingles."""
    wanted = sorted({g for t in kind.templates.values() for g in t})
    firsts = sorted({g.split(" ")[0] for g in wanted})
    shingle = lambda w, i: F.array_join(F.slice(w, i + 1, kind.k), " ")

    def windows(at: Column) -> Column:
        near = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / kind.span).cast("int"), (F.floor(i / kind.span) - 1).cast("int")))))

        def whole(j: Column) -> Column:
            begin = F.greatest(j * kind.span, F.lit(0))  # the text's first words are also a window that begins before them
            own = F.slice(words, begin + 1, (j + 2) * kind.span - begin)
            each = F.transform(F.sequence(F.lit(0), F.size(own) - kind.k), lambda i: shingle(own, i))
            return F.struct(F.lit(kind.number).alias("class"), j.alias("window"), F.when(F.size(own) >= kind.k, F.array_distinct(each)).otherwise(F.array().cast("array<string>")).alias("g"))

        return F.transform(near, whole)

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - kind.k), lambda i: F.get(words, i).isin(firsts))
    hits = F.filter(starts, lambda i: shingle(words, i).isin(wanted))
    none = F.array().cast("array<struct<class:int,window:int,g:array<string>>>")
    return F.when(F.size(words) >= kind.k, let(hits, windows)).otherwise(none)


def minhash(shingles: Column, bands: Column) -> Column:
    """Strings, each a band's number and the least hash of the shingles under the band's seed."""
    least = lambda b: F.array_min(F.transform(shingles, lambda g: F.xxhash64(b, g)))
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.concat_ws(":", b, least(b)))


def matches(docs: DataFrame, row: str, text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = MIN_CONTAINMENT) -> DataFrame:
    """Windows that hold a template: row, class, window, license, containment. row: the column that names docs' rows."""
    every = kinds(templates, least)
    words = F.array_remove(F.split(F.lower(text_of(F.col(f"`{text}`"))), SEPARATORS), "")
    found = let(words, lambda w: F.concat(*[met_windows(w, kind) for kind in every]))
    windows = docs.select(F.col(f"`{row}`").alias("row"), F.explode(found).alias("x")).select("row", "x.class", "x.window", "x.g")
    rows = [(kind.number, kind.bands, name, g) for kind in every for name, g in kind.templates.items()]
    known = docs.sparkSession.createDataFrame(rows, "class int, bands int, license string, tg array<string>")
    held = F.broadcast if sum(n * len(g) for _, n, _, g in rows) <= BROADCAST else lambda df: df  # counted on the driver, which was given the templates
    bands = known.select("class", "license", "tg", F.explode(minhash(F.col("tg"), F.col("bands"))).alias("band"))  # as large as the templates
    number = F.element_at(F.create_map(*[F.lit(x) for kind in every for x in (kind.number, kind.bands)]), F.col("class"))
    signed = windows.select("row", "class", "window", "g", F.explode(minhash(F.col("g"), number)).alias("band"))
    met = signed.join(held(bands), ["class", "band"]).dropDuplicates(["row", "class", "window", "license"])
    share = F.size(F.array_intersect("tg", "g")) / F.size("tg")
    return met.select("row", "class", "window", "license", share.alias("containment")).filter(F.col("containment") >= least)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row of docs, without its text: licenses (sorted array), n_windows that match, and the best containment.

    Rows are named by two hashes of id and text: equal rows share their result. What is shuffled is windows that share a
    band with a template."""
    key = [F.col(f"`{doc_id}`"), F.col(f"`{text}`")]
    name = F.concat_ws(":", F.xxhash64(*key), F.xxhash64(F.lit(1), *key))
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "licenses", "n_windows", "containment")]
    named = docs.select(name.alias("row"), key[1].alias("text"))
    found = cut(
        matches(named, "row", "text", templates).groupBy("row", "license").agg(F.count_distinct("window").alias("n"), F.max("containment").alias("c"))
        .groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.sum("n").alias("n_windows"), F.max("c").alias("containment"))
    )
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], name.alias("row"))
    return rows.join(found, "row", "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)],
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"),
        F.coalesce(F.round("containment", 6), F.lit(0.0)).alias("containment"),
    )
