"""License detection by diagonal voting, in DataFrame functions only.

Every rolling k-gram of a text's words is hashed and joined to the positions of the same k-gram in
license templates: notices, the characteristic clauses of whole license texts, names, and SPDX identifiers. Hits vote for their diagonal (place in the text minus place in the template);
neighbouring diagonals, which a few inserted or missing words set apart, are merged, and a merged
span counts where enough of the template's k-grams are really in it.

Base labels come from phrases: places where a phrase's words stand one after the other.

Defined results: null and empty texts have no words, no places and no labels, score 0; repeated rows
get the same result each; null identifiers pass through; very long texts are treated whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: What a word is (in lower-cased text; the complement of [\x00-\x2F\x3A-\x60\x7B-\x7F], which matches
#: five times faster written this way), and the phrases of the base labels.
LICENSE_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Well-known notices, as their publishers word them.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution",
    ),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "bsd",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    ),
    (
        "isc",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl", "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    (
        "apache",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to "
        "reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    # names, and identifiers as they stand in source files
    ("bsd", "BSD 2 Clause License"),
    ("bsd", "BSD 3 Clause License"),
    ("mpl", "Mozilla Public License"),
    ("lgpl", "Lesser General Public License"),
    ("agpl", "Affero General Public License"),
    ("epl", "Eclipse Public License"),
    ("bsl", "Boost Software License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "SPDX-License-Identifier: Apache"),
    ("gpl", "SPDX-License-Identifier: GPL"),
    ("lgpl", "SPDX-License-Identifier: LGPL"),
    ("agpl", "SPDX-License-Identifier: AGPL"),
    ("bsd", "SPDX-License-Identifier: BSD"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("mpl", "SPDX-License-Identifier: MPL"),
    ("epl", "SPDX-License-Identifier: EPL"),
    ("bsl", "SPDX-License-Identifier: BSL"),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("cc0", "SPDX-License-Identifier: CC0"),
    ("cc", "SPDX-License-Identifier: CC"),
)

#: Words in a k-gram; diagonals at most so far apart are merged; share of a template's k-grams that a span needs.
GRAM = 3
DRIFT = 8
SHARE = 0.6


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def grams(w: str, k: int) -> Column:
    """Hashes of the k-grams of the word array ``w``, by place."""
    parts = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return F.expr(f"if(size({w}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({w}) - {k}), i -> xxhash64({parts})))")


def template_positions(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(gram, template, at, label, n_grams): a few hundred rows, whatever the corpus."""
    t = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, body string")
    t = t.select("template", "label", words(F.col("body")).alias("w")).withColumn("g", grams("w", k))
    return t.select("template", "label", F.size("g").alias("n_grams"), F.posexplode("g").alias("at", "gram"))


def license_spans(docs: DataFrame, templates=TEMPLATES, k: int = GRAM, drift: int = DRIFT, share: float = SHARE, key_cols=("id", "key")) -> DataFrame:
    """Verified spans: (id, key, template, label, start, end, share) of a table (id, key, text)."""
    hits = (
        docs.select(*key_cols, F.posexplode(grams("w", k)).alias("place", "gram"))
        .join(F.broadcast(template_positions(docs.sparkSession, templates, k)), "gram")  # size fixed by the templates
        .select(*key_cols, "template", "label", "n_grams", (F.col("place") - F.col("at")).alias("diagonal"), "at", "place")
    )
    # votes of one diagonal; a repeated row's hits fall together
    votes = hits.groupBy(*key_cols, "template", "label", "n_grams", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("place").alias("start"), F.max("place").alias("last"))
    w = Window.partitionBy(*key_cols, "template").orderBy("diagonal")
    merged = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > drift).cast("int"), F.lit(1))).withColumn("band", F.sum("new").over(w))
    spans = merged.groupBy(*key_cols, "template", "label", "n_grams", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"), F.min("start").alias("start"), (F.max("last") + k).alias("end"))
    # verification: enough different template k-grams, within about the template's own length
    return spans.where((F.col("found") >= share * F.col("n_grams")) & (F.col("end") - F.col("start") <= (F.col("n_grams") + k) + 2 * drift * F.greatest(F.lit(1), F.col("n_grams") / 8))).withColumn("share", F.col("found") / F.col("n_grams"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, **options) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), words(text).alias("w"))
    places, labels = [], []
    for phrase, label in phrases:
        p = phrase.split(" ")
        here = " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p))
        at = f"if(size(w) < {len(p)} or not array_contains(w, '{p[0]}'), cast(array() as array<int>), filter(sequence(0, size(w) - {len(p)}), i -> {here}))"
        places.append(F.expr(at))
        labels.append(label)
    base = src.select("id", "key", F.size("w").cast("long").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(places))])
    base = base.select(
        "id",
        "key",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(labels)])))).alias("base"),
    )
    more = license_spans(src, **options).groupBy("id", "key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    more = more.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "found", "share")
    out = base.join(more, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))).alias("score"),
    )
