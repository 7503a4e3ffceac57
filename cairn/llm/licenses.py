r"""Operator 4: license scans by diagonal voting.

Words are runs of ASCII letters and digits and of other characters outside ASCII, A-Z in lower case. The
hashes of all rolling K-word grams of the documents are joined to the grams of the templates, a constant
table that goes to every task. A hit votes for the diagonal (place in the document less place in the template); votes
are counted for each diagonal, neighbouring diagonals of one template (words added or missing) are
merged, and each merged span is verified: the hits' words are compared with the template's, and a phrase
needs all of its words in a row, a license text SHARE of its grams, each of its places counted once whatever the diagonals that hit it.

Defined cases: a null or empty text has no words and no labels; rows with equal id and text get equal
rows; a null id is an id of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

K = 3
#: Of a license text's grams, the share that a span must have.
SHARE = 0.5
#: Diagonals this near to each other, with spans this many words apart at most, are one passage.
SLACK, GAP = 4, 12
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages of public license texts by which the texts themselves are known.
TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License",
}
#: Whole public license texts and the notices of longer licenses, with their versions.
WHOLE = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 3.0 Unported License"),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under the Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
)


def words(text: Column) -> Column:
    # Of all characters outside ASCII only the Kelvin sign has an ASCII letter alone as lower case; it must not become one.
    parts = F.split(F.lower(F.replace(text, F.lit("K"), F.lit("Ｋ"))), BETWEEN)

    def inner(p: Column) -> Column:
        """Without the empty texts before the first word and after the last."""
        first = F.when(p[0] == "", 1).otherwise(0)
        last = F.when(F.element_at(p, -1) == "", 1).otherwise(0)
        return F.slice(p, first + 1, F.greatest(F.size(p) - first - last, F.lit(0)))

    return F.transform(F.array(parts), inner)[0]


def gram(own: Column, w: Column, i: Column) -> Column:
    return F.xxhash64(w, *[F.get(own, i + j) for j in range(1, K)])


def _places(own: Column) -> Column:
    return F.slice(own, 1, F.greatest(F.size(own) - (K - 1), F.lit(0)))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, label, i < len(PHRASES), text) for i, (text, label) in enumerate([*PHRASES.items(), *((t, k) for k, t in [*TEXTS.items(), *WHOLE])])]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, said string").withColumn("t_words", words(F.col("said")))
    grams = F.transform(F.array("t_words"), lambda own: F.transform(_places(own), lambda w, i: gram(own, w, i)))[0]
    table = table.select("template", "label", "base", "t_words", F.posexplode(grams).alias("t_place", "gram"))
    return table.select("template", "label", "base", "t_place", "gram", F.slice("t_words", F.col("t_place") + 1, K).alias("t_gram"), (F.size("t_words") - (K - 1)).alias("t_size"))


def hits(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words and hits (place, gram, said) of each row: the grams that some template has.

    The join's keys, a few hundred constants, are tested where the grams are made, so that only hits become rows.
    """
    keys = [r["gram"] for r in templates(docs.sparkSession).select("gram").distinct().collect()]

    def of(own: Column) -> Column:
        hit = lambda w, i: F.when(gram(own, w, i).isin(keys), F.struct(i.alias("place"), gram(own, w, i).alias("gram"), F.slice(own, i + 1, K).alias("said")))
        return F.struct(F.size(own).cast("long").alias("n_words"), F.filter(F.transform(_places(own), hit), lambda h: h.isNotNull()).alias("hits"))

    both = F.transform(F.array(words(F.col("text"))), of)[0]
    return docs.select("doc_id", "key", both.alias("both")).select("doc_id", "key", F.col("both.n_words").alias("n_words"), F.col("both.hits").alias("hits"))


def votes(found: DataFrame) -> DataFrame:
    """doc_id, key, template, label, base, t_size, diagonal, and what voted for it: n, lo, hi (places in the document)."""
    joined = (
        found.select("doc_id", "key", F.explode("hits").alias("h"))
        .select("doc_id", "key", F.col("h.place").alias("place"), F.col("h.gram").alias("gram"), F.col("h.said").alias("said"))
        .join(F.broadcast(templates(found.sparkSession)), "gram")
        .filter(F.col("said") == F.col("t_gram"))  # hashes alone don't vote
    )
    by = joined.groupBy("doc_id", "key", "template", "label", "base", "t_size", (F.col("place") - F.col("t_place")).alias("diagonal"))
    return by.agg(F.size(F.collect_set("place")).alias("n"), F.collect_set("t_place").alias("t_places"), F.min("place").alias("lo"), F.max("place").alias("hi"))


def passages(found: DataFrame) -> DataFrame:
    """The verified spans of the rows of hits(): doc_id, key, label, base, start (in words), score."""
    found = votes(found)
    phrases = found.filter("base and n = t_size").select("doc_id", "key", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    w = Window.partitionBy("doc_id", "key", "template").orderBy("lo", "diagonal")
    new = F.coalesce((F.col("lo") > F.lag("hi").over(w) + GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > SLACK), F.lit(True))
    spans = (
        found.filter("not base").withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(w))
        .groupBy("doc_id", "key", "template", "label", "base", "t_size", "span")
        .agg(F.min("lo").alias("start"), (F.size(F.array_distinct(F.flatten(F.collect_list("t_places")))) / F.first("t_size")).alias("score"))
        .filter(F.col("score") >= SHARE)
    )
    return phrases.unionByName(spans.select("doc_id", "key", "label", "base", "start", "score"))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    rows = shared.texts(docs).withColumn("key", F.xxhash64("text"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    all_rows = shared.stored(hits(rows), "license-hits")
    found = passages(all_rows).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max("score").alias("score"),
    )
    out = all_rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
