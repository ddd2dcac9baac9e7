"""Licence scans with DataFrame operations only.

Lines, paragraphs (headers run over several lines) and licence files are compared with templates by the cosine of
sparse TF-IDF vectors, with 1 + ln tf; a file that has no licence of its own takes that of the nearest directory above
it that has a licence file, found by joins on paths.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

# Notices by which licences are recognised, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved."),
]

# Titles, headers and opening paragraphs of the licences' own texts.
BODIES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEMPLATES = NOTICES + BODIES + [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in NOTICES) if name != "Proprietary"]

TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Words that say nothing of a licence; neither texts nor templates have them as terms.
LITTLE = "a all an and any are as at be been but by can do for from had has have if in is it its may no nor not of on one or other out so such that the these this those to was were which whom will with you your".split()
FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying"
LINES = "[\r\n]+"
# lines without a letter or digit part paragraphs, as in comments
PARAGRAPHS = "[\r\n][^A-Za-z0-9\r\n]*[\r\n][^A-Za-z0-9]*"
FEW = 1_000_000  # rows that may be sent to every task
SALTS = 16


def terms_of(text: str) -> list[str]:
    return [w for w in re.findall(TERM, text.lower()) if w not in LITTLE]


def terms(unit: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(unit), F.lit(TERM), F.lit(0)), lambda w: ~w.isin(LITTLE))


def weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """Inverse document frequencies by term, that of an unknown term, and unit vectors of the templates (number, licence, term, weight)."""
    bags = [terms_of(t) for _, t in templates]
    df: dict[str, int] = {}
    for bag in bags:
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags)):
        v = {w: (1 + math.log(bag.count(w))) * idf[w] for w in set(bag)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(k, name, w, v[w] / norm) for w in sorted(v)]
    return idf, math.log(1 + len(bags)) + 1, rows


def telling(templates: list[tuple[str, str]], threshold: float) -> list[str] | None:
    """Terms one of which every text within the threshold of a template has; None if there are none such.

    A text without any of some terms has, by Cauchy and Schwarz, a cosine of at most the norm of what is left of the
    template's unit vector without them. So terms are taken, those first that bring most templates nearest to their end, until less than the threshold is left of each.
    """
    if threshold <= 1e-6:
        return None
    least, vectors, left, taken = (threshold - 1e-6) ** 2, {}, {}, []
    for k, _, w, x in weights(templates)[2]:
        vectors.setdefault(k, {})[w] = x * x
        left[k] = left.get(k, 0.0) + x * x
    while open_ := [k for k, x in left.items() if x >= least * (1 - 1e-9)]:
        gain: dict[str, float] = {}
        for k in open_:
            for w, x in vectors[k].items():
                if w not in taken:
                    gain[w] = gain.get(w, 0.0) + min(x, left[k] - least + 1e-6)
        best = max(sorted(gain), key=gain.get)
        taken.append(best)
        for k in open_:
            left[k] -= vectors[k].get(best, 0.0)

    return sorted(taken)


def near(unit: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Whether a text can be within the threshold of a template; false only for texts that can't.

    As 1 <= 1 + ln tf <= tf, the squared norm is at least the sum of idf^2 over the terms, and a template's dot product at
    most a sum over all occurrences. So what falls short by these sums does so by the cosine.
    """
    idf, unknown, rows = weights(templates)
    zero = F.lit(0.0)
    most: dict[str, float] = {}
    own: dict[int, dict[str, float]] = {}
    for k, _, w, x in rows:
        most[w] = max(most.get(w, 0.0), x * idf[w])
        own.setdefault(k, {})[w] = x * idf[w]
    square = {w: x * x for w, x in idf.items()}
    total = lambda of, terms: F.aggregate(terms, zero, lambda a, w: a + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair]), w), zero))

    def able(held: Column, count: Column) -> Column:
        def enough(sums: Column) -> Column:
            least = (threshold - 1e-6) * F.sqrt(sums + (count - F.size(F.array_distinct(held))) * unknown * unknown)  # similarities are rounded to six places
            return (total(most, held) >= least) & reduce(lambda a, b: a | b, [total(of, held) >= least for of in own.values()])

        return F.exists(F.array(total(square, F.array_distinct(held))), enough)

    # each step is bound to a variable, so that it is computed once
    tokens = F.array(terms(unit))
    halves = F.transform(tokens, lambda t: F.struct(F.filter(t, lambda w: w.isin(sorted(idf))).alias("held"), F.size(F.array_distinct(t)).alias("n")))
    return F.exists(halves, lambda h: (F.size(h["held"]) > 0) & able(h["held"], h["n"]))


def matched(units: DataFrame, keys: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """Of units(keys, unit) the best template of each within the threshold: keys, license, similarity."""
    spark = units.sparkSession
    idf, unknown, rows = weights(templates)
    frame = F.broadcast(spark.createDataFrame(rows, "template int, license string, term string, w double"))  # as many rows as the templates have terms
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    tf = units.select(*keys, F.explode(terms(F.col("unit"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    v = tf.join(known, "term", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown)))
    norms = v.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = v.join(frame, "term").groupBy(*keys, "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    both = dots.join(norms, keys).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("template")).alias("t"), "license")).alias("b")
    return both.groupBy(*keys).agg(best).select(*keys, F.col("b.license").alias("license"), F.col("b.similarity").alias("similarity"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def units(known: DataFrame) -> DataFrame:
    """Lines (kind 0) and paragraphs of several lines (kind 1) of known(id, u, text, file): id, u, file, kind, pos, unit."""
    cut = lambda pattern, kind: known.select("id", "u", "file", F.lit(kind).alias("kind"), F.posexplode(F.split("text", pattern)).alias("pos", "unit"))
    return cut(LINES, 0).unionByName(cut(PARAGRAPHS, 1).where(F.col("unit").rlike(LINES)))


def scan(files: DataFrame, id: str = "doc_id", path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """Licences of files(id, path, text): id, path, license, similarity, via; a row for each row.

    A file's own licence is the best match of its lines, of its paragraphs of several lines, and, where its name is that
    of a licence file, of its whole text; via is `file` for licence files and `header` for others. Of equal matches
    the first line, then the first paragraph, then the whole, and the first template win. Everything is compared that
    telling() and near() don't rule out. Otherwise the nearest directory above with a licence file that has one gives it
    (`inherited`, similarity of that file), of several there the best match, then the smallest identifier. Without any,
    license and via are null and similarity is 0. A null or empty text has no licence of its own, a null path inherits
    nothing, and rows with equal ids share what any of them matches. Rows without an id inherit, but their texts aren't
    read. Texts of any length are compared whole. Further columns are left alone; an empty table gives no rows.
    """
    base = files.select(F.col(id).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME), F.lit(False))
    # u tells files with equal ids apart
    some = telling(templates, threshold)
    known = base.where("id is not null")
    known = (known if some is None else known.where(F.exists(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda w: w.isin(some)))).withColumn("u", F.xxhash64("id", "path", "text")).withColumn("file", named)
    wholes = known.where("file").select("id", "u", "file", F.lit(2).alias("kind"), F.lit(0).alias("pos"), F.col("text").alias("unit"))
    some = scratch(units(known).unionByName(wholes).where(near(F.col("unit"), templates, threshold)))
    keys = ["id", "u", "file", "kind", "pos"]
    first = F.max(F.struct("similarity", (-F.col("kind")).alias("k"), (-F.col("pos")).alias("p"), "license")).alias("b")
    found = scratch(matched(some, keys, templates, threshold).groupBy("id", "u", "file").agg(first).select("id", "u", "file", F.col("b.license").alias("license"), F.col("b.similarity").alias("similarity")))
    via = F.when(F.col("file"), "file").otherwise("header").alias("via")
    own = scratch(found.select("id", "license", "similarity", via).groupBy("id").agg(F.max(F.struct("similarity", "via", "license")).alias("b")).select("id", "b.*"))

    # the licence of each directory that has a licence file, and the nearest of those above each directory
    files_of = known.where("file").select("u", "path").distinct().join(found.where("file"), "u")
    given = files_of.select(directory(F.col("path")).alias("above"), "license", "similarity").groupBy("above", "similarity").agg(F.min("license").alias("license"))
    given = scratch(given.groupBy("above").agg(F.max(F.struct("similarity", "license")).alias("g")).select("above", F.col("g.license").alias("l"), F.col("g.similarity").alias("s")))
    dirs = base.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, 1, k))))).alias("above")).distinct()
    if given.count() <= FEW:
        met = above.join(F.broadcast(given), "above")
    else:  # a directory near the root is above most others
        copies = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = above.withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int")).join(copies, ["above", "salt"])
    nearest = met.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "l", "s")).alias("g")).select("dir", "g.l", "g.s")
    out = base.select("id", "path", directory(F.col("path")).alias("dir")).join(own, "id", "left").join(nearest, "dir", "left")
    return out.select(F.col("id").alias(id), F.col("path").alias(path), F.coalesce("license", "l").alias("license"), F.coalesce("similarity", "s", F.lit(0.0)).alias("similarity"), F.coalesce("via", F.when(F.col("l").isNotNull(), F.lit("inherited"))).alias("via"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents. The table has no paths, so they are laid out as files of their source: fifty twenties
    of ids are a directory, of which every tenth of twenties are its licence files, and ten twenties a directory in it,
    where a tenth, too, are licence files."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    k = "doc_id div 20"
    outer = F.concat_ws("/", "source", F.expr(f"cast({k} div 50 as string)"))
    inner = F.concat_ws("/", outer, F.expr(f"cast({k} % 50 div 10 as string)"))
    name = F.col("doc_id").cast("string")
    path = F.when(F.expr(f"{k} % 10 = 0"), F.concat(outer, F.lit("/LICENSE."), name)).when(F.expr(f"{k} % 10 = 5"), F.concat(inner, F.lit("/COPYING."), name)).otherwise(F.concat(inner, F.lit("/"), name))
    return scan(docs.withColumn("path", F.when(F.col("doc_id").isNotNull() & F.col("source").isNotNull(), path)))


def oracle() -> str:
    """op6 in SQL."""
    idf, unknown, rows = weights(TEMPLATES)
    known = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in sorted(idf.items()))
    frame = ", ".join(f"({k}, '{name}', '{w}', {x!r}::DOUBLE)" for k, name, w, x in rows)
    little = ", ".join(f"'{w}'" for w in LITTLE)
    k = "doc_id // 20"
    inner = f"source || '/' || ({k} // 50) || '/' || ({k} % 50 // 10)"
    return f"""WITH idf(term, idf) AS (VALUES {known}), tpl(template, license, term, w) AS (VALUES {frame}),
d AS (SELECT *, path IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{FILE_NAME}') AS file, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir FROM (
  SELECT doc_id, text, CASE WHEN {k} % 10 = 0 THEN source || '/' || ({k} // 50) || '/LICENSE.' || doc_id WHEN {k} % 10 = 5 THEN {inner} || '/COPYING.' || doc_id ELSE {inner} || '/' || doc_id END AS path FROM documents)),
cut AS (SELECT doc_id, 0 AS kind, string_split_regex(text, '{LINES}') AS l FROM d UNION ALL SELECT doc_id, 1, string_split_regex(text, '{PARAGRAPHS}') FROM d UNION ALL SELECT doc_id, 2, [text] FROM d WHERE file),
un AS (SELECT doc_id, kind, unnest(l) AS unit, generate_subscripts(l, 1) AS pos FROM cut WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, kind, pos, term, count(*) AS tf FROM (SELECT doc_id, kind, pos, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM un WHERE kind <> 1 OR regexp_matches(unit, '{LINES}')) WHERE term NOT IN ({little}) GROUP BY ALL),
v AS (SELECT doc_id, kind, pos, term, (1 + ln(tf)) * coalesce(idf, {unknown!r}::DOUBLE) AS x FROM tf LEFT JOIN idf USING (term)),
nrm AS (SELECT doc_id, kind, pos, sqrt(sum(x * x)) AS n FROM v GROUP BY ALL),
dot AS (SELECT doc_id, kind, pos, template, license, sum(x * w) AS dot FROM v JOIN tpl USING (term) GROUP BY ALL),
sim AS (SELECT doc_id, kind, pos, template, license, round(dot / n, 6) AS similarity FROM dot JOIN nrm USING (doc_id, kind, pos)),
best AS (SELECT doc_id, license, similarity FROM sim WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, kind, pos, template) = 1),
giv AS (SELECT dir AS above, license, similarity FROM d JOIN best USING (doc_id) WHERE file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1),
inh AS (SELECT doc_id, license, similarity FROM d JOIN giv ON above = '' OR dir = above OR starts_with(dir, above || '/') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(best.license, inh.license) AS license, coalesce(best.similarity, inh.similarity, 0.0) AS similarity, CASE WHEN best.license IS NOT NULL THEN CASE WHEN file THEN 'file' ELSE 'header' END WHEN inh.license IS NOT NULL THEN 'inherited' END AS via
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN inh USING (doc_id)"""
