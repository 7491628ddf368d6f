"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

DataFrame functions only. Units are the lines of a text (headers), the whole
text (licence files) and, for headers wrapped over lines, from each line on as
many lines as it takes to reach a template's number of terms. A unit's vector is term counts times idf; idf is
taken from the document frequencies of all terms over all documents. Templates
are notices, by which files state a licence, and whole licence texts. A unit
with a cosine of at least ``TEXT_THRESHOLD`` to a licence text has that licence;
else the best template with a cosine of at least ``threshold`` is a document's
own licence (ties: first name). A notice holds for a unit only if the unit has the
numbers and the telling words (``TELLING``) of the notice and none that tells its
neighbours apart (``GROUPS``): a licence of another version or family than those
that are listed has no licence here rather than that of its permissive cousin.

Terms that no template can do without are worked out from the idf values: by
the Cauchy-Schwarz inequality a unit that shares only other terms with a
template stays below the threshold, so only units with such a term are scored.

A document without one inherits from the nearest ancestor directory in which a
file named LICENSE, LICENCE, COPYING or NOTICE has its own: each directory is
exploded into its ancestors, joined by path, and the longest match is kept.

Edge cases: a null or empty text has no licence of its own, and one without a
path inherits none; repeated rows are judged alike; further columns are not
read; ties go to the first name; an empty table gives an empty table; of several licence files in a directory the best match counts.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import Scratch

THRESHOLD, TEXT_THRESHOLD = 0.6, 0.8
TERM = "[a-z0-9]+"
# Notices by which files state widespread licences. A name's second notice ends in a space.
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation{} either version {} of the License"
TEMPLATES = {
    "AGPL-3.0": "This program is free software: " + _GNU.format("Affero General Public", ",", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 ": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Artistic-2.0": "This program is distributed under the terms of the Artistic License 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0 ": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0 ": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-ND-4.0 ": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-SA-4.0 ": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-ND-4.0 ": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-SA-4.0 ": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GFDL-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0 ": "This program is free software; " + _GNU.format("General Public", ";", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 ": "This program is free software: " + _GNU.format("General Public", ",", "3"),
    "LGPL-2.0": "This library is free software; " + _GNU.format("Library General Public", ";", "2"),
    "LGPL-2.0 ": "GNU Library General Public License, version 2",
    "LGPL-2.1": "This library is free software; " + _GNU.format("Lesser General Public", ";", "2.1"),
    "LGPL-3.0": "This program is free software: " + _GNU.format("Lesser General Public", ",", "3"),
    "LGPL-3.0 ": "GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT ": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "X11": "Released under the X11 License",
}
# Words that tell licences apart. A unit must have those of a notice, and its numbers; those of a
# group that a notice has one's name of rule the notice out where it doesn't have them itself.
TELLING = ("affero", "apache", "artistic", "boost", "documentation", "eclipse", "lesser", "mit", "mozilla", "nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike", "x11")
GROUPS = {"gnu": ("affero", "lesser"), "attribution": ("noncommercial", "noderivatives", "noderivs", "sharealike"), "cc": ("nc", "nd", "sa")}
# Whole texts of short licences, without title and holder.
_BSD = (
    TEMPLATES["BSD-3-Clause"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEXTS = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _NO_NAMES + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
    "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
    "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _templates(notices: dict[str, str], texts: dict[str, str]) -> list[tuple[str, str, bool]]:
    """(name, text, whether it is a licence text): notices first, each kind by name."""
    both = [(name.strip(), text, False) for name, text in sorted(notices.items())] + [(name, text, True) for name, text in sorted(texts.items())]
    return [x for x in both if terms_of(x[1])]


def _tells(templates: list[tuple[str, str, bool]]) -> list[dict[str, int]]:
    """For each template the terms by which it is told from its neighbours: how often a unit must have the term at least, -1 where it must not."""
    out = []
    for _, text, whole in templates:
        terms = [] if whole else terms_of(text)
        has = set(terms)
        must = {t for t in has if t.isdigit() or t in TELLING}
        out.append(dict.fromkeys(sorted({t for name, group in GROUPS.items() if name in has for t in group} - has), -1) | {t: terms.count(t) for t in sorted(must)})
    return out


def _constant(value: object, kind: str) -> Column:
    """A constant of a nested type, as one small expression."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _needed(vectors: list[dict[str, float]], df: dict[str, int], threshold: float) -> list[str]:
    """The templates' terms without the commonest ones that, all shared, still leave every cosine below the threshold."""
    common: set[str] = set()
    for term in sorted(df, key=lambda t: (-df[t], t)):
        tried = common | {term}
        if any(sum(w * w for t, w in v.items() if t in tried) >= 0.999 * threshold**2 * sum(w * w for w in v.values()) for v in vectors):
            break
        common = tried
    return sorted(set(df) - common)


def own_licenses(docs: DataFrame, notices: dict[str, str] = TEMPLATES, texts: dict[str, str] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own, similarity) of each row of ``docs`` (doc_id, path, text); own is null where nothing matches."""
    templates = _templates(notices, texts)
    counts = [{t: bag.count(t) for t in bag} for bag in (terms_of(text) for _, text, _ in templates)]
    vocabulary = sorted({t for c in counts for t in c})
    terms = lambda text: F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    n = docs.count()
    stand = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    stand = Scratch(docs.sparkSession, "license-terms").put(stand, "stand")
    # one row a term of the templates: their number is bounded by the parameter
    df = {t: 0 for t in vocabulary} | {r["t"]: r["df"] for r in stand.filter(F.col("t").isin(vocabulary)).collect()}
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    vectors = [{t: k * idf[t] for t, k in c.items()} for c in counts]
    needed = F.array(*map(F.lit, _needed(vectors, df, threshold)))

    # a row is known by its id, its path and its text's hash: rows alike in all three are judged as one
    keys = ["doc_id", "path", "digest"]
    keyed = docs.select("doc_id", "path", F.xxhash64("text").alias("digest"), "text")
    hits = keyed.filter(F.arrays_overlap(terms(F.col("text")), needed)).dropDuplicates(keys)
    lengths = sorted({sum(c.values()) for c, (_, _, whole) in zip(counts, templates, strict=True) if not whole}) or [1]
    lines = hits.select(*keys, "text", F.filter(F.transform(F.split("text", "\n"), terms), lambda x: F.size(x) > 0).alias("lines"))
    # from each line on: no more lines than the longest notice has terms; the whole text last
    ahead = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.slice("lines", i, lengths[-1]))
    starts = lines.select(*keys, F.posexplode(F.array_append(ahead, F.array(F.flatten("lines")))).alias("start", "ahead")).filter(F.arrays_overlap(F.flatten("ahead"), needed))
    reach = F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda k: F.size(F.flatten(F.slice("ahead", 1, k))))
    starts = starts.select(*keys, "start", "ahead", reach.alias("reach"))
    below = lambda n: F.size(F.filter("reach", lambda x: x < n))
    ends = [F.least(F.size("ahead"), below(n) + 1) for n in lengths]
    runs = F.transform(F.array_distinct(F.array(F.lit(1), *ends)), lambda k: F.flatten(F.slice("ahead", 1, k)))
    units = starts.select(*keys, "start", F.posexplode(runs).alias("run", "terms")).filter(F.arrays_overlap("terms", needed))
    units = units.select(*keys, F.struct("start", "run").alias("unit"), "terms")
    counted = units.select(*keys, "unit", F.explode("terms").alias("t")).groupBy(*keys, "unit", "t").agg(F.count("*").alias("tf"))
    weighed = counted.join(stand, "t").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    # a term's weight in each template that has it; -1 stands for the unit itself
    # and what the term tells of the template: how often it needs it, or -1 if it can't have it
    tells = _tells(templates)
    held = {t: [{"i": i, "v": v.get(t, 0.0), "m": m.get(t, 0)} for i, (v, m) in enumerate(zip(vectors, tells, strict=True)) if t in v or t in m] for t in sorted({*vocabulary, *(t for m in tells for t in m)})}
    held = _constant(held, "map<string,array<struct<i:int,v:double,m:int>>>")
    pairs = F.array_prepend(F.coalesce(F.element_at(held, F.col("t")), F.array()), F.struct(F.lit(-1).alias("i"), F.col("w").alias("v"), F.lit(0).alias("m")))
    told = F.when(F.col("m") < 0, -1000).when((F.col("m") > 0) & (F.col("tf") >= F.col("m")), 1).otherwise(0)
    dots = weighed.select(*keys, "unit", "w", "tf", F.inline(pairs)).groupBy(*keys, "unit", "i").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.sum(told).alias("told"))
    vector = dots.groupBy(*keys, "unit").agg(F.sqrt(F.max(F.when(F.col("i") < 0, F.col("dot")))).alias("norm"), F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "dot", "told"))).alias("dots"))
    # a licence text goes before notices; of equal cosines the first name wins
    known = [{"size": math.sqrt(sum(w * w for w in v.values())), "name": name, "text": whole, "needs": sum(x > 0 for x in tell.values())} for v, (name, _, whole), tell in zip(vectors, templates, tells, strict=True)]
    known = _constant(known, "array<struct<size:double,name:string,text:boolean,needs:int>>")

    def judged(d: Column) -> Column:
        of = known[d["i"]]
        cosine = F.when(d["told"] == of["needs"], F.round(d["dot"] / of["size"] / F.col("norm"), 6)).otherwise(-1.0)  # a neighbour's notice is none
        return F.struct((of["text"] & (cosine >= TEXT_THRESHOLD)).alias("whole"), cosine.alias("similarity"), (-d["i"]).alias("order"), of["name"].alias("own"))

    best = vector.groupBy(*keys).agg(F.max(F.array_max(F.transform("dots", judged))).alias("best")).filter(F.col("best.similarity") >= threshold)
    found = best.select(*(F.col(k).alias(f"own_{k}") for k in keys), "best.own", "best.similarity")
    alike = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]
    return keyed.drop("text").join(found, alike, "left").select("doc_id", "path", "own", "similarity")


def _parents(directory: Column) -> Column:
    """The directory and its ancestors; the root is the empty path."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit(""))))


def scan(docs: DataFrame, notices: dict[str, str] = TEMPLATES, texts: dict[str, str] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, origin, similarity) of each row of ``docs`` (doc_id, path, text).

    origin: ``own``, ``inherited`` or ``none``; similarity is that of the own match, else 0.
    """
    own = own_licenses(docs.select("doc_id", "path", "text"), notices, texts, threshold)
    # texts are scanned once: what is left is a short row each
    own = Scratch(docs.sparkSession, "licenses").put(own.withColumn("directory", F.regexp_replace("path", "/?[^/]*$", "")), "own")
    is_file = F.regexp_extract("path", "[^/]*$", 0).rlike("(?i)^(licen[cs]e|copying|notice)")
    given = own.filter(is_file & F.col("own").isNotNull()).groupBy(F.col("directory").alias("above")).agg(F.max_by("own", F.struct("similarity", "own")).alias("given"))
    asking = own.filter("own IS NULL AND directory IS NOT NULL").select("directory").distinct()
    climbed = asking.select("directory", F.explode(_parents(F.col("directory"))).alias("above"))
    nearest = climbed.join(given, "above").groupBy("directory").agg(F.max_by("given", F.length("above")).alias("given"))
    out = own.join(nearest, "directory", "left")
    inherited = F.col("own").isNull() & F.col("given").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own", "given").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def scan_sql(table: str, notices: dict[str, str] = TEMPLATES, texts: dict[str, str] = TEXTS, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB SQL, relationally, without the shortcuts. ``table``: a query for doc_id, path, text."""
    tells = ", ".join(f"({i}, '{t}', {x})" for i, tell in enumerate(_tells(_templates(notices, texts))) for t, x in tell.items()) or "(-1, '', 1)"
    rows = ", ".join("('{}', {}, {}, '{}')".format(name, i, whole, text.replace("'", "''")) for i, (name, text, whole) in enumerate(_templates(notices, texts)))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, path, coalesce(text, '') AS text FROM ({table})),
templates(name, i, whole, text) AS (VALUES {rows}),
tells(i, t, x) AS (VALUES {tells}),
needs AS (SELECT i, count(*) FILTER (WHERE x > 0) AS needs FROM tells GROUP BY i),
tpl AS (SELECT name, i, whole, t, count(*) AS tf FROM (SELECT name, i, whole, unnest(regexp_extract_all(lower(text), '{TERM}')) AS t FROM templates) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs),
lines AS (SELECT r, terms, row_number() OVER (PARTITION BY r ORDER BY k) AS ln, sum(len(terms)) OVER (PARTITION BY r ORDER BY k) AS upto
          FROM (SELECT r, k, regexp_extract_all(lower(line), '{TERM}') AS terms FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs)) WHERE len(terms) > 0),
words AS (SELECT r, ln, t, count(*) AS tf FROM (SELECT r, ln, unnest(terms) AS t FROM lines) GROUP BY ALL),
idf AS (SELECT t, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT t FROM tpl UNION SELECT t FROM words) LEFT JOIN (SELECT t, count(DISTINCT r) AS df FROM words GROUP BY t) USING (t), n),
tw AS (SELECT name, i, whole, t, tf * idf AS w FROM tpl JOIN idf USING (t)),
tlen AS (SELECT i, sqrt(sum(w * w)) AS len FROM tw GROUP BY i),
sizes AS (SELECT DISTINCT k FROM (SELECT sum(tf)::BIGINT AS k FROM tpl WHERE NOT whole GROUP BY i) UNION SELECT 1),
last AS (SELECT r, max(ln) AS last FROM lines GROUP BY r),
ends AS (SELECT a.r, a.ln AS head, k, min(b.ln) AS tail FROM lines a, sizes JOIN lines b ON b.r = a.r AND b.ln BETWEEN a.ln AND a.ln + k AND b.upto - a.upto + len(a.terms) >= k GROUP BY ALL),
units AS (SELECT a.r, a.ln AS head, coalesce(e.tail, l.last) AS tail FROM lines a CROSS JOIN sizes s JOIN last l ON l.r = a.r LEFT JOIN ends e ON e.r = a.r AND e.head = a.ln AND e.k = s.k
          UNION SELECT r, 1, last FROM last),
uw AS (SELECT u.r, head, tail, w.t, sum(tf) AS tf, sum(tf) * any_value(idf) AS w FROM units u JOIN words w ON w.r = u.r AND w.ln BETWEEN head AND tail JOIN idf ON idf.t = w.t GROUP BY u.r, head, tail, w.t),
ulen AS (SELECT r, head, tail, sqrt(sum(w * w)) AS len FROM uw GROUP BY ALL),
dots AS (SELECT uw.r, head, tail, tw.name, tw.i, tw.whole, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (t) GROUP BY ALL),
told AS (SELECT r, head, tail, i, count(*) FILTER (WHERE x > 0 AND tf >= x) AS has, count(*) FILTER (WHERE x < 0) AS unlike FROM uw JOIN tells USING (t) GROUP BY ALL),
cosine AS (SELECT r, name, i, whole, round(dot / tlen.len / ulen.len, 6) AS similarity FROM dots JOIN tlen USING (i) JOIN ulen USING (r, head, tail) LEFT JOIN needs USING (i) LEFT JOIN told USING (r, head, tail, i)
           WHERE coalesce(has, 0) = coalesce(needs, 0) AND coalesce(unlike, 0) = 0),
best AS (SELECT r, name AS own, similarity FROM cosine
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY whole AND similarity >= {TEXT_THRESHOLD} DESC, similarity DESC, i) = 1),
own AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') AS directory, CASE WHEN similarity >= {threshold} THEN own END AS own, CASE WHEN similarity >= {threshold} THEN similarity END AS similarity
        FROM docs d LEFT JOIN best USING (r)),
given AS (SELECT directory AS above, arg_max(own, (similarity, own)) AS given FROM own
          WHERE own IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|notice)') GROUP BY directory),
nearest AS (SELECT d.directory, arg_max(g.given, length(g.above)) AS given FROM (SELECT DISTINCT directory FROM own) d
            JOIN given g ON g.above = '' OR d.directory = g.above OR starts_with(d.directory, g.above || '/') GROUP BY d.directory)
SELECT doc_id, path, coalesce(own, given) AS license, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, coalesce(similarity, 0.0::DOUBLE) AS similarity
FROM own LEFT JOIN nearest USING (directory)"""
