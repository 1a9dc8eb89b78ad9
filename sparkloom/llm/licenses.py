"""Licence scans with built-in functions alone.

Lines that speak of licences are compared, alone and with the lines after them,
and so is the whole text, to templates of licence headers and files by the
cosine of sparse TF-IDF vectors.  A term's weight is its count times ln((N + 1) / (df + 1)) + 1 with df
counted over all N texts; words outside the templates' vocabulary weigh 1 each
in a unit's norm.  A file whose name or whose matched unit makes it a licence
file covers its directory and what lies below; a file without a licence of its
own inherits from the nearest such ancestor, found by joining directories.

Templates are a parameter: notices and headers, short licences whole, and of the
long ones the opening, by which a file of any length is told; ``read_templates``
takes whole texts from a table.  The only numbers that reach the driver are the
document counts of the templates' terms; scoring is local to a row, done once in
a written table, and inheritance joins one row a directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import free_name, staged

THRESHOLD = 0.5
UNIT_LINES = 14
MOST_TEMPLATES = 500
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
TRIGGER = "licen[sc]|copyright|spdx|permission (is|to)|permitted|redistribut|rights reserved|public domain|creative commons"
LICENCE_NAME = "^(licen[sc]e|copying|unlicense|notice)([-_.][a-z0-9._-]*)?$"

_BSD_CONDITIONS = (
    "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_FSF_COPIES = "Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "

TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Proprietary and confidential."),
    # Whole short licences, and openings of the long ones.
    (
        "MIT",
        'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE '
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    (
        "BSD-3-Clause",
        _BSD_CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    ),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 " + _FSF_COPIES + "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 " + _FSF_COPIES + "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 " + _FSF_COPIES + "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 " + _FSF_COPIES + "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 " + _FSF_COPIES + "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others'),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3 or any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
]


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vocabulary_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in templates for t in terms_of(text)})


def read_templates(texts: DataFrame) -> list[tuple[str, str]]:
    """Templates from rows (licence, text), added to the built-in ones.  They are
    a list of licences, not a corpus: more than ``MOST_TEMPLATES`` are an error."""
    rows = texts.where("licence is not null and text is not null").select("licence", "text").distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return [*TEMPLATES, *sorted((r["licence"], r["text"]) for r in rows if terms_of(r["text"]))]


def _doubles(values: list[float]) -> Column:
    """A constant array that costs the planner one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _words(vocabulary: list[str]) -> Column:
    return F.split(F.lit(" ".join(vocabulary)), " ")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def document_counts(files: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Texts, and for each term of the templates how many hold it; over all rows."""
    used = files.select(F.array_intersect(_words(vocabulary), terms(F.coalesce(F.col(text_col), F.lit("")))).alias("terms"))
    counted = used.select(F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    by = {r["term"]: r["n"] for r in counted.collect()}  # at most the vocabulary and one more
    return by.pop("", 0), by


def idf_of(n: int, counts: dict[str, int], vocabulary: list[str]) -> dict[str, float]:
    return {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}


def template_vectors(templates: list[tuple[str, str]], idf: dict[str, float]) -> list[list[float]]:
    """Unit vectors of the templates over the vocabulary, in the order of ``idf``."""
    out = []
    for _, text in templates:
        tf = Counter(terms_of(text))
        v = [tf[t] * w for t, w in idf.items()]
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v])
    return out


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _best(unit: Column, vocabulary: Column, idf: Column, vectors: Column) -> Column:
    """(score, template, length) of a unit's best template; ties: the first."""

    def scored(tok: Column) -> Column:
        present = F.array_intersect(vocabulary, tok)
        weights = F.transform(
            present,
            lambda t: F.struct(
                (F.array_position(vocabulary, t).cast("int") - 1).alias("i"),
                (F.size(tok) - F.size(F.array_remove(tok, t))).alias("tf"),
            ),
        )

        def against(w: Column) -> Column:
            known = F.aggregate(w, F.lit(0), lambda a, x: a + x["tf"])
            square = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.pow(x["tf"] * idf[x["i"]], F.lit(2.0)))
            norm = F.sqrt(square + (F.size(tok) - known))
            dots = F.transform(vectors, lambda v: F.aggregate(w, F.lit(0.0), lambda a, x: a + x["tf"] * idf[x["i"]] * v[x["i"]]))
            rounded = F.transform(dots, lambda d: F.when(norm > 0, F.round(d / norm, 6)).otherwise(F.lit(0.0)))
            return _let(rounded, lambda s: F.struct(F.array_max(s).alias("score"), F.array_position(s, F.array_max(s)).cast("int").alias("template")))

        return _let(weights, against)

    return _let(terms(unit), scored)


def units(text: Column) -> Column:
    """Units of a text: each line that speaks of licences, alone, and with the
    lines that follow it (``UNIT_LINES`` in all), and the whole text if any does."""

    def of(lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.lower(lines[i - 1]).rlike(TRIGGER))
        alone = F.transform(at, lambda i: lines[i - 1])
        block = F.transform(at, lambda i: F.array_join(F.slice(lines, i, UNIT_LINES), " "))
        return F.array_distinct(F.concat(alone, block, F.array(text)))

    empty = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike(TRIGGER), _let(F.split(text, "\n"), of)).otherwise(empty)


_RESULT = ("licence", "method", "score", "licence_path")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``files`` with columns licence, method, score and licence_path.

    method is ``file`` (a licence file), ``header`` (a licence of its own),
    ``inherited`` or ``none``; score is the cosine, null if inherited or none;
    licence_path is the licence file that decided, null otherwise.  Of several
    units the best counts, then the first template; of several licence files in
    a directory the best, then the least path.  Null or empty texts have no
    licence of their own; a null path inherits nothing.  Every row is kept,
    repeated ones too, and so are the columns ``keep`` (all, unless given) but
    those of the four names, which are replaced; an empty table stays empty.
    """
    templates = templates or TEMPLATES
    vocabulary = vocabulary_of(templates)
    idf = idf_of(*document_counts(files, vocabulary, text_col), vocabulary)
    vectors = F.array(*[_doubles(v) for v in template_vectors(templates, idf)])
    names = F.split(F.lit("\n".join(name for name, _ in templates)), "\n")
    of_idf, words = _doubles(list(idf.values())), _words(vocabulary)
    kept = [c for c in (files.columns if keep is None else keep) if c.lower() not in _RESULT]
    found = F.transform(
        units(F.col(text_col)),
        lambda u: _let(_best(u, words, of_idf, vectors), lambda b: F.struct(b["score"].alias("score"), (-b["template"]).alias("order"), F.length(u).alias("length"))),
    )
    base = F.element_at(F.split(F.lower(F.col(path_col)), "/"), -1)
    is_file = F.coalesce(base.rlike(LICENCE_NAME), F.lit(False))
    # Own columns have names that no column of the table has.
    best, size, own, at = (free_name(files, c) for c in ("_best", "_size", "_own", "_dir"))
    scored = files.select(*kept, F.array_max(found).alias(best), F.length(text_col).alias(size), F.col(path_col).alias(at), is_file.alias(own))
    b = F.when(F.col(best)["score"] >= threshold, F.col(best))
    mine = F.struct(
        F.col(at).alias("path"),
        b["score"].alias("score"),
        F.when(b.isNotNull(), names[-b["order"] - 1]).alias("licence"),
        (b.isNotNull() & (F.col(own) | (b["length"] * 2 >= F.col(size)))).alias("file"),
    )
    rows = staged(scored.select(*kept, mine.alias(own), F.regexp_replace(F.col(at), "/?[^/]*$", "").alias(at)), "licences")
    o = F.col(own)
    # One licence a directory: best score, then least path.
    holder = F.min(F.when(o["file"], F.struct((-o["score"]).alias("s"), o["path"].alias("p"), o["licence"].alias("l"))))
    dirs = staged(rows.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("dir")).agg(holder.alias("b")), "directories")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))
    climbed = dirs.select("dir", F.inline(above))
    holders = dirs.where("b is not null").select(F.col("dir").alias("up"), F.struct(F.col("b.p").alias("path"), F.col("b.l").alias("licence")).alias("from"))
    nearest = climbed.join(holders, "up").groupBy("dir").agg(F.max_by("from", "depth").alias("from"))
    near = free_name(rows, "_near")
    # A written table of one row a directory: Spark may split a hot directory's rows.
    joined = rows.join(staged(nearest, "nearest").select(F.col("dir").alias(at), F.col("from").alias(near)), at, "left")
    has, inherited = o["licence"].isNotNull(), F.col(near)
    return joined.select(
        *kept,
        F.when(has, o["licence"]).otherwise(inherited["licence"]).alias("licence"),
        F.when(has & o["file"], "file").when(has, "header").when(inherited.isNotNull(), "inherited").otherwise("none").alias("method"),
        o["score"].alias("score"),
        F.when(~has, inherited["path"]).when(o["file"], o["path"]).alias("licence_path"),
    )


#: Documents as files: a folder a source, shelves of 100 ids, one file a document.
#: ``||`` is null for a null id in Spark and DuckDB alike; ``concat`` is not.
DOCUMENT_PATH = "coalesce(source, 'unknown') || '/' || cast(cast(floor(doc_id / 100) as bigint) as string) || '/' || cast(doc_id as string) || '.txt'"


def scan_table(docs: DataFrame) -> DataFrame:
    """doc_id, path, licence, method, score, licence_path of every document."""
    files = docs.select("doc_id", "text", F.expr(DOCUMENT_PATH).alias("path"))
    return scan(files, keep=["doc_id", "path"]).select("doc_id", "path", "licence", "method", "score", "licence_path")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(threshold: float = THRESHOLD) -> str:
    """The query of ``scan_table`` as DuckDB SQL."""
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES, 1))
    return f"""
WITH templates(k, name, body) AS (VALUES {rows}),
tterms AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(body), '{TERM}')) AS t FROM templates) GROUP BY k, t),
vocabulary AS (SELECT DISTINCT t FROM tterms),
files AS (SELECT row_number() OVER () AS r, doc_id, text, {DOCUMENT_PATH} AS path FROM documents),
df AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TERM}')) AS t FROM files) WHERE t IN (SELECT t FROM vocabulary) GROUP BY t),
idf AS (SELECT t, ln(((SELECT count(*) FROM files) + 1.0::double) / (coalesce(df, 0) + 1)) + 1 AS idf FROM vocabulary LEFT JOIN df USING (t)),
tnorm AS (SELECT k, sqrt(sum((tf * idf) ** 2)) AS norm FROM tterms JOIN idf USING (t) GROUP BY k),
tvec AS (SELECT k, t, tf * idf / norm AS w FROM tterms JOIN idf USING (t) JOIN tnorm USING (k)),
lines AS (SELECT r, string_split(text, chr(10)) AS ls FROM files WHERE regexp_matches(lower(text), '{TRIGGER}')),
trig AS (SELECT r, ls, i FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines) WHERE regexp_matches(lower(ls[i]), '{TRIGGER}')),
units AS (SELECT DISTINCT r, u FROM (SELECT r, ls[i] AS u FROM trig UNION ALL SELECT r, array_to_string(ls[i:i + {UNIT_LINES - 1}], ' ') FROM trig UNION ALL SELECT r, text FROM files WHERE regexp_matches(lower(text), '{TRIGGER}'))),
numbered AS (SELECT row_number() OVER () AS q, r, u FROM units),
uterms AS (SELECT q, t, count(*) AS tf FROM (SELECT q, unnest(regexp_extract_all(lower(u), '{TERM}')) AS t FROM numbered) GROUP BY q, t),
unorm AS (SELECT q, sqrt(sum(CASE WHEN idf IS NULL THEN tf ELSE (tf * idf) ** 2 END)) AS norm FROM uterms LEFT JOIN idf USING (t) GROUP BY q),
scores AS (SELECT r, q, k, round(sum(tf * idf * w) / any_value(norm), 6) AS score FROM uterms JOIN idf USING (t) JOIN tvec USING (t) JOIN unorm USING (q) JOIN numbered USING (q) GROUP BY r, q, k),
best AS (SELECT r, s.score AS score, s.k AS k, length(u) AS n FROM (SELECT r, q, score, k, row_number() OVER (PARTITION BY r ORDER BY score DESC, k, length(u) DESC) AS rn FROM scores JOIN numbered USING (r, q)) s JOIN numbered USING (r, q) WHERE rn = 1 AND score >= {threshold}),
own AS (SELECT r, doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, score, name, coalesce(n * 2 >= length(text) OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '{LICENCE_NAME}'), false) AND score IS NOT NULL AS is_file FROM files LEFT JOIN best USING (r) LEFT JOIN templates USING (k)),
holders AS (SELECT dir AS up, path AS from_path, name AS from_name FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, name) AS rn FROM own WHERE is_file) WHERE rn = 1),
dirs AS (SELECT DISTINCT dir FROM own),
climbed AS (SELECT dir, d, array_to_string(string_split(dir, '/')[1:d], '/') AS up FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS d FROM dirs)),
nearest AS (SELECT dir, arg_max(from_path, d) AS from_path, arg_max(from_name, d) AS from_name FROM climbed JOIN holders USING (up) GROUP BY dir)
SELECT doc_id, path, coalesce(name, from_name) AS licence,
  CASE WHEN name IS NOT NULL AND is_file THEN 'file' WHEN name IS NOT NULL THEN 'header' WHEN from_path IS NOT NULL THEN 'inherited' ELSE 'none' END AS method,
  score, CASE WHEN name IS NULL THEN from_path WHEN is_file THEN path END AS licence_path
FROM own LEFT JOIN nearest USING (dir)
"""
