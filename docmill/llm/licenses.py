"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

All of it is DataFrame work in the JVM. Each line of a file, each sentence of a line
that has several, and each paragraph of more than one line (a wrapped header, a clause
of a licence file) is a sparse vector over the templates' terms; inverse line
frequencies come from all lines of all files. Vectors and cosines are expressions of
one row, so that only the best template of a file, its own licence, is grouped. A
template's version numbers must all be there, so that one version isn't taken for
another. A file without a licence takes that of the licence file in its nearest
ancestor directory: distinct directories are joined with the paths above them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A line or paragraph is a licence statement from this cosine on,
MIN_COSINE = 0.8
#: if so large a share of its terms are terms of the templates.
MIN_SHARE = 0.5

# Fixed values: (SPDX name, wording) of the statements, file headers, titles and clauses by which texts say their licence.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "licensed under the Apache License version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Artistic-2.0", "licensed under the Artistic License version 2.0"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-2-Clause", "licensed under the BSD 2 clause simplified license"),
    ("BSD-2-Clause", "licensed under the BSD 2 clause license"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "licensed under the BSD 3 clause license"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "licensed under CC BY 4.0 creative commons attribution"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "licensed under CC BY NC 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY SA 4.0"),
    ("CC0-1.0", "released under CC0 1.0 universal public domain dedication"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "licensed under the GNU General Public License version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "this work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "released under the ISC license"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "released under the MIT license"),
    ("MIT", "licensed under the MIT license"),
    ("MIT", "MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Zlib", "released under the zlib license"),
    ("Zlib", "zlib License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]
# Wording that several licences have, taken for the one that has no more than that where nothing else is said.
SHARED = [
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]
#: Tag lines, by the names of the templates; of the GNU ones also with what may follow the version.
TAGS = [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in TEMPLATES}) for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]

# Words that say nothing of a licence.
STOP_WORDS = [
    "a", "above", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "do", "either", "for", "from", "if", "in", "into", "is", "it", "its", "later", "may", "nor",
    "not", "of", "on", "one", "or", "so", "that", "the", "this", "to", "under", "used", "was", "whom", "with", "without", "you",
]

#: File names that make a file the licence of its directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|copyright)([._-].*)?$"


#: Where a line is cut to sentences.
SENTENCE_END = "[.;!?]+[ \\t]+"
#: A version, of which neither a ``v`` before it nor zeros behind it count.
VERSION = "^v?([0-9]+([.][0-9]+)*?)([.]0)*$"


def terms(text: Column) -> Column:
    """Runs of letters, digits and inner dots of ``text`` in lower case, without stop words; versions bare."""
    words = F.split(F.lower(text), "[^a-z0-9.]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[.]+|[.]+$", ""))
    kept = F.filter(bare, lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.transform(kept, lambda w: F.when(w.rlike("[0-9]"), F.regexp_replace(w, VERSION, "$1")).otherwise(w))


def template_terms(templates: list[tuple[str, str]]) -> list[tuple[str, dict[str, int]]]:
    """Name and term counts of each template, by the rule of :func:`terms`."""
    out = []
    for name, text in templates:
        own = "".join(c if c.isascii() and c.isalnum() or c == "." else " " for c in text.lower()).split()
        kept = [re.sub(VERSION, r"\1", w) for w in (x.strip(".") for x in own) if w and w not in STOP_WORDS]
        out.append((name, {w: kept.count(w) for w in sorted(set(kept))}))
    return out


def versions(terms_: Iterable[str]) -> list[str]:
    """The terms that are numbers."""
    return [w for w in terms_ if re.fullmatch("[0-9]+([.][0-9]+)*", w)]


def all_templates() -> list[tuple[int, str, dict[str, int], list[str]]]:
    """``(rank, name, term counts, terms that must be there)`` of all templates: versions, and of tags all. A match of rank 0 counts before any of rank 1."""
    said, tags, shared = map(template_terms, (TEMPLATES, TAGS, SHARED))
    return [*((0, n, t, versions(t)) for n, t in said), *((0, n, t, list(t)) for n, t in tags), *((1, n, t, versions(t)) for n, t in shared)]


def candidates(files: DataFrame, vocabulary: list[str], share: float) -> DataFrame:
    """``(path, line_no, n_lines, n_terms, hits)`` of lines with a term of ``vocabulary``, and of sentences of lines (``n_lines`` 0) and paragraphs with a ``share`` of such terms.

    Paragraphs are runs of two lines or more between lines without terms (blank ones,
    bare comment signs). Each line is cut to terms once.
    """
    sentences = F.transform(F.split("text", "\n"), lambda x: F.transform(F.transform(F.split(x, SENTENCE_END), terms), lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda y: y.isin(vocabulary)).alias("hits"))))
    lines = F.transform("s", lambda x: F.struct(F.aggregate(x, F.lit(0), lambda a, y: a + y["n"]).alias("n"), F.flatten(F.transform(x, lambda y: y["hits"])).alias("hits")))
    found = files.select("path", sentences.alias("s")).where(F.exists("s", lambda x: F.exists(x, lambda y: F.size(y["hits"]) > 0))).select("path", "s", lines.alias("l"))
    unit = lambda i, n, x: F.struct(i.alias("line_no"), F.lit(n).alias("n_lines"), x["n"].alias("n_terms"), x["hits"].alias("hits"))
    single = F.filter(F.transform("l", lambda x, i: unit(i, 1, x)), lambda x: F.size(x["hits"]) > 0)
    enough = lambda u: (F.size(u["hits"]) > 0) & (F.size(u["hits"]) >= u["n_terms"] * share)
    parts = F.filter(F.flatten(F.transform("s", lambda x, i: F.when(F.size(x) > 1, F.transform(x, lambda y: unit(i, 0, y))).otherwise(F.array()))), enough)
    breaks = F.filter(F.sequence(F.lit(0), F.size("l")), lambda i: F.coalesce(F.get("l", i)["n"], F.lit(0)) == 0)
    found = found.select("path", "l", single.alias("single"), parts.alias("parts"), breaks.alias("breaks"))
    start = lambda k: F.when(k > 0, F.get("breaks", k - 1) + 1).otherwise(0)
    runs = F.filter(F.transform("breaks", lambda b, k: F.struct(start(k).alias("line_no"), (b - start(k)).alias("n_lines"))), lambda r: r["n_lines"] > 1)
    own = lambda r: F.slice("l", r["line_no"] + 1, r["n_lines"])
    whole = F.transform(runs, lambda r: F.struct(r["line_no"], r["n_lines"], F.aggregate(own(r), F.lit(0), lambda a, x: a + x["n"]).alias("n_terms"), F.flatten(F.transform(own(r), lambda x: x["hits"])).alias("hits")))
    units = F.concat("single", "parts", F.filter(whole, enough))
    return found.select("path", F.explode(units).alias("u")).select("path", "u.*")


def statements(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = MIN_COSINE, share: float = MIN_SHARE) -> DataFrame:
    """``(path, license, score, line_no)``: the best-matching line, sentence or paragraph of each file that has one at ``least`` or over.

    Wording that several licences share counts where there is no other. Ties go to the
    earlier line, then to the name that sorts first. ``line_no`` counts from 0; a
    paragraph has that of its first line, a sentence that of its line.
    """
    counts = all_templates() if templates is None else [(0, n, t, versions(t)) for n, t in template_terms(templates)]
    found = table(candidates(files, sorted({w for _, _, t, _ in counts for w in t}), share), "license-lines")
    total = files.select(F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: x != "")))).first()[0] or 0
    # as many rows as the templates have terms
    df = {r["w"]: r["n"] for r in found.where("n_lines = 1").select(F.explode(F.array_distinct("hits")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for _, _, t, _ in counts for w in t}
    weights = F.create_map(*[F.lit(x) for w in sorted(idf) for x in (w, idf[w])])
    norms = [math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items())) for _, _, t, _ in counts]
    vectors = F.array(*[
        F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("license"), F.array(*map(F.lit, need)).cast("array<string>").alias("need"), F.create_map(*[F.lit(x) for w, n in t.items() for x in (w, n * idf[w] / norm)]).alias("q"))
        for (rank, name, t, need), norm in zip(counts, norms)
    ])
    # what isn't a template's term weighs as the rarest: it counts against the line
    rare = math.log(1 + total) + 1
    near = found.where(F.size("hits") >= F.col("n_terms") * share)
    tf = lambda w: F.size(F.filter("hits", lambda x: x == w))
    p = F.transform(F.array_distinct("hits"), lambda w: F.struct(w.alias("w"), (tf(w) * weights[w]).alias("p")))
    weighed = near.select("path", "line_no", "hits", (F.col("n_terms") - F.size("hits")).alias("others"), p.alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["p"] * x["p"]) + F.col("others") * F.lit(rare * rare))
    # templates of which all is there that must be
    fit = F.filter(vectors, lambda t: F.size(F.array_except(t["need"], F.col("hits"))) == 0)
    each = weighed.select("path", "line_no", "p", norm.alias("norm"), F.explode(fit).alias("t"))
    dot = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["p"] * F.coalesce(F.try_element_at(F.col("t.q"), x["w"]), F.lit(0.0)))
    scored = each.select("path", "line_no", "t.rank", "t.license", F.round(dot / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = F.min_by(F.struct("license", "score", "line_no"), F.struct("rank", -F.col("score"), "line_no", "license"))
    return scored.groupBy("path").agg(best.alias("b")).select("path", "b.*")


def parent(path: Column) -> Column:
    """The directory of a path; empty for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(paths: DataFrame, own: DataFrame) -> DataFrame:
    """``(dir, license, inherited_from)``: for each directory of ``paths`` the licence file's in it or nearest above it."""
    name = F.element_at(F.split("path", "/"), -1)
    at = own.where(name.rlike(LICENSE_FILE)).select(parent(F.col("path")).alias("above"), "path", "license", "score")
    at = at.groupBy("above").agg(F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), "path")).alias("l"))
    dirs = paths.select(parent(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("above")).distinct()
    nearest = up.join(at, "above").groupBy("dir").agg(F.max_by("l", F.length("above")).alias("l"))
    return nearest.select("dir", "l.license", F.col("l.path").alias("inherited_from"))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None, least: float = MIN_COSINE) -> DataFrame:
    """Licences of files: ``(path, license, score, line_no, origin, inherited_from)``, a row for each row of ``files``.

    ``origin`` is ``file`` for a licence of the file's own text, ``directory`` for an
    inherited one, else null with no licence. Null and empty texts have none of
    their own; null paths are at the top; files that repeat a path share what is
    found at it; no rows give none. Long texts are worked on whole, ties go as
    :func:`statements` says. Other columns are not read, so that their names can't clash.
    """
    src = files.select(F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = table(statements(src, templates, least), "license-statements")
    up = inherited(src.select("path"), own).withColumnsRenamed({"license": "up_license"})
    one = src.select("path", parent(F.col("path")).alias("dir")).join(own, "path", "left").join(up, "dir", "left")
    has = F.col("license").isNotNull()
    return one.select(
        "path", F.coalesce("license", "up_license").alias("license"), "score", "line_no",
        F.when(has, "file").when(F.col("up_license").isNotNull(), "directory").alias("origin"),
        F.when(~has, F.col("inherited_from")).alias("inherited_from"),
    )
