"""Licence notices by sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

DataFrame functions only.  A text is cut into pieces, the sentences of its lines; every run of up to REACH
pieces is a possible notice, so that wrapped ones are found.  A run's product with a template is the sum of its pieces' products, and its norm is
no less than the root of the sum of their squared norms: this bounds its cosine, and only runs whose bound reaches the threshold are looked at exactly.
A text can only have a notice if it has one of a template's anchors: the terms
without which the rest of the template weighs too little (Cauchy's bound), so other texts are passed
over before any term is counted.  Stop words and years are no terms.  A text with a notice is a licence file if it has little else, or if the notice is a licence's title.
A licence file holds for its directory and all below it, up to a nearer one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Licence identifiers, the wording of their usual notices, and the titles of their texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved"),
]
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
]
SPDX = "Apache-2.0 MIT ISC GPL-3.0 GPL-2.0 LGPL-3.0 AGPL-3.0 BSD-3-Clause MPL-2.0 CC-BY-4.0 CC-BY-NC-4.0 Unlicense".split()
#: (licence, wording, whether it is a title).  The tag of an identifier counts twice, so that a licence's name is none.
ALL = [*((n, t, False) for n, t in TEMPLATES), *((n, f"SPDX SPDX-License-Identifier: {n}", False) for n in SPDX), *((n, t, True) for n, t in TITLES)]
#: Common English words, which are no terms.
STOP = "a all an and any are as at be by for from in is it may not of on or that the these this those to under was were with without you".split()
TERM = re.compile(r"[a-z0-9]+")
YEAR = "^(19|20)[0-9][0-9]$"
#: Pieces of a run at most.
REACH = 8
#: Keys that a directory is dealt over, below a declaring one and with its files.
SALTS, FILE_SALTS = 8, 32


def terms_of(text: str) -> list[str]:
    return [t for t in TERM.findall(text.lower()) if t not in STOP and not re.match(YEAR, t)]


def weights(templates: list[str]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies over the templates, that of any other term, and each template's unit vector."""
    counts = [Counter(terms_of(text)) for text in templates]
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1 for c in counts for t in c}
    vectors = []
    for c in counts:
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        vectors.append({t: k * idf[t] / norm for t, k in c.items()})
    return idf, math.log(1 + n) + 1, vectors


def anchors(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Terms of which each template's matches need one: what is left of any template has a norm below ``least``."""
    out = set()
    for v in vectors:
        total = 1.0
        for t in sorted(v, key=lambda t: (len(t) < 3, t.isdigit(), -len(t), t)):  # long words first: they are the rarest in texts
            if total < least * least:
                break
            out.add(t)
            total -= v[t] ** 2
    return sorted(out)


def any_of(words: list[str]) -> str:
    """Expression for one of the words as a whole word of lower-case text; by first letters, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return rf"(?<![a-z0-9])(?:{'|'.join(c + '(?:' + '|'.join(rest) + ')' for c, rest in by.items())})(?![a-z0-9])"


def _pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "([.!?])[ \\t]+", "$1\n"), "\n")


def scan(df: DataFrame, *, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str, bool]] = ALL, header: float = 0.75, file: float = 0.3) -> DataFrame:
    """One row per row of df: (path, license, method, score, declared_in).

    method: ``header`` if a run of pieces reaches cosine ``header`` to a template; ``file`` if that template is a title, or if the whole text
    reaches ``file`` to a template beside a notice, which then decides; else ``inherited`` from the nearest directory above that has a licence file,
    else ``none``.  Of several templates the greatest cosine wins, then the least name; of a
    directory's licence files too, then the least path.  A null or blank text has no licence of its
    own; a null path inherits nothing.  Repeated rows each get their row; other columns are ignored.
    A directory is looked up at the depths that declaring directories have, so that deep paths cost no more than others.
    """
    spark = df.sparkSession
    idf, other, vectors = weights([text for _, text, _ in templates])
    need = anchors(vectors, header)
    has_anchor = any_of(need)
    postings = spark.createDataFrame([(t, i, w, idf[t]) for i, v in enumerate(vectors) for t, w in v.items()], "term string, template int, weight double, idf double")
    names = spark.createDataFrame([(i, name, int(title)) for i, (name, _, title) in enumerate(templates)], "template int, license string, title int")
    # Rows are known by 96 bits of what they hold, so that they are found again however Spark deals them out; equal ones share a result.
    files = df.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")).withColumn("row", F.struct(F.xxhash64("path", "text").alias("a"), F.hash("text", "path").alias("b")))
    # Units of terms are the whole text (-1), and the pieces that can be in one run with an anchor.
    split = files.select("row", F.lower("text").alias("text")).where(F.col("text").rlike(has_anchor)).select("row", "text", _pieces(F.col("text")).alias("pieces"))
    told = split.select("row", "text", "pieces", F.transform("pieces", lambda x: x.rlike(has_anchor)).alias("told"))
    close = lambda i: F.array_contains(F.slice("told", F.greatest(i - (REACH - 2), F.lit(1)), REACH + F.least(i, F.lit(REACH - 1))), True)
    near = F.filter(F.transform("pieces", lambda x, i: F.struct(i.alias("piece"), F.when(close(i), x).alias("unit"))), lambda x: x["unit"].isNotNull())
    units = told.select("row", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("piece"), F.col("text").alias("unit"))), near)).alias("u")).select("row", "u.piece", "u.unit")
    terms = units.select("row", "piece", F.explode(F.split("unit", "[^a-z0-9]+")).alias("term")).where((F.col("term") != "") & ~F.col("term").isin(STOP) & ~F.col("term").rlike(YEAR))
    # Norms and products of pieces, runs and whole texts all start here: the texts are read for it once.
    every = cut(terms.groupBy("row", "piece", "term").agg(F.count(F.lit(1)).alias("n")))
    counted = every.where("piece >= 0")
    known = postings.select("term", "idf").distinct()
    weigh = lambda x: x.join(F.broadcast(known), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    square = F.sum(F.col("w") * F.col("w"))

    def products(x: DataFrame, *keys: str) -> DataFrame:
        return x.where("idf IS NOT NULL").join(F.broadcast(postings.drop("idf")), "term").groupBy(*keys, "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))

    weighed = weigh(counted)
    cum = F.sum("n2").over(Window.partitionBy("row").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    norms = weighed.groupBy("row", "piece").agg(square.alias("n2")).withColumn("cum", cum)
    ahead = F.collect_list(F.struct("piece", "dot", "cum")).over(Window.partitionBy("row", "template").orderBy("piece").rangeBetween(0, REACH - 1))
    # A run that begins or ends with a piece without product is no better than the run without it.
    starts = products(weighed, "row", "piece").join(norms, ["row", "piece"]).withColumn("ahead", ahead)
    runs = starts.select("row", "template", F.col("piece").alias("first"), "n2", "cum", F.posexplode("ahead").alias("k", "end"), "ahead")
    dot = F.aggregate(F.slice("ahead", F.lit(1), F.col("k") + 1), F.lit(0.0), lambda s, x: s + x["dot"])
    runs = runs.select("row", "template", "first", F.col("end.piece").alias("last"), dot.alias("dot"), (F.col("end.cum") - F.col("cum") + F.col("n2")).alias("least"))
    runs = cut(runs.where(F.col("dot") >= F.lit(header - 1e-4) * F.sqrt("least")))
    longer = runs.where("first < last").select("row", "first", "last").distinct()
    inner = longer.select("*", F.explode(F.sequence("first", "last")).alias("piece")).join(counted, ["row", "piece"])
    exact = weigh(inner.groupBy("row", "first", "last", "term").agg(F.sum("n").alias("n"))).groupBy("row", "first", "last").agg(F.sqrt(square).alias("norm"))
    one = runs.where("first = last").select("row", "template", "dot", F.sqrt("least").alias("norm"))
    notices = one.unionByName(runs.join(exact, ["row", "first", "last"]).select("row", "template", "dot", "norm"))
    score = F.round(F.col("dot") / F.col("norm"), 4)
    notices = notices.withColumn("score", score).where(F.col("score") >= header).join(F.broadcast(names), "template").select("row", "license", "score", F.col("title").alias("whole"))
    notices = cut(notices)
    texts = weigh(every.where("piece < 0").join(notices.select("row").distinct(), "row", "left_semi"))
    wholes = products(texts, "row").join(texts.groupBy("row").agg(F.sqrt(square).alias("norm")), "row").withColumn("score", score).where(F.col("score") >= file)
    wholes = wholes.join(F.broadcast(names), "template").select("row", "license", "score", F.lit(1).alias("whole"))
    best = notices.unionByName(wholes).groupBy("row").agg(F.min(F.struct((-F.col("whole")).alias("w"), (-F.col("score")).alias("s"), "license")).alias("o"))
    own = files.drop("text").join(best, "row", "left").select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "o.license", (-F.col("o.s")).alias("score"), (-F.col("o.w")).alias("whole"))
    declared = cut(
        own.where("whole = 1 AND path IS NOT NULL")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("d"))
        .select(F.col("dir").alias("above"), F.size(F.split("dir", "/")).alias("depth"), F.struct(F.col("d.path").alias("declared_in"), F.col("d.license").alias("dir_license")).alias("from"))
    )
    depths = sorted(r["depth"] for r in declared.where("above <> ''").select("depth").distinct().collect())  # as many as paths have parts
    # Directories are few beside files: each finds its nearest declaring ancestor once.  The root's declaration, one row at most, is everybody's.
    dirs = own.where("license IS NULL AND path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    at = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: d <= F.size(parts))
    above = F.explode(F.transform(at, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above"))))
    asked = dirs.select("dir", above.alias("a")).select("dir", "a.depth", "a.above", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).alias("salt"))
    salted = declared.where("above <> ''").select("above", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    nearest = asked.join(salted, ["above", "salt"]).groupBy("dir").agg(F.max_by("from", "depth").alias("near")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FILE_SALTS - 1).cast("long"))))
    root = declared.where("above = ''").select(F.col("from").alias("root")).collect()  # one row at most
    root = F.struct(*[F.lit(root[0]["root"][c] if root else None).cast("string").alias(c) for c in ("declared_in", "dir_license")])
    found = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(FILE_SALTS))).join(nearest, ["dir", "salt"], "left").withColumn("from", F.when(F.col("license").isNull() & F.col("path").isNotNull(), F.coalesce("near", root)))
    return found.select(
        "path",
        F.coalesce("license", F.col("from.dir_license")).alias("license"),
        F.when(F.col("whole") == 1, "file").when(F.col("whole") == 0, "header").when(F.col("from.declared_in").isNotNull(), "inherited").otherwise("none").alias("method"),
        "score",
        F.col("from.declared_in").alias("declared_in"),
    )


def scan_sql(files: str, templates: list[tuple[str, str, bool]] = ALL, header: float = 0.75, file: float = 0.3) -> str:
    """DuckDB SQL of scan() over the relation ``files``, SQL of (path, text): the same cosines, of all runs, without anchors and bounds."""
    n, stop = len(templates), ", ".join(f"'{t}'" for t in STOP)
    values = ", ".join("({}, '{}', '{}', {})".format(i, name, text.replace("'", "''"), int(title)) for i, (name, text, title) in enumerate(templates))
    real = f"term <> '' AND term NOT IN ({stop}) AND NOT regexp_matches(term, '{YEAR}')"
    return f"""
WITH templates(template, license, notice, title) AS (VALUES {values}),
files AS MATERIALIZED (SELECT row_number() OVER () AS rn, path, text FROM ({files})),
tt AS (SELECT template, term, count(*) AS k FROM (SELECT template, unnest(string_split_regex(lower(notice), '[^a-z0-9]+')) AS term FROM templates) WHERE {real} GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {n}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, term, k * idf AS w FROM tt JOIN idf USING (term)),
posting AS (SELECT template, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM tw),
pieces AS (SELECT rn, unnest(range(len(p))) AS piece, unnest(p) AS unit FROM (SELECT rn, string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM files WHERE text IS NOT NULL)),
counted AS MATERIALIZED (SELECT rn, piece, term, count(*) AS k FROM (SELECT rn, piece, unnest(string_split_regex(lower(unit), '[^a-z0-9]+')) AS term FROM pieces) WHERE {real} GROUP BY ALL),
touched AS MATERIALIZED (SELECT DISTINCT rn, piece FROM counted WHERE term IN (SELECT term FROM idf)),
runs AS MATERIALIZED (SELECT a.rn, a.piece AS first, b.piece AS last FROM touched a JOIN touched b ON a.rn = b.rn AND b.piece BETWEEN a.piece AND a.piece + {REACH - 1}
  UNION ALL SELECT DISTINCT rn, -1, -1 FROM touched),
held AS (SELECT r.rn, first, last, term, sum(k) AS k FROM runs r JOIN counted c ON c.rn = r.rn AND (first < 0 OR c.piece BETWEEN first AND last) GROUP BY ALL),
weighed AS MATERIALIZED (SELECT rn, first, last, h.term, k * coalesce(idf, ln(1.0 + {n}) + 1) AS w FROM held h LEFT JOIN idf USING (term)),
norms AS (SELECT rn, first, last, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT rn, first, last, template, sum(w * weight) AS dot FROM weighed JOIN posting USING (term) GROUP BY ALL),
every AS MATERIALIZED (SELECT rn, first, license, title, round(dot / norm, 4) AS score FROM dots JOIN norms USING (rn, first, last) JOIN templates USING (template)),
noticed AS MATERIALIZED (SELECT rn, license, score, title AS whole FROM every WHERE first >= 0 AND score >= {header}),
scored AS (SELECT * FROM noticed UNION ALL SELECT rn, license, score, 1 FROM every WHERE first < 0 AND score >= {file} AND rn IN (SELECT rn FROM noticed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY whole DESC, score DESC, license) AS best FROM scored),
own AS MATERIALIZED (SELECT f.rn, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, score, whole FROM files f LEFT JOIN (SELECT * FROM ranked WHERE best = 1) USING (rn)),
declared AS (SELECT dir AS above, path AS declared_in, license AS dir_license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS best FROM own WHERE whole = 1 AND path IS NOT NULL),
nearest AS (
  SELECT o.rn, d.declared_in, d.dir_license, row_number() OVER (PARTITION BY o.rn ORDER BY length(d.above) DESC) AS best
  FROM own o JOIN (SELECT * FROM declared WHERE best = 1) d ON o.license IS NULL AND o.path IS NOT NULL AND (d.above = '' OR o.dir = d.above OR starts_with(o.dir, d.above || '/')))
SELECT path, coalesce(license, dir_license) AS license,
  CASE WHEN whole = 1 THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN declared_in IS NOT NULL THEN 'inherited' ELSE 'none' END AS method, score, declared_in
FROM own LEFT JOIN (SELECT * FROM nearest WHERE best = 1) USING (rn)
"""
