"""License scans: TF-IDF cosine of notices to templates, and inheritance from the nearest ancestor directory.

A file's text is cut into passages: its lines, the sentences within them, and each two neighbours. A passage is a
sparse vector over all of its terms, each weighted by its inverse document frequency over all files. Its
license is that of the template with the greatest cosine, if that is ``THRESHOLD`` or more; a file's is that of its
best passage. A license file (by name: LICENSE, COPYING ...) gives its license to its directory, and a file without a
license of its own takes that of the nearest ancestor directory that has one. Where names tell nothing, a file whose
notice is most of its text can stand for a license file as well (``whole``).

Document frequencies are counted over all texts. Those of the templates' terms, a fixed number, reach the driver; those
of the passages' other terms stay a table.
Passages that can't reach the threshold are left out early: those without any of the templates' :func:`anchors`. Inheritance joins directories, not files, to their
ancestors; a directory table is broadcast only up to ``BROADCAST_DIRS`` rows.

Cases: null and empty texts and paths have no license of their own; a null path is in no directory and inherits
nothing. Equal cosines take the first template by name, then the longest passage. Two license files in one directory: one by
name, then the greater cosine, then the first path. Repeated rows are each scanned. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

THRESHOLD, WHOLE, BROADCAST_DIRS, BROADCAST_TERMS = 0.8, 0.5, 200_000, 500_000
# Public license identifiers and the wording of their usual notices.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights", "CC0 1.0 Universal public domain dedication"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
LICENSE_FILES = r"(?i)^(licen[sc]e|copying|unlicense)([.\-_].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


VOCABULARY = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})


def _terms_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def weights(files: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The inverse document frequency of each template term over all rows of ``files``."""
    known = F.array(*[F.lit(t) for t in VOCABULARY])
    found = files.select(F.explode(F.array_intersect(_terms_in(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), known)).alias("term"))
    df = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}  # a row for each template term
    n = files.count()
    return {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in VOCABULARY}


def term_weights(files: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, idf): the inverse document frequency over all rows of ``files`` of each term of ``found``."""
    needed = written(found.select("term").distinct())
    if needed.count() <= BROADCAST_TERMS:
        needed = F.broadcast(needed)
    every = files.select(F.explode(F.array_distinct(_terms_in(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))).alias("term"))
    counts = every.join(needed, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return counts.select("term", (F.log(F.lit(files.count() + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vectors(idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """(license, unit vector) for each template text."""
    out = []
    for name, texts in TEMPLATES.items():
        for x in texts:
            v = {t: n * idf[t] for t, n in Counter(terms(x)).items()}
            size = math.sqrt(sum(w * w for w in v.values()))
            out.append((name, {t: w / size for t, w in v.items()}))
    return out


def anchors(templates: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Terms such that what shares none of them with a template has a cosine below ``threshold`` to it.

    The cosine of a passage is at most the length of the template's vector over the terms that they share, so each
    template's heaviest terms are taken until the length of the rest is below the threshold.
    """
    out: set[str] = set()
    for _, v in templates:
        rest = 1 - sum(w * w for t, w in v.items() if t in out)
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 - 1e-6:
                break
            if t not in out:
                out.add(t)
                rest -= w * w
    return sorted(out)


def notices(files: DataFrame, id_cols: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id columns, license, similarity, part): the best passage of each row that has one, and the share of the text's
    characters that it has; rows must differ in their ids."""
    idf = weights(files, text_col)
    templates = vectors(idf)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, r"\n|(?<=[.!?;])\s")
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.concat_ws(" ", a, b))
    needed = "(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in anchors(templates, threshold)) + ")(?![a-z0-9])"
    some = lambda c: F.lower(c).rlike(needed)
    passages = F.when(some(text), F.filter(F.concat(lines, pairs), some))
    df = files.select(*id_cols, F.length(text).alias("chars"), F.posexplode(passages).alias("nth", "passage"))
    df = df.withColumn("part", F.length("passage") / F.col("chars"))
    df = df.select(*id_cols, "nth", "part", F.explode(_terms_in(F.col("passage"))).alias("term")).groupBy(*id_cols, "nth", "part", "term").agg(F.count("*").alias("n"))
    spark = files.sparkSession
    df = written(df)
    idfs = written(term_weights(files, df, text_col))
    df = df.join(F.broadcast(idfs) if idfs.count() <= BROADCAST_TERMS else idfs, "term").withColumn("w", F.col("n") * F.col("idf"))
    sizes = df.groupBy(*id_cols, "nth", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    cells = [(k, name, t, w) for k, (name, v) in enumerate(templates) for t, w in sorted(v.items())]
    cells = F.broadcast(spark.createDataFrame(cells, "template int, license string, term string, tw double"))
    dots = df.join(cells, "term").groupBy(*id_cols, "nth", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    key = [dots[c].eqNullSafe(sizes[c]) for c in [*id_cols, "nth"]]
    cos = dots.join(sizes, key).select(*[dots[c] for c in id_cols], "license", F.round(F.col("dot") / F.col("size"), 9).alias("similarity"), "part")
    cos = cos.filter(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("order"), "license", (-F.col("part")).alias("rest"))).alias("best")
    return cos.groupBy(*id_cols).agg(best, F.max("similarity").alias("similarity")).select(*id_cols, "best.license", "similarity", (-F.col("best.rest")).alias("part"))


def directory(path: Column) -> Column:
    """All before the last slash; the root's name is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def _joined(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A left join that broadcasts ``right`` if it is small; else its skew is Spark's to split."""
    right = written(right)
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_DIRS else right, on, "left")


def inherited(found: DataFrame, whole: float | None = None) -> DataFrame:
    """``found`` (path, license, similarity, part ...) with directory, inherited_license and inherited_from.

    License files are those of such a name and, unless ``whole`` is None, those whose notice has that part of the text or more.
    """
    df = found.withColumn("directory", directory(F.col("path")))
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILES)
    is_file = named if whole is None else named | (F.col("part") >= whole)
    best = Window.partitionBy("directory").orderBy(F.col("named").desc(), F.col("similarity").desc(), "path")
    given = df.filter(is_file & F.col("license").isNotNull() & F.col("directory").isNotNull())
    given = given.select("directory", "license", "similarity", "path", named.alias("named")).withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    given = given.select(F.col("directory").alias("ancestor"), F.col("license").alias("inherited_license"))
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    dirs = df.select("directory").filter("directory is not null").distinct()
    climbed = dirs.select("directory", F.inline(F.array_distinct(up)))
    met = _joined(climbed, given, "ancestor").filter("inherited_license is not null")
    near = met.groupBy("directory").agg(F.max_by("inherited_license", "depth").alias("inherited_license"), F.max_by("ancestor", "depth").alias("inherited_from"))
    return _joined(df, near, "directory")


def scan(files: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str = "path", whole: float | None = None) -> DataFrame:
    """(id, path, license, similarity, inherited_license, inherited_from, final_license) for each row of ``files``.

    With ``whole`` a file is a license file by its text too: if its notice has that part of the characters or more.
    """
    keyed = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("text"))
    # rows that agree in all three are one file; its number of rows brings them back
    own = notices(keyed.withColumn("text_hash", F.xxhash64("text")), ["id", "path", "text_hash"])
    own = own.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("text_hash").alias("_hash"), "license", "similarity", "part")
    rows = keyed.select("id", "path", F.xxhash64("text").alias("text_hash"))
    met = rows.join(own, rows["id"].eqNullSafe(own["_id"]) & rows["path"].eqNullSafe(own["_path"]) & (rows["text_hash"] == own["_hash"]), "left")
    out = inherited(written(met.select("id", "path", "license", "similarity", "part")), whole)  # it is read three times
    final = F.coalesce("license", "inherited_license")
    return out.select(F.col("id").alias(id_col), "path", "license", "similarity", "inherited_license", "inherited_from", final.alias("final_license"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source/lang/doc_id. No such name is a license file's, so those documents are that are
    half notice or more (``WHOLE``); they give their license to their source's documents of that language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blank = lambda c: F.coalesce(c, F.lit("unknown"))
    path = F.concat_ws("/", blank(F.col("source")), blank(F.col("lang")), blank(F.col("doc_id").cast("string")))
    return scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", whole=WHOLE)
