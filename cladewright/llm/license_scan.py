"""License scans in DataFrame functions only: sparse TF-IDF cosine with notice templates, then inheritance from the nearest directory above.

Units of a text are its lines, its paragraphs of several lines (split where a line has no letter or digit, such as a bare comment mark) and the whole text. Terms are
runs of ASCII letters and digits in lower case, so that comment marks and line ends do not count, weighted by their count and by ln(1 + N / (1 + df)) with the document
frequency over all texts; a term of no template counts as one that no document has. A unit carries the licence of the most similar template if the cosine is ``least``
or more. Only units with a term of a template's prefix are compared: the heaviest terms, without which the rest of the template cannot reach ``least`` (by the
Cauchy-Schwarz inequality), so that no match is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

LEAST = 0.8
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicen[cs]e|notice)([.-][^/]*)?$"
#: A term is common if one text in this many has it, and long if it has so many characters.
COMMON, LONG = 20, 4
#: Equal texts meet their match in this many tasks.
SALTS = 16
#: The unit numbers of the whole text and of the first paragraph; further paragraphs go on downwards, lines from 0 upwards.
WHOLE, PARAGRAPH = -1, -2
# The usual notices of public licences, paragraphs of their texts, and the headings (last) that only a licence file has.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)
HEADINGS = (
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
)
TERM_END = "[^a-z0-9]+"
PARAGRAPH_END = "\n[^A-Za-z0-9\n]*\n"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM_END), lambda x: x != "")


def templates(spark: SparkSession) -> DataFrame:
    """template, license, term and tf of the fixed templates, headings last."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("template"), F.lit(k).alias("license"), F.lit(t).alias("text")) for i, (k, t) in enumerate(TEMPLATES + HEADINGS)]))
    one = spark.range(1).select(rows.alias("r")).select("r.*")
    return one.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def units(text: Column) -> Column:
    """line (number of the unit) and unit of each unit of a text."""
    number = lambda first, step: lambda x, i: F.struct((F.lit(first) + step * i).alias("line"), x.alias("unit"))
    paragraphs = F.filter(F.transform(F.split(text, PARAGRAPH_END), number(PARAGRAPH, -1)), lambda x: F.contains(x["unit"], F.lit("\n")))
    whole = F.when(F.contains(text, F.lit("\n")), F.array(F.struct(F.lit(WHOLE).alias("line"), text.alias("unit"))))
    return F.concat(F.transform(F.split(text, "\n"), number(0, 1)), paragraphs, F.coalesce(whole, F.array().cast("array<struct<line:int,unit:string>>")))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """id, line, template, license and cosine of each unit that matches, its best template (ties: the first); line numbers the unit, see ``WHOLE``.

    ``files`` has id and text. Rows with the same id must have equal texts, and count as one; so id may be a hash of the text. Null and empty texts match nothing, an
    empty table gives no rows.
    """
    spark = files.sparkSession
    t = templates(spark)
    vocab = sorted(r.term for r in t.select("term").distinct().collect())  # fixed by the templates
    held = F.concat(F.array(F.lit("")), F.coalesce(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(v) for v in vocab])), F.array().cast("array<string>")))
    df = {r.term: r.df for r in files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # no more than the templates' terms
    n = df.pop("", 0)
    known = spark.createDataFrame([(v, df.get(v, 0)) for v in vocab], "term string, df long")
    idf = lambda df: F.log(1.0 + n / (1.0 + df))
    tw = cut(t.join(F.broadcast(known), "term").withColumn("idf", idf(F.col("df"))).withColumn("w", F.col("tf") * F.col("idf")))
    # Any order of a template's terms gives a valid prefix. Terms that one text in COMMON or more has and short ones (parts of many words) come last, those of many templates
    # first, so that few terms do for all.
    tw = cut(tw.join(F.broadcast(tw.groupBy("term").agg(F.count("*").alias("shared"))), "term"))
    part = W.partitionBy("template")
    order = part.orderBy(F.col("df") * COMMON >= n, F.length("term") < LONG, F.desc("shared"), "df", F.desc(F.length("term")), "term")
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(1, W.unboundedFollowing))
    tail = tw.withColumn("total", F.sum(F.col("w") * F.col("w")).over(part)).withColumn("after", F.coalesce(rest, F.lit(0.0)))
    # terms up to and with the first after which the rest is too light (a little is left for rounding)
    before = F.lag("after").over(order)
    head = sorted(r.term for r in tail.withColumn("b", before).filter(f"b is null or b >= {least * least - 1e-5} * total").select("term").distinct().collect())
    long = [h for h in head if len(h) >= LONG]
    long = [h for h in long if not any(x != h and x in h for x in long)]  # a text with a long head has one of these
    short = "(?<![a-z0-9])(?:" + "|".join(h for h in head if len(h) < LONG) + ")(?![a-z0-9])"
    has_head = lambda c: _any([F.contains(F.lower(c), F.lit(h)) for h in long]) | (F.rlike(F.lower(c), F.lit(short)) if any(len(h) < LONG for h in head) else F.lit(False))
    found = files.filter(has_head(F.col("text"))).select("id", F.explode(units(F.col("text"))).alias("u")).select("id", "u.*").filter(has_head(F.col("unit")))
    found = found.withColumn("terms", terms(F.col("unit"))).filter(F.arrays_overlap("terms", F.array(*[F.lit(h) for h in head])))
    tf = found.select("id", "line", F.explode("terms").alias("term")).groupBy("id", "line", "term").agg(F.count("*").alias("n"))
    weights = F.broadcast(tw.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "w")).alias("in")))
    weighed = tf.join(weights, "term", "left").withColumn("uw", F.col("n") * F.coalesce("idf", idf(F.lit(0.0))))
    norms = F.broadcast(tw.groupBy("template", "license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn")))
    nowhere = F.array().cast("array<struct<template:int,w:double>>")
    parts = F.transform(F.coalesce("in", nowhere), lambda x: F.struct(x["template"].alias("template"), (x["w"] * F.col("uw")).alias("p")))
    size = weighed.groupBy("id", "line").agg(F.sqrt(F.sum(F.col("uw") * F.col("uw"))).alias("un"), F.flatten(F.collect_list(parts)).alias("ps"))
    dots = size.select("id", "line", "un", F.explode("ps").alias("x")).groupBy("id", "line", "un", F.col("x.template").alias("template")).agg(F.sum("x.p").alias("dot"))
    scored = dots.join(norms, "template").withColumn("cosine", F.round(F.col("dot") / (F.col("un") * F.col("tn")), 6)).filter(F.col("cosine") >= least)
    best = F.min_by(F.struct("template", "license", "cosine"), F.struct(-F.col("cosine"), "template"))
    return scored.groupBy("id", "line").agg(best.alias("m")).select("id", "line", "m.template", "m.license", "m.cosine")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (path, license, is_license_file and more) with effective, from_dir and up.

    A file with a licence of its own keeps it (up null); another gets that of the nearest directory at or above its own that holds a licence file (up: how many levels
    above; several files in one directory: the least path), else null. Each directory is resolved once, by joining its ancestors' paths, and files
    join their directory. The directory of a path without ``/`` is the empty string.
    """
    with_dir = files.withColumn("dir", F.coalesce(F.regexp_replace(F.regexp_substr("path", F.lit(r"^.*/")), "/+$", ""), F.lit("")))
    held = with_dir.filter("is_license_file and license is not null").groupBy(F.col("dir").alias("from_dir")).agg(F.min_by("license", F.struct("path", "license")).alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(0))), "/").alias("from_dir")))
    up = with_dir.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.*").filter("from_dir <> '' or up = size(split(dir, '/')) or dir = ''")
    near = up.join(held, "from_dir").groupBy("dir").agg(F.min_by(F.struct("given", "from_dir", "up"), "up").alias("g"))
    own = F.col("license").isNotNull()
    out = with_dir.join(near, "dir", "left")
    return out.select(*files.columns, F.coalesce("license", F.col("g.given")).alias("effective"), F.when(~own, F.col("g.from_dir")).alias("from_dir"), F.when(~own, F.col("g.up")).alias("up"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Paths source/lang/hundred/doc_id for ``documents``, whose rows have none. Null parts are ``_``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.withColumn("path", F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.expr("doc_id div 100").cast("string"), F.lit("_")), part("doc_id")))


def scan_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, license (the text's own), cosine, line, effective, from_dir and up of every row.

    The unit with the greatest cosine decides (ties: the least line number). A match is one of the text: rows with the same or a null id keep apart, equal texts are scanned as one.
    A directory's licence file is one named so, one whose whole text is a notice, or one with a licence's heading.
    """
    key = F.xxhash64("text").alias("id")
    found = scan(docs.select(key, "text"), least)
    best = F.min_by(F.struct("license", "cosine", "line"), F.struct(-F.col("cosine"), "line", "license"))
    single = F.col("line") == 0
    titled = F.bool_or(F.col("template") >= len(TEMPLATES))
    one = found.groupBy("id").agg(best.alias("m"), F.bool_or(F.col("line") == WHOLE).alias("whole"), F.bool_or(single).alias("first"), titled.alias("titled")).select(F.col("id").alias("_id"), "m.*", "whole", "first", "titled")
    rows = document_paths(docs).select("doc_id", "path", key, (F.locate("\n", F.col("text")) == 0).alias("one_line"))
    # matched texts are few beside rows, and a text may be that of a third of them
    one = one.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    files = rows.join(one, (F.col("id") == F.col("_id")) & (F.pmod(F.hash("doc_id", "path"), F.lit(SALTS)) == F.col("_s")), "left")
    only = F.col("whole") | F.col("titled") | (F.col("first") & F.col("one_line"))
    files = files.withColumn("is_license_file", F.col("path").rlike(LICENSE_NAME) | (F.col("license").isNotNull() & only))
    return inherit(files).select("doc_id", "path", "license", "cosine", "line", "effective", "from_dir", "up")
