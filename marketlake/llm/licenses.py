"""Licence scans: sparse TF-IDF cosine to licence statements, then inheritance from the nearest directory above.

Every line and every paragraph is a unit. Units are compared with templates as sparse
vectors of terms: only terms of the templates meet in the join, other terms of a unit count in its length with the
weight of a term that no text holds. Document frequencies of the templates' terms are counted over all texts. A file
has the licence of its best unit. A licence file is one by name, or because the statement is most of it; files without
a statement of their own inherit from the licence file in the nearest directory at or above theirs.

All of it is DataFrame operations. Equal units are one row before they are compared, and directories, not files,
are joined with the directories above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import whole
from marketlake.session import stored

#: The statements by which licences are declared.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: The words by which the SQL of op1 picks its units. Some statements have none of them: "CC BY 4.0", "Released under MIT".
SIGNAL = r"licen[sc]e|permission|redistribut|unencumbered|public domain|cc0|copyright"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.6  # cosine
SHARE = 0.5  # of a file's terms in its statement, for a licence file
NAMES = r"(?i)(^|/)(un)?licen[sc]e|(^|/)copying|(^|/)notice"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def _ancestors(directory: Column) -> Column:
    """The directory and all above it; the root is empty."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _templates(spark: SparkSession) -> tuple[DataFrame, list[str]]:
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, statement string")
    terms = rows.select("template", "license", F.explode(_terms(F.col("statement"))).alias("term"))
    terms = terms.groupBy("template", "license", "term").agg(F.count("*").alias("times"))
    return terms, sorted(r.term for r in terms.select("term").distinct().collect())  # some hundred terms, fixed


def compare(units: DataFrame, frequencies: DataFrame, n_texts: Column, least: float = LEAST) -> DataFrame:
    """``unit_id, license, similarity, n_terms`` for the distinct ``units(unit_id, unit)`` near a template: the best one.

    ``frequencies(term, n)`` has the templates' terms; ``n_texts`` is the number of texts they were counted over. Ties go
    to the first template. A unit whose template terms have less than ``least`` of its length cannot reach it with any
    template (by Cauchy and Schwarz) and meets none.
    """
    spark = units.sparkSession
    templates, _ = _templates(spark)
    unseen = F.log(n_texts + 1.0) + 1
    weights = F.broadcast(frequencies.select("term", (F.log((n_texts + 1.0) / (F.col("n") + 1.0)) + 1).alias("idf")))
    template = templates.join(weights, "term").withColumn("w", F.col("times") * F.col("idf"))
    lengths = template.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("their_length"))
    template = template.join(lengths, "template").select("template", "license", "term", "w", "their_length")
    own = units.select("unit_id", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("times"))
    own = own.join(weights, "term", "left").withColumn("x", F.col("times") * F.coalesce(F.col("idf"), unseen))
    square = F.col("x") * F.col("x")
    length = own.groupBy("unit_id").agg(F.sqrt(F.sum(square)).alias("length"), F.sum("times").alias("n_terms"),
                                        F.sqrt(F.sum(F.when(F.col("idf").isNotNull(), square))).alias("known"))
    # A little less than the bound, for what rounding may add.
    length = length.filter(F.col("known") >= (least - 1e-5) * F.col("length")).drop("known")
    dots = own.join(length.select("unit_id"), "unit_id").join(F.broadcast(template), "term").groupBy("unit_id", "template", "license", "their_length").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    near = dots.join(length, "unit_id").withColumn("similarity", F.round(F.col("dot") / (F.col("length") * F.col("their_length")), 6))
    best = F.max_by(F.struct("license", "similarity", "n_terms"), F.struct("similarity", -F.col("template"))).alias("best")
    return near.filter(F.col("similarity") >= least).groupBy("unit_id").agg(best).select("unit_id", "best.*")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST, signal: str | None = None) -> DataFrame:
    """``path, license, similarity, evidence, from_dir`` for every file.

    ``evidence`` is ``own``, ``inherited`` (then ``from_dir`` tells from which directory; similarity is that of its licence
    file) or ``none``. Null texts are empty, null paths are files at the root; equal paths are judged each by its text.
    Of several licence files in a directory the most similar counts, then the smallest path. An empty table gives no row.
    With ``signal`` only lines and paragraphs in which that pattern is found (in lower case) are compared: fewer units, but
    statements without it are missed.
    """
    spark = files.sparkSession
    rows = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), whole(text_col).alias("text"))
    _, vocabulary = _templates(spark)
    terms = _terms(F.col("text"))
    lines = F.split("text", r"\r?\n")
    units = F.array_distinct(F.concat(lines, F.split("text", r"\n[ \t\r]*\n")))
    if signal is not None:
        units = F.filter(units, lambda u: F.lower(u).rlike(signal))
    units = F.transform(units, lambda u: F.trim(u))
    known = F.array_intersect(terms, F.lit(vocabulary))
    narrow = rows.select("path", F.size(terms).cast("long").alias("n_all"), known.alias("known"), units.alias("units"))
    narrow = stored(narrow.withColumn("file", F.monotonically_increasing_id()), "files")
    counted = narrow.select(F.explode("known").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    counted = every.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
    said = narrow.select("file", "path", "n_all", F.explode("units").alias("unit")).withColumn("unit_id", F.md5("unit"))
    distinct = said.select("unit_id", "unit").dropDuplicates(["unit_id"])
    matched = stored(compare(distinct, counted, F.lit(narrow.count()), least), "matched")
    best = F.max_by(F.struct("license", "similarity", (F.col("n_terms") / F.col("n_all")).alias("share")), F.struct("similarity", "license")).alias("best")
    own = said.drop("unit").join(matched, "unit_id").groupBy("file").agg(best).select("file", "best.*")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    found = stored(narrow.select("file", "path", directory.alias("dir")).join(own, "file", "left"), "own")
    of_dir = found.filter(F.col("license").isNotNull() & ((F.col("share") >= SHARE) | F.col("path").rlike(NAMES)))
    of_dir = of_dir.groupBy("dir").agg(F.min_by(F.struct("license", "similarity"), F.struct(-F.col("similarity"), "path", "license")).alias("up"))
    of_dir = of_dir.select(F.col("dir").alias("above"), "up")
    dirs = found.select("dir").distinct().select("dir", F.explode(_ancestors(F.col("dir"))).alias("above"))
    nearest = dirs.join(of_dir, "above").groupBy("dir").agg(F.max_by(F.struct("above", "up"), F.length("above")).alias("from_above"))
    # One row for each directory: a directory with very many files is split by adaptive execution.
    out = found.join(nearest, "dir", "left")
    has_own, inherits = F.col("license").isNotNull(), F.col("from_above").isNotNull()
    return out.select(
        "path", F.coalesce("license", "from_above.up.license").alias("license"),
        F.coalesce("similarity", "from_above.up.similarity").alias("similarity"),
        F.when(has_own, "own").when(inherits, "inherited").otherwise("none").alias("evidence"),
        F.when(~has_own, F.col("from_above.above")).alias("from_dir"))
