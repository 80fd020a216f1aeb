"""License scans: MinHash bands over overlapping windows of text retrieve templates, exact shingle containment confirms.

In DataFrame functions alone. A window is WINDOW neighbouring shingles (of SHINGLE words), one every STRIDE; a
template gives windows at every place. A band is one minimum, so two windows of similarity s share one of BANDS bands
with a probability of 1 - (1 - s)^BANDS: for s = 3/5 (three of four shingles equal) that is 0.99998. Windows
that miss every template's bands, and shingles that no template has, leave the row where they are made; what is left
is a few rows, which are then cut into regions and confirmed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import read, table

SHINGLE, WINDOW, STRIDE, BANDS = 3, 4, 2, 12
#: Templates are a parameter; their shingles and bands are sent to all executors, so their number has a bound.
MOST_TEMPLATES, MOST_BYTES = 5000, 8 << 20

#: Usual notices. A longer text can be given as it is.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}


def template_rows(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(template, license, notice) of each notice, as an inline table."""
    flat = [(k, t) for k, v in sorted(templates.items()) for t in v]
    if len(flat) > MOST_TEMPLATES or sum(len(t.encode()) for _, t in flat) > MOST_BYTES:
        raise ValueError("templates beyond the bound; scan them in several calls")
    args, rows = {}, []
    for i, (k, t) in enumerate(flat):
        args |= {f"k{i}": k, f"t{i}": t}
        rows.append(f"({i}, :k{i}, :t{i})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows) or '(-1, :k0, :t0)'} AS t(template, license, notice)", args or {"k0": "", "t0": ""}).filter("template >= 0")


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; an empty string may stand at either end."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def window_rows(df: DataFrame, keep: list[str], stride: int, known: list[int] | None = None) -> DataFrame:
    """A row for each window: keep, words, pos (of its first word), s.s0.. (its shingles' hashes, null beyond the
    text's end) and b.b0.. (bands: least hash of its shingles under each of BANDS seeds, hashed with the band's number).
    df has an array column words. Arrays of one struct are exploded so that the optimizer, which moves filters through
    projections by copying what they refer to, computes each hash once. With known (shingle hashes), windows without
    one of them go before their bands are made: a seeded hash of a hash is one to one, so they could share no band."""
    n = F.size("words")
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)), F.lit(stride)))
    d = df.filter(n >= SHINGLE).select(*keep, "words", at.alias("pos"))
    word = lambda k: F.get("words", F.col("pos") + k)
    shingle = [F.when(F.col("pos") + (j + SHINGLE) <= n, F.xxhash64(*(word(j + k) for k in range(SHINGLE)))) for j in range(WINDOW)]
    once = lambda cols: F.explode(F.array(F.struct(*cols)))
    d = d.select(*keep, "words", "pos", once([s.alias(f"s{j}") for j, s in enumerate(shingle)]).alias("s"))
    if known is not None:
        d = d.filter(reduce(or_, (F.coalesce(among(f"s.s{j}", known), F.lit(False)) for j in range(WINDOW))))
    least = lambda i: F.least(*(F.when(F.col(f"s.s{j}").isNotNull(), F.xxhash64(F.col(f"s.s{j}"), F.lit(i))) for j in range(WINDOW)))
    return d.select(*keep, "words", "pos", "s", once([F.xxhash64(F.lit(i), least(i)).alias(f"b{i}") for i in range(BANDS)]).alias("b"))


def among(c: str, values: list[int]) -> Column:
    """c IN values, as text: many literals are slow to hand over."""
    return F.expr(f"{c} IN ({', '.join(map(str, values)) or 'NULL'})")


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = 80, slack: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each region of a text that holds a template: doc_id, template, license, first_word, last_word,
    n_shared (distinct shingles of the template in the region), n_template (all of them) and containment.

    A region is a run of the template's shingles in the text with gaps below the template's length plus slack words; it
    must hold a window that a band retrieved, and percent of the template's shingles, compared exactly (as word
    triples). Documents without a region give no row. Null, empty and very short texts match nothing; rows that repeat
    an id are told apart by their text, equal rows count once. Further columns are ignored; an empty table gives an
    empty result. Templates of fewer than SHINGLE words match nothing.
    """
    spark = df.sparkSession
    t = template_rows(spark, TEMPLATES if templates is None else templates).withColumn("words", F.filter(words(F.col("notice")), lambda w: w != ""))
    tw = window_rows(t, ["template"], 1)
    t_bands = table(tw.select("template", F.posexplode(F.array(*(F.col(f"b.b{i}") for i in range(BANDS)))).alias("number", "band")).distinct(), "bands")
    triple = lambda: F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.array_join(F.slice("words", i + 1, F.lit(SHINGLE)), " "))
    t_shingles = table(t.filter(F.size("words") >= SHINGLE).select("template", "license", F.size("words").alias("n_words"), F.explode(F.array_distinct(triple())).alias("shingle")), "shingles")
    band_set: dict[int, list[int]] = {i: [] for i in range(BANDS)}
    for number, band in t_bands.select("number", "band").distinct().collect():
        band_set[number].append(band)
    hash_set = [r[0] for r in t_shingles.select(F.xxhash64(*(F.element_at(F.split("shingle", " "), k + 1) for k in range(SHINGLE)))).distinct().collect()]
    in_bands = [among(f"b.b{i}", band_set[i]) for i in range(BANDS)]
    in_shingles = [among(f"s.s{j}", hash_set) for j in range(STRIDE)]
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), words(F.col(text_col)).alias("words")).filter(F.col("words").isNotNull())
    w = window_rows(docs, ["doc_id", "key"], STRIDE, hash_set)
    # a window brings the bands that some template has, and those of its first STRIDE shingles that some template has
    hits = F.array_compact(F.array(*(F.when(in_bands[i], F.col(f"b.b{i}")) for i in range(BANDS))))
    text = lambda j: F.array_join(F.slice("words", F.col("pos") + (j + 1), F.lit(SHINGLE)), " ")
    own = F.array_compact(F.array(*(F.when(in_shingles[j], F.struct((F.col("pos") + j).alias("at"), text(j).alias("shingle"))) for j in range(STRIDE))))
    any_hit = F.lit(False)
    for i in range(BANDS):
        any_hit = any_hit | F.coalesce(in_bands[i], F.lit(False))
    for j in range(STRIDE):
        any_hit = any_hit | F.coalesce(in_shingles[j], F.lit(False))
    found = table(w.filter(any_hit).select("doc_id", "key", "pos", hits.alias("hits"), own.alias("own")), "hits")
    retrieved = found.select("doc_id", "key", "pos", F.explode("hits").alias("band")).join(F.broadcast(t_bands.select("template", "band")), "band").select("doc_id", "key", "template", F.col("pos").alias("at"), F.lit(None).cast("string").alias("shingle")).distinct()
    shared = found.select("doc_id", "key", F.explode("own").alias("o")).select("doc_id", "key", F.col("o.at").alias("at"), F.col("o.shingle").alias("shingle")).join(F.broadcast(t_shingles), "shingle").select("doc_id", "key", "template", "at", "shingle")
    sizes = t_shingles.groupBy("template").agg(F.any_value("license").alias("license"), F.any_value("n_words").alias("n_words"), F.count("*").alias("n_template"))
    both = retrieved.unionByName(shared).join(F.broadcast(sizes), "template")
    line = Window.partitionBy("doc_id", "key", "template").orderBy("at")
    both = both.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(line) > F.col("n_words") + slack, F.lit(True)).cast("int"))
    both = both.withColumn("region", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = both.groupBy("doc_id", "key", "template", "license", "n_template", "region").agg(F.min(F.when(F.col("shingle").isNotNull(), F.col("at"))).alias("first_word"), (F.max(F.when(F.col("shingle").isNotNull(), F.col("at"))) + SHINGLE - 1).alias("last_word"), F.countDistinct("shingle").alias("n_shared"), F.max(F.col("shingle").isNull()).alias("retrieved"))
    return out.filter(F.col("retrieved") & (100 * F.col("n_shared") >= percent * F.col("n_template"))).select("doc_id", "template", "license", "first_word", "last_word", "n_shared", "n_template", (F.col("n_shared") / F.col("n_template")).alias("containment"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
