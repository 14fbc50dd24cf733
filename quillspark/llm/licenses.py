"""License scan by diagonal voting (operator 1), with DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. All rolling word
3-grams of a text are hashed and joined to the template positions that have the same gram,
compared word by word. Each match votes for the diagonal text position - template position.
Diagonals of one template at most `slack` apart are merged into a span; a span is verified
if its grams cover at least `least_cover` of the template's words and at least `least_dense`
of the words between its ends. A base phrase stands at a place if one diagonal covers it
whole.

The templates are constants of this module, so what is broadcast doesn't grow with the
data. The rows of one text meet in one task after the join, where only matches are left.

Nulls count as empty texts. A repeated row gives a repeated result. Texts without words
have no labels, score 0 and null places. Very long texts are scanned whole. Ties: places of
equal phrases all count, and of several spans the best gives the score. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import texts

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MASKS = 4  # words of a template: 64 each
SLACK, LEAST_COVER, LEAST_DENSE = 4, 0.8, 0.5

#: Phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices as their licenses word them, and their labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "waived all copyright and related or neighboring rights to this work"),
)


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_values() -> str:
    """SQL rows (t, base, label, size, j, gram) of all template positions."""
    rows = []
    for t, (label, text) in enumerate(BASE + NOTICES):
        w = words_of(text)
        if not K <= len(w) <= 64 * MASKS:
            raise ValueError(f"template {t} has {len(w)} words")
        rows += [f"({t}, {str(t < len(BASE)).lower()}, '{label}', {len(w)}, {j}, '{' '.join(w[j : j + K])}')" for j in range(len(w) - K + 1)]
    return ",\n".join(rows)


def _templates(spark: SparkSession) -> DataFrame:
    """The template positions by gram hash, and one row of hash 0 that every text meets."""
    rows = spark.sql(f"SELECT * FROM VALUES {template_values()} AS x(t, base, label, size, j, gram)")
    w = F.split("gram", " ")
    marker = spark.sql("SELECT -1 AS t, false AS base, CAST(NULL AS STRING) AS label, 1 AS size, 0 AS j, '' AS gram, 0L AS h")
    return rows.withColumn("h", F.xxhash64(w[0], w[1], w[2])).unionByName(marker)


def _mask(q: int) -> Column:
    """The bits that the gram at j sets in the q-th 64 words of its template."""
    bits = [F.when(F.expr(f"(j + {s}) div 64 = {q}"), F.expr(f"shiftleft(1L, (j + {s}) % 64)")).otherwise(0) for s in range(K)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: int = SLACK, least_cover: float = LEAST_COVER, least_dense: float = LEAST_DENSE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs."""
    own = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"))
    at = own.select("doc_id", "th", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("w") - K))).alias("i"))
    gram = [F.get("w", F.col("i") + s) for s in range(K)]
    keyed = at.withColumn("h", F.when(F.col("i") < 0, F.lit(0)).otherwise(F.xxhash64(*gram)))
    same = (F.col("i") < 0) & (F.col("t") < 0) | (F.col("i") >= 0) & (F.col("t") >= 0) & (F.concat_ws(" ", *gram) == F.col("gram"))
    hits = keyed.join(F.broadcast(_templates(docs.sparkSession)), "h").where(same)
    hits = hits.select("doc_id", "th", F.size("w").alias("n_words"), "t", "base", "label", "size", "i", "j", *(_mask(q).alias(f"m{q}") for q in range(MASKS)))
    key = ["doc_id", "th"]
    part = ["t", "base", "label", "size"]
    masks = [F.bit_or(f"m{q}").alias(f"m{q}") for q in range(MASKS)]
    cover = sum((F.bit_count(f"m{q}") for q in range(MASKS)), F.lit(0))
    diagonals = (
        hits.repartition(*key)
        .groupBy(*key, *part, (F.col("i") - F.col("j")).alias("d"))
        .agg(F.max("n_words").alias("n_words"), F.count("*").alias("m"), F.min("i").alias("lo"), F.max("i").alias("hi"), *masks)
        .withColumn("full", F.col("base") & (cover == F.col("size")))
    )
    along = Window.partitionBy(*key, *part).orderBy("d")
    spans = (
        diagonals.withColumn("new", (F.col("d") - F.lag("d", 1).over(along) > slack).cast("int"))
        .withColumn("g", F.sum(F.coalesce("new", F.lit(0))).over(along))
        .groupBy(*key, *part, "g")
        .agg(
            F.max("n_words").alias("n_words"), F.max("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *masks,
            F.count_if("full").alias("n_base"), F.min(F.when(F.col("full"), F.col("d"))).alias("first"), F.max(F.when(F.col("full"), F.col("d"))).alias("last"),
        )
        .withColumn("cover", cover / F.col("size"))
        .withColumn("found", (F.col("n_base") > 0) | (F.col("t") >= 0) & (F.col("cover") >= least_cover) & (cover >= least_dense * (F.col("hi") + K - F.col("lo"))))
    )
    listed = lambda when: F.concat_ws(",", F.array_sort(F.collect_set(F.when(when, F.col("label")))))
    out = spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("n_base").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        listed(F.col("n_base") > 0).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.max(F.when(F.col("t") >= 0, F.col("cover")).otherwise(0.0)).alias("score"),
        F.max(F.when(F.col("t") < 0, F.col("m"))).alias("m"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("m")).drop("m")


ORACLE_SQL = f"""
WITH templates(t, base, label, size, j, gram) AS (VALUES {template_values()}),
docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
places AS (SELECT r, w, unnest(range(len(w) - {K - 1})) AS i FROM docs WHERE len(w) >= {K}),
hits AS (SELECT r, t, base, label, size, i, j, i - j AS d FROM
  (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM places) JOIN templates USING (gram)),
covered AS (SELECT r, t, base, label, size, d, i, unnest([j, j + 1, j + 2]) AS p FROM hits),
diagonals AS (SELECT r, t, base, label, size, d, min(i) AS lo, max(i) AS hi, count(DISTINCT p) AS ps FROM covered GROUP BY ALL),
marked AS (SELECT *, base AND ps = size AS whole, coalesce(d - lag(d) OVER (PARTITION BY r, t ORDER BY d) > {SLACK}, false)::INT AS fresh FROM diagonals),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY d) AS g FROM marked),
spans AS (SELECT r, t, base, label, size, g, min(lo) AS lo, max(hi) AS hi, count(*) FILTER (whole) AS n_base,
  min(d) FILTER (whole) AS first, max(d) FILTER (whole) AS last FROM grouped GROUP BY ALL),
shares AS (SELECT r, t, g, count(DISTINCT p) AS cover FROM covered JOIN grouped USING (r, t, d) GROUP BY ALL),
judged AS (SELECT *, cover / size AS share, n_base > 0 OR (cover / size >= {LEAST_COVER} AND cover >= {LEAST_DENSE} * (hi + {K} - lo)) AS found
  FROM spans JOIN shares USING (r, t, g))
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, coalesce(sum(n_base), 0)::BIGINT AS n_base,
  min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (n_base > 0)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (found)), ','), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM docs LEFT JOIN judged USING (r) GROUP BY r
"""
