"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of a text's words, whatever line breaks are in it: as many consecutive words as the template has, from any word on
(cut at the end of the text). A template of SHORT distinct words or more matches a block that has at least THRESHOLD of them; a shorter one
must be there in full, for its few words are what tells it from others. The join is exact:

* words are ordered by how often they stand in the corpus, rarest first (ties by word);
* prefix: with o = the words that a match needs, a match has one of the template's first |T| - o + 1 words, so places of those words
  alone are joined with the templates;
* position: a block is met at its rarest template word; if that is the template's word i, only the words behind i in the order can follow, and
  places around which fewer than o of these stand are dropped;
* length: so blocks with fewer than o template words are dropped as well, before any window is looked at;
* what is left is verified: the windows over the place that start at a template word, each by the intersection of the two sets.

The templates are a parameter, so their words, counts and prefixes are bounded by it and broadcast. Base phrases are found beside the join, as
words that stand consecutively.

Null and empty texts have no blocks: no labels, score 0; an empty table gives an empty result. Very long texts need no more than their words
and one window at a time. Of ties (places of one template with equal shares) the first is named. Repeated rows give repeated rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.words import SEPARATOR, ascii_lower, row_key, text_of, words_of
from tidepanel.sources.scratch import save

#: Phrase -> label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed values, the published wording of notices: label -> texts. A parameter; others may be given.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License"],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License '
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        'language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3-clause": [
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution NonCommercial"],
    "cc-by-sa": ["CC BY-SA", "Creative Commons Attribution ShareAlike"],
    "gpl-notice": [
        "GNU General Public License, version 2",
        "GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License"],
    "mit": [
        "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        'distribute, sublicense, and/or sell copies of the Software',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "no-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "public-domain": ["released into the public domain", "dedicated to the public domain"],
    "rights-reserved": ["All rights reserved"],
}
THRESHOLD = 0.8
#: Templates of fewer distinct words must be there in full.
SHORT = 10


def template_sets(templates: dict[str, list[str]], threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words, distinct words that a match needs, words of a block) of each template text that has words."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for label, texts in templates.items():
        for text in texts:
            words = [w for w in re.split(SEPARATOR, text.translate(lower)) if w]
            own = sorted(set(words))
            if own:
                need = len(own) if len(own) < SHORT else max(1, math.ceil(threshold * len(own) - 1e-9))
                out.append((label, own, need, len(words)))
    return out


def _places(words: Column, phrase: str) -> Column:
    """Starts (words from 0) of every place where the words of the phrase stand consecutively."""
    parts = phrase.split(" ")
    at = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])

    return F.when(F.size(words) >= len(parts), F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def base_places(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word, base (array of labels): one row per row of docs."""
    phrases = PHRASES if phrases is None else phrases
    # Words between single blanks: a text without a phrase in it costs one search and no array.
    flat = F.trim(F.regexp_replace(ascii_lower(text_of()), SEPARATOR, " "))
    rows = docs.select("doc_id", row_key(docs).alias("key"), flat.alias("flat"))
    padded = F.concat(F.lit(" "), "flat", F.lit(" "))
    none = F.array().cast("array<int>")
    has = [padded.contains(f" {p} ").alias(f"has{i}") for i, p in enumerate(phrases)]
    blanks = F.length("flat") - F.length(F.replace("flat", F.lit(" "), F.lit("")))
    n_words = F.when(F.col("flat") == "", 0).otherwise(blanks + 1).cast("long")
    rows = rows.select("doc_id", "key", "flat", n_words.alias("n_words"), *has)
    # The array is a column of its own: inside the search it would be made anew for every word.
    some = reduce(lambda x, y: x | y, [F.col(f"has{i}") for i in range(len(has))], F.lit(False))
    rows = rows.withColumn("w", F.when(some, F.split("flat", " ")))
    places = [F.when(F.col(f"has{i}"), _places(F.col("w"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(phrases)]
    found = rows.select("doc_id", "key", "n_words", *places)
    columns = [f"p{i}" for i in range(len(phrases))]
    every = F.concat(*columns) if columns else none
    labels = [F.when(F.size(c) > 0, F.lit(v)) for c, v in zip(columns, phrases.values())]
    return found.select(
        "doc_id", "key", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )


def matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, template (its number), label, score, word: each template found in a row, its best share and the first place that has it."""
    spark = docs.sparkSession
    sets = template_sets(TEMPLATES if templates is None else templates, threshold)
    if not sets:
        return spark.createDataFrame([], "key binary, template int, label string, score double, word int")
    vocabulary = sorted({w for _, own, _, _ in sets for w in own})
    rows = docs.select(row_key(docs).alias("key"), words_of(text_of()).alias("w"))
    # Counts over the whole corpus; one row per template word at most.
    counted = rows.select(F.explode("w").alias("word")).filter(F.col("word").isin(vocabulary)).groupBy("word").count()
    counts = dict(counted.collect())
    prefixes = []
    for number, (label, own, need, n) in enumerate(sets):
        ordered = sorted(own, key=lambda w: (counts.get(w, 0), w))
        prefixes += [(ordered[i], number, label, ordered[i:], len(own), need, n) for i in range(len(own) - need + 1)]
    kind = "word string, template int, label string, tail array<string>, size int, need int, n int"
    heads = sorted({row[0] for row in prefixes})
    places = rows.select("key", "w", F.posexplode("w").alias("p", "word")).filter(F.col("word").isin(heads))
    met = places.join(F.broadcast(spark.createDataFrame(prefixes, kind)), "word")
    # All blocks over the place lie in `near`; `tail` is what the template has from the place's word on, rarest first.
    before = F.least(F.col("p"), F.col("n") - 1)
    near = F.slice("w", F.col("p") - before + 1, before + F.col("n"))
    met = met.select("key", "template", "label", "p", "tail", "size", "need", "n", before.alias("before"), near.alias("near"))
    met = save(met.filter(F.size(F.array_intersect("near", "tail")) >= F.col("need")), "met")
    starts = F.filter(F.sequence(F.lit(0), F.col("before")), lambda k: F.array_contains("tail", F.get("near", k)))
    common = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("near", k + 1, F.col("n")), F.col("tail")))))
    hit = met.select("key", "template", "label", "p", "size", "need", common.alias("common")).filter(F.col("common") >= F.col("need"))
    best = hit.groupBy("key", "template", "label", "size").agg(F.max(F.struct("common", (-F.col("p")).alias("p"))).alias("best"))
    return best.select("key", "template", "label", (F.col("best.common") / F.col("size")).alias("score"), (-F.col("best.p")).alias("word"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: base columns, and the templates' labels with the best containment as score."""
    found = matches(docs, templates, threshold).groupBy("key").agg(F.collect_set("label").alias("own"), F.max("score").alias("score"))
    none = F.array().cast("array<string>")
    rows = base_places(docs).join(found, "key", "left").withColumn("own", F.coalesce("own", none))
    # A base phrase is a certain finding of its own.
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    labels = F.array_sort(F.array_distinct(F.concat("base", "own")))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the whole table."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sep = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    places = [
        f"SELECT doc_id, i, '{label}' AS label FROM w WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split(" ")))
        for p, label in PHRASES.items()
    ]
    sets = ", ".join(
        f"({i}, '{k}', [" + ", ".join(f"'{w}'" for w in ws) + f"], {need}, {n})" for i, (k, ws, need, n) in enumerate(template_sets(TEMPLATES))
    )
    return rf"""
WITH t(template, label, ws, need, n) AS (VALUES {sets}),
tw AS (SELECT template, need, n, unnest(ws) AS word FROM t),
d AS (SELECT doc_id, list_filter(regexp_split_to_array({lower.format("text")}, {sep}), lambda x: x <> '') AS w FROM documents),
w AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
p AS ({" UNION ALL ".join(places)}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM p GROUP BY doc_id),
o AS (SELECT doc_id, i, w[i + 1] AS word FROM w WHERE w[i + 1] IN (SELECT word FROM tw)),
c AS (
  SELECT doc_id, template FROM (SELECT DISTINCT doc_id, word FROM o) JOIN tw USING (word) GROUP BY doc_id, template, need HAVING count(*) >= need),
x AS (SELECT doc_id, template, need, n, i, word FROM o JOIN tw USING (word) JOIN c USING (doc_id, template)),
m AS (
  SELECT l.doc_id, l.template, l.i, l.need, count(DISTINCT r.word) AS common
  FROM x AS l JOIN x AS r ON l.doc_id = r.doc_id AND l.template = r.template AND r.i >= l.i AND r.i < l.i + l.n
  GROUP BY l.doc_id, l.template, l.i, l.need),
g AS (SELECT doc_id, list(DISTINCT label) AS own, max(common / len(ws)) AS score FROM m JOIN t USING (template) WHERE common >= m.need GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
