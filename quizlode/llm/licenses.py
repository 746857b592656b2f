"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined, by hash, with the k-grams of the license templates. Every hit votes
for the diagonal (text position minus template position) on which the template would lie in that text. Votes are
counted per diagonal (a hit whose words differ from the template's is none), neighbouring diagonals that follow one
another are merged, which forgives inserted and lost words, and a merged span is verified: enough of its words, and
enough of a template, are equal. The templates are a fixed table of a few hundred k-grams, the one side that is
broadcast; texts are never shuffled, only votes are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, table

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, before and after A-Z are in lower case; splitting is much faster than matching words.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a gram, diagonals and words between spans that are merged, share of a span's words that must be equal, and
#: equal words that are enough whatever the template's length.
GRAM, NEAR, BETWEEN, SIMILARITY, ENOUGH = 4, 3, 8, 0.8, 12
#: The score of a text that names a license without any passage of its templates.
NAMED = 0.5

#: Fixed phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed texts: notices and passages of public licenses, with the labels they stand for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
               "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
               "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def template_words(text: str) -> list[str]:
    return re.findall(LICENSE_WORD, text.lower())


def _template_rows() -> list[tuple[int, str, int, int, str]]:
    """(template, label, words, position, gram) of all templates."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        words = template_words(text)
        rows += [(t, label, len(words), q, " ".join(words[q : q + GRAM])) for q in range(len(words) - GRAM + 1)]
    return rows


_GRAMS_SQL = ", ".join(f"({t}, '{label}', {n}, {q}, '{gram}')" for t, label, n, q, gram in _template_rows())


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    Other letters may change case too, which no template sees; only the Kelvin sign would turn into an ASCII letter.
    """
    low = F.when(F.contains(text, F.lit("\u212A")), lower_ascii(text)).otherwise(F.lower(text))
    return _split(F.coalesce(low, F.lit("")))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN, -1), "")


def _gram_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)])


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, spans) for the rows of ``docs`` (doc_id, text) that hold licensed passages.

    version is a hash of the text; spans lists template, label, start and end (words, end exclusive), n_equal and
    coverage (of the template). A span is a merged run of diagonals of which 80 % of the words are equal, and that has
    80 % of the template's words or 12 of them.
    """
    spark = docs.sparkSession
    grams = spark.sql(f"SELECT * FROM VALUES {_GRAMS_SQL} AS t(template, label, n_template, q, t_gram)")
    grams = grams.withColumn("t_hash", _gram_hash(F.split("t_gram", " "), F.lit(0)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("w"))
    rows = rows.where(F.size("w") >= GRAM)
    rolling = F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: _gram_hash(F.col("w"), i))
    rolled = rows.select("doc_id", "version", "w", F.posexplode(rolling).alias("p", "hash"))
    same = F.array_join(F.slice("w", F.col("p") + 1, GRAM), " ") == F.col("t_gram")
    hits = rolled.join(F.broadcast(grams), (F.col("hash") == F.col("t_hash")) & same).drop("w")
    votes = hits.groupBy("doc_id", "version", "template", "label", "n_template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"), F.collect_set("q").alias("qs")
    )
    w = W.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(w) > NEAR) | (
        F.greatest(F.col("lo") - F.lag("hi").over(w), F.lag("lo").over(w) - F.col("hi")) > BETWEEN
    )
    votes = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(w))
    merged = votes.groupBy("doc_id", "version", "template", "label", "n_template", "span").agg(
        F.min("lo").alias("start"), (F.max("hi") + GRAM).alias("end"), F.flatten(F.collect_list("qs")).alias("qs")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + GRAM - 1)))))
    merged = merged.withColumn("n_equal", covered)
    fits = (F.col("n_equal") >= SIMILARITY * (F.col("end") - F.col("start"))) & (
        F.col("n_equal") >= F.least(F.lit(float(ENOUGH)), SIMILARITY * F.col("n_template"))
    )
    span = F.struct("start", "end", "template", "label", "n_equal", F.least(F.lit(1.0), F.col("n_equal") / F.col("n_template")).alias("coverage"))
    return merged.where(fits).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _places(words: Column, phrase: str) -> Column:
    """Where the words of the phrase stand one after another."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == part)
        return found

    n = F.size(words) - len(parts)
    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, phrase places, labels, score and spans.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (coverage of the best span's
    template, a half at least where a phrase stands, else 0 without spans) and spans (null without). A null or empty text has no words, places or spans and score 0;
    rows that repeat a doc_id are judged each by its own text; an empty table gives no rows; other columns are ignored.
    """
    none = F.array().cast("array<int>")
    has = F.col("text").rlike("[lL][iI][cC][eE][nN][sS][eE]")
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("version"),
        F.size(_split(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"), F.when(has, words_of(F.col("text"))).alias("w"),
    )
    has = F.col("w").isNotNull()
    base = base.select(
        "doc_id", "version", "n_words",
        *[F.when(has, _places(F.col("w"), p)).otherwise(none).alias(label) for p, label in PHRASES],
    )
    places = F.concat(*[F.col(label) for _, label in PHRASES])
    names = F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for _, label in PHRASES]), lambda x: x.isNotNull())
    base = base.select("doc_id", "version", "n_words", places.alias("at"), names.alias("names"))
    spans = license_spans(docs).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "spans")
    out = base.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("names"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("names", more))), ",").alias("labels"),
        F.greatest(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.when(F.size("at") > 0, F.lit(NAMED)).otherwise(F.lit(0.0))).alias("score"),
        "spans",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the fixed phrases and templates."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


_PHRASES_SQL = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT * FROM (VALUES {_GRAMS_SQL}) AS t(template, label, n_template, q, gram)),
f AS (SELECT * FROM (VALUES {_PHRASES_SQL}) AS t(phrase, label, n)),
i AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
h AS (SELECT i.r, g.template, g.label, g.n_template, g.q, i.p - 1 AS p
      FROM (SELECT r, p, array_to_string(w[p : p + {GRAM - 1}], ' ') AS gram FROM i WHERE p + {GRAM - 1} <= len(w)) i JOIN g USING (gram)),
v AS (SELECT r, template, label, n_template, p - q AS diagonal, min(p) AS lo, max(p) AS hi, list(q) AS qs FROM h GROUP BY ALL),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {NEAR} AND greatest(lo - lag(hi) OVER x, lag(lo) OVER x - hi) <= {BETWEEN} THEN 0 ELSE 1 END AS apart
      FROM v WINDOW x AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM a),
m AS (SELECT r, template, label, n_template, span, min(lo) AS start, max(hi) + {GRAM} AS e, flatten(list(qs)) AS qs FROM s GROUP BY ALL),
c AS (SELECT *, len(list_distinct(flatten(list_transform(qs, lambda q: range(q, q + {GRAM}))))) AS n_equal FROM m),
k AS (SELECT r, list(label) AS more, max(least(1.0::DOUBLE, n_equal::DOUBLE / n_template)) AS score FROM c
      WHERE n_equal >= {SIMILARITY}::DOUBLE * (e - start) AND n_equal >= least({ENOUGH}::DOUBLE, {SIMILARITY}::DOUBLE * n_template) GROUP BY r),
b AS (SELECT i.r, count(*) AS n_base, min(p) - 1 AS lo, max(p) - 1 AS hi, list(DISTINCT f.label) AS names
      FROM i JOIN f ON array_to_string(w[p : p + f.n - 1], ' ') = f.phrase GROUP BY i.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.names), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.names, []), coalesce(k.more, [])))), ','), '') AS labels,
       greatest(coalesce(k.score, 0.0::DOUBLE), CASE WHEN b.n_base > 0 THEN {NAMED}::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""
