"""Licence scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the k-grams
of the licence templates.  A match votes for its diagonal (place in the text
minus place in the template); neighbouring diagonals, which an inserted or a
missing word separates, are merged, and a merged span is accepted if the
matched k-grams cover enough of the template's words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words once A-Z are lower case: all ASCII but digits and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals at most this far apart belong to one span.
SLACK = 2
COVERAGE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that name a licence by themselves (fixed values of the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence notices (fixed values): label, text, and the words that tell it from notices worded alike ("" if none).
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files", ""),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software.", ""),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation", "gnu general"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation", "lesser general"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation", "affero general"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "nc 4"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
     "noncommercial 4"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "sa 4"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     "sharealike 4"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal.", "cc0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work.", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", ""),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission.", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
     "eclipse public"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
                  "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
                  "means.", ""),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software.", ""),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAPS, text.lower()) if w]


def need(size: int, k: int, coverage: float) -> int:
    """Covered words that verify a template: the share ``coverage``, or all but what one edited word can hide.

    An edit hides its own word and, near an end, the ``k - 1`` words that are
    left in no whole k-gram; more than one k-gram's words are always asked for.
    """
    return min(size, max(k + 1, min(math.ceil(coverage * size), size - k)))


def _gram_rows(templates, k: int, coverage: float):
    """``(t, label, size, need, place, k-gram's words, whether it holds the telling words)``."""
    for t, (label, text, key) in enumerate(templates):
        words, told = template_words(text), template_words(key)
        at = next((p for p in range(len(words)) if told and words[p:p + len(told)] == told), None)
        for p in range(len(words) - k + 1):
            holds = at is None or (p <= at and at + len(told) <= p + k)
            yield t, label, len(words), need(len(words), k, coverage), p, words[p:p + k], holds


def template_grams(spark: SparkSession, templates, k: int, coverage: float) -> DataFrame:
    """``(t, label, size, need, tpos, key, gram)`` of every template k-gram: as many rows as the templates have words."""
    rows = [f"({t}, '{label}', {size}, {least}, {p}, split('{' '.join(words)}', ' '), {str(holds).lower()})"
            for t, label, size, least, p, words, holds in _gram_rows(templates, k, coverage)]
    made = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS g(t, label, size, need, tpos, words, key)")
    return made.select("t", "label", "size", "need", "tpos", "key", F.expr(_gram("words", "0", k)).alias("gram"))


def _gram(words: str, at: str, k: int) -> str:
    return f"xxhash64({', '.join(f'get({words}, {at} + {j})' for j in range(k))})"


def _words(text_col: str):
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), GAPS), "")


def spans(docs: DataFrame, templates=TEMPLATES, k: int = K, slack: int = SLACK, coverage: float = COVERAGE,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged spans ``(id, text_key, t, label, first, last, coverage, verified)`` of all template matches.

    ``first`` and ``last`` are word places in the text (the last one
    included).  A span is verified if it covers the words that ``need`` asks
    for and one of its k-grams holds the template's telling words.  Rows with
    equal id and text vote once.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _words(text_col).alias("w"))
    grams = own.where(F.size("w") >= k).select(
        "id", "text_key", F.posexplode(F.expr(f"transform(sequence(0, size(w) - {k}), i -> {_gram('w', 'i', k)})")).alias("pos", "gram"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, templates, k, coverage)), "gram")
    votes = hits.groupBy("id", "text_key", "t", "label", "size", "need", (F.col("pos") - F.col("tpos")).alias("diagonal")) \
        .agg(F.collect_set("tpos").alias("at"), F.max("key").alias("key"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    line = Window.partitionBy("id", "text_key", "t").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > slack).cast("int"), F.lit(0))
    merged = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(line)) \
        .groupBy("id", "text_key", "t", "label", "size", "need", "span") \
        .agg(F.max("key").alias("key"), F.flatten(F.collect_list("at")).alias("at"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (k - 1))))))
    return merged.select("id", "text_key", "t", "label", F.col("first").cast("long").alias("first"),
                         (F.col("last") + (k - 1)).cast("long").alias("last"), (covered / F.col("size")).alias("coverage"),
                         (F.col("key") & (covered >= F.col("need"))).alias("verified"))


def scan(docs: DataFrame, templates=TEMPLATES, k: int = K, slack: int = SLACK, coverage: float = COVERAGE,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per input row.

    ``n_base`` counts the places where a phrase's words stand; ``first_word``
    and ``last_word`` are its smallest and largest place (null if none).
    ``labels`` adds the labels of verified spans (see ``need``).  ``score`` is 1 if a phrase
    stands in the text, else the best template coverage (0 if no k-gram
    matches).  Null and empty texts have no words.  Repeated rows and null
    ids each keep their row; other columns are not read; an empty table gives
    an empty one.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _words(text_col).alias("w"))
    # only texts that hold the phrases' last word are searched place by place
    ends = {p: p.split()[-1] for p in PHRASES}
    found = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " and ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(words))
        found.append(f"if(array_contains(w, '{ends[phrase]}') and size(w) >= {len(words)}, "
                     f"filter(sequence(0, size(w) - {len(words)}), i -> {test}), cast(array() as array<int>))")
    base = own.select("id", "text_key", F.size("w").cast("long").alias("n_words"),
                      *[F.expr(e).alias(f"p{k_}") for k_, e in enumerate(found)])
    all_places = F.concat(*[F.col(f"p{k_}") for k_ in range(len(PHRASES))])
    named = F.array(*[F.when(F.size(f"p{k_}") > 0, F.lit(label)) for k_, label in enumerate(PHRASES.values())])
    base = base.select("id", "text_key", "n_words", F.size(all_places).cast("long").alias("n_base"),
                       F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
                       F.array_sort(F.array_compact(named)).alias("base"))
    best = spans(docs, templates, k, slack, coverage, id_col, text_col).groupBy("id", "text_key") \
        .agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("more"), F.max("coverage").alias("best")) \
        .select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "more", "best")
    joined = base.join(best, base["id"].eqNullSafe(best["_id"]) & (base["text_key"] == best["_key"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                         F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                         F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"))


def oracle(templates=TEMPLATES, k: int = K, slack: int = SLACK, coverage: float = COVERAGE) -> str:
    """The same result in SQL, with k-grams compared as words instead of hashes."""
    rows = [f"({t}, '{label}', {size}, {least}, {p}, '{' '.join(words)}', {holds})"
            for t, label, size, least, p, words, holds in _gram_rows(templates, k, coverage)]
    phrases = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))
        phrases.append(f"SELECT doc_id, i, '{label}' AS label FROM places WHERE {test}")
    return f"""
WITH tg(t, label, size, need, tpos, g, holds) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
         FROM ({' UNION ALL '.join(phrases)}) GROUP BY doc_id),
hits AS (SELECT doc_id, t, label, size, need, holds, i - tpos AS diagonal, tpos
         FROM (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + {k}), ' ') AS g FROM places WHERE i + {k} <= len(w)) JOIN tg USING (g)),
votes AS (SELECT doc_id, t, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS gap
          FROM (SELECT DISTINCT doc_id, t, diagonal FROM hits)),
marked AS (SELECT doc_id, t, diagonal, sum(CASE WHEN gap > {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM votes),
cover AS (SELECT doc_id, t, label, size, need, span, count(DISTINCT p) AS covered, bool_or(holds) AS told
          FROM (SELECT h.doc_id, h.t, label, size, need, holds, span, unnest(range(tpos, tpos + {k})) AS p
                FROM hits h JOIN marked m ON h.doc_id = m.doc_id AND h.t = m.t AND h.diagonal = m.diagonal) GROUP BY doc_id, t, label, size, need, span),
more AS (SELECT doc_id, max(covered / size) AS best FROM cover GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
            SELECT doc_id, label FROM cover WHERE told AND covered >= need
            UNION ALL SELECT doc_id, unnest(string_split(labels, ',')) FROM base) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word,
       CAST(hi AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN every USING (doc_id)
"""
