"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word gram of every text is joined to the positions of the
templates' grams. A match votes for the diagonal (word position minus template
position) it lies on; votes on one diagonal are counted, neighbouring
diagonals - a word was added or left out - are merged into spans, and a span
holds if it covers enough of its template and is not stretched.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inodelake.runtime import table

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a gram of a template of at least LONG words, and of a shorter one.
GRAM, SHORT_GRAM, LONG = 4, 2, 7
#: A span of a long template covers this share of its grams, in at most STRETCH times its words; diagonals within SLACK merge.
COVER, STRETCH, SLACK = 0.6, 1.5, 3


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


# Phrases whose places are counted, with their labels.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# The notices of common public licenses, in lower case and without punctuation.
NOTICES = (
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    Template("gpl-2.0-or-later", "either version 2 of the license or at your option any later version"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
)
TEMPLATES = BASE + NOTICES
#: The table of template positions is broadcast to every task; it may have this many rows.
MOST_POSITIONS = 100_000


def positions(templates: Sequence[Template]) -> list[tuple]:
    """Template number, gram size, grams in the template, position, and the gram's words (null beyond its size)."""
    rows = []
    for number, t in enumerate(templates):
        words = t.text.split()
        size = GRAM if len(words) >= LONG else SHORT_GRAM
        if len(words) < size:
            raise ValueError(f"a template needs {size} words or more: {t.text!r}")
        for at in range(len(words) - size + 1):
            rows.append((number, size, len(words) - size + 1, at, *words[at : at + size], *[None] * (GRAM - size)))
    if len(rows) > MOST_POSITIONS:
        raise ValueError(f"{len(rows)} template positions are too many to broadcast")
    return rows


def _positions(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    names = [f"t{k}" for k in range(GRAM)]
    rows = spark.createDataFrame(positions(templates), f"template int, gram int, grams int, t_at int, {', '.join(f'{n} string' for n in names)}")
    return rows.withColumn("key", F.xxhash64("t0", "t1"))


def license_spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words and spans (template, label, base, start, words, cover), in text order.

    A null or empty text has no words and no spans; texts of any length are read whole; equal rows and rows without
    an id stay apart; an empty table gives no rows; other columns are ignored, whatever their names.
    The templates are few and checked, so their table is broadcast; the texts
    are read once and never shuffled, only matches and one row a document are.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(lower, SEPARATORS), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
    shifted = [F.col("words")] + [F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))) for k in range(1, GRAM)]
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)]).alias("zipped"))
    grams = rows.select("row", "doc_id", "n_words", F.posexplode_outer("zipped").alias("at", "w"))
    grams = grams.select("row", "doc_id", "n_words", "at", *[F.col("w").getField(f"w{k}").alias(f"w{k}") for k in range(GRAM)])
    t = F.broadcast(_positions(spark, templates))
    same = (F.xxhash64("w0", "w1") == F.col("key")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    for k in range(SHORT_GRAM, GRAM):
        same = same & (F.col(f"t{k}").isNull() | (F.col(f"w{k}") == F.col(f"t{k}")))
    found = grams.join(t, same, "left").where("template is not null or coalesce(at, 0) = 0")
    found = found.select("row", "doc_id", "n_words", "template", "gram", "grams", "at", (F.col("at") - F.col("t_at")).alias("diagonal"))
    found = found.repartition("row")
    lines = found.groupBy("row", "doc_id", "n_words", "template", "gram", "grams", "diagonal").agg(F.count("template").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    # merge neighbouring diagonals of one template
    order = Window.partitionBy("row", "template").orderBy("lo", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slack = F.when(F.col("gram") == GRAM, SLACK).otherwise(-1)
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > slack) | (F.col("lo") - F.max("hi").over(before) > F.col("gram") + slack)
    lines = lines.withColumn("first", F.coalesce(apart, F.lit(True)).cast("int"))
    lines = lines.withColumn("span", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy("row", "doc_id", "n_words", "template", "gram", "grams", "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    length = F.col("hi") - F.col("lo") + F.col("gram")
    holds = F.when(F.col("gram") == GRAM, (cover >= COVER) & (length <= STRETCH * (F.col("grams") + F.col("gram") - 1))).otherwise(F.col("votes") == F.col("grams"))
    label = F.element_at(F.array(*[F.lit(x.label) for x in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(x.base) for x in templates]), F.col("template") + 1)
    span = F.struct(F.col("lo").cast("long").alias("start"), length.cast("long").alias("words"), "template", label.alias("label"), base.alias("base"), cover.alias("cover"))
    return spans.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(F.when(holds, span))).alias("spans")).drop("row")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Places of the base phrases, and all labels, of every document."""
    found = license_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


OP1_SQL = f"""
WITH t(template, gram, grams, t_at, t0, t1, t2, t3) AS (VALUES {_values(positions(TEMPLATES))}),
names(template, label, base) AS (VALUES {_values([(k, t.label, t.base) for k, t in enumerate(TEMPLATES)])}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT nr, i AS pos, words[i + 1] AS w0, words[i + 2] AS w1, words[i + 3] AS w2, words[i + 4] AS w3 FROM (SELECT nr, words, unnest(range(len(words))) AS i FROM d)
), lines AS (
  SELECT nr, template, gram, grams, pos - t_at AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi
  FROM g JOIN t ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR w2 = t2) AND (t3 IS NULL OR w3 = t3) GROUP BY ALL
), cut AS (
  SELECT *, CASE WHEN gram = {GRAM} THEN {SLACK} ELSE -1 END AS slack, lag(diagonal) OVER w AS was,
         max(hi) OVER (PARTITION BY nr, template ORDER BY lo, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM lines WINDOW w AS (PARTITION BY nr, template ORDER BY lo, diagonal)
), numbered AS (
  SELECT *, sum(CASE WHEN was IS NULL OR abs(diagonal - was) > slack OR lo - upto > gram + slack THEN 1 ELSE 0 END) OVER (PARTITION BY nr, template ORDER BY lo, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM cut
), spans AS (
  SELECT nr, template, gram, grams, span, sum(votes) AS votes, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ALL
), held AS (
  SELECT nr, lo, label, base, least(1.0, votes / grams)::DOUBLE AS cover FROM spans JOIN names USING (template)
  WHERE CASE WHEN gram = {GRAM} THEN votes / grams >= {COVER} AND hi - lo + gram <= {STRETCH} * (grams + gram - 1) ELSE votes = grams END
), summed AS (
  SELECT nr, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score
  FROM held GROUP BY nr
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN summed USING (nr)
"""
