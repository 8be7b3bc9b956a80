"""License scan by diagonal voting.

Texts and templates become words; all rolling k-grams of the texts are hashed and joined with the
templates' k-grams. A match votes for the diagonal (text place minus template place) of its template.
Votes are summed by diagonal; diagonals in order, each at most `drift` words (and less than the
template's length) behind the one before, are merged into spans, since an insertion or deletion shifts
a diagonal by a few words. Neighbouring diagonals overlap in the text, so a stray vote between them
changes nothing. Spans are verified: which words of the template their matches cover. k is 3, or 2 for templates of two words. Phrases are templates too; a place of a phrase is a
diagonal on which all its k-grams voted.

Only DataFrame functions are used. Templates are a parameter, bounded in number and length, which
bounds the broadcast side of the join. Rolling k-grams are summed by row and diagonal in the task that
read the row, so only a row's votes are shuffled, and a passage that many documents share adds rows
of its documents, not pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import save

#: Bounds of what is broadcast: templates, and words of each (the bits of a long).
MAX_TEMPLATES, MAX_WORDS = 20_000, 60
_KELVIN, _OTHER = "K", "ĸ"
K = 3

# The phrases of the contract and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Sentences that public licenses and their notices hold.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this work is licensed under a creative commons attribution", "cc-by-notice"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
    ("all rights reserved", "all-rights-reserved"),
    ("released under the mit license", "mit-notice"),
]


def words(text: Column) -> Column:
    """Words: runs of a-z, digits and characters beyond ASCII, with A-Z lower-cased.

    lower() also changes letters beyond ASCII, into others beyond ASCII; they are in no template. The
    one that would become ASCII, the Kelvin sign, is replaced before.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit(_OTHER)))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(w: Column) -> Column:
    """(place, gram) of all rolling 2-grams and 3-grams; a gram's hash holds its length."""

    def of(h: Column, k: int) -> Column:
        one = lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]).alias("gram"))
        return F.when(F.size(h) < k, F.array().cast("array<struct<place:int,gram:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k), one))

    return F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.concat(of(h, 2), of(h, 3)))[0]


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """template, label, phrase (whether), k, t_size, t_place, gram; longer templates go in pieces, each a template."""
    rows, n = [], 0
    for at, (text, label) in enumerate([*phrases, *templates]):
        w, phrase = text.split(), at < len(phrases)
        if len(w) < 2 or phrase and len(w) > MAX_WORDS:
            raise ValueError(f"a template needs two words, a phrase at most {MAX_WORDS}: {text}")
        pieces = -(-len(w) // MAX_WORDS)
        for i in range(pieces):
            own = w[len(w) * i // pieces : len(w) * (i + 1) // pieces]
            k = min(K, len(own))
            rows += [(n, label, phrase, k, len(own), t, own[t : t + k]) for t in range(len(own) - k + 1)]
            n += 1
    if n > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, k int, t_size int, t_place int, g array<string>")
    hashed = [F.xxhash64(F.lit(k), *[F.xxhash64(F.get("g", F.lit(j))) for j in range(k)]) for k in (2, 3)]
    return table.select("template", "label", "phrase", "k", "t_size", "t_place", F.when(F.col("k") == 2, hashed[0]).otherwise(hashed[1]).alias("gram"))


def scan(docs: DataFrame, *, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", drift: int = 3, least: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    spans: start, end (words, end exclusive), label and score (share of the template's words that the
    span's matches cover) of templates with a score of at least `least`; places of phrases are spans
    of score 1. score of a row is its best span's, else 0. A null text has no words. Repeated rows
    and equal ids give a row each; other columns are not read; an empty table gives none.
    """
    listed = template_grams(docs.sparkSession, phrases, templates)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    grams = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.inline_outer(_grams(F.col("w"))).alias("place", "gram"))
    matches = grams.join(F.broadcast(listed), "gram", "left")  # rows without a match stay, as one without a template
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t_place"))
    votes = matches.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "k", "t_size", (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.bit_or(bit).alias("places"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    votes = save(votes)

    every = F.col("places") == F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t_size") - F.col("k") + 1) - 1
    exact = votes.where("phrase").where(every).select("row", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("t_size")).alias("end"), F.lit(1.0).alias("score"))

    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.least(F.lit(drift), F.col("t_size") - 1)
    loose = votes.where("not phrase").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    loose = loose.withColumn("band", F.sum("new").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    merged = loose.groupBy("row", "label", "phrase", "template", "k", "t_size", "band").agg(F.bit_or("places").alias("places"), F.min("lo").cast("int").alias("start"), (F.max("hi") + F.col("k")).cast("int").alias("end"))
    shifted = lambda n: F.call_function("shiftleft", F.col("places"), F.lit(n))
    covered = F.col("places").bitwiseOR(shifted(1)).bitwiseOR(F.when(F.col("k") == 3, shifted(2)).otherwise(F.lit(0).cast("long")))
    found = merged.select("row", "label", "phrase", "start", "end", (F.bit_count(covered) / F.col("t_size")).alias("score")).where(F.col("score") >= least)

    spans, base = exact.unionByName(found), F.col("phrase")
    per_row = spans.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"),
    )
    out = votes.select("row", "doc_id", "n_words").distinct().join(per_row, "row", "left")
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = out.withColumns({c: F.coalesce(F.col(c), v) for c, v in filled.items()})
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle() -> str:
    """scan() without spans as DuckDB SQL over documents, for PHRASES and TEMPLATES."""
    grams = []
    for n, (text, label) in enumerate([*PHRASES, *TEMPLATES]):
        w = text.split()
        k = min(K, len(w))
        grams += [f"({n}, '{label}', {n < len(PHRASES)}, {k}, {len(w)}, {t}, '{' '.join(w[t : t + k])}')" for t in range(len(w) - k + 1)]
    return rf"""
WITH listed(template, label, phrase, k, t_size, t_place, g) AS (VALUES {', '.join(grams)}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT r, k, i - 1 AS place, array_to_string(w[i : i + k - 1], ' ') AS g FROM docs, (VALUES (2), (3)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hits AS (SELECT r, template, label, phrase, listed.k, t_size, t_place, place - t_place AS diagonal FROM grams JOIN listed ON grams.k = listed.k AND grams.g = listed.g),
exact AS (SELECT r, label, diagonal AS start FROM hits WHERE phrase GROUP BY r, label, template, diagonal, t_size, k HAVING count(DISTINCT t_place) = t_size - k + 1),
diagonals AS (SELECT DISTINCT r, template, t_size, diagonal FROM hits WHERE NOT phrase),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= least(3, t_size - 1) THEN 0 ELSE 1 END AS new FROM diagonals),
bands AS (SELECT r, template, diagonal, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS band FROM marked),
found AS (SELECT r, label, count(DISTINCT t_place + j) / t_size AS score FROM hits JOIN bands USING (r, template, diagonal), unnest(range(0, k)) AS t(j) GROUP BY r, template, label, t_size, band HAVING count(DISTINCT t_place + j) / t_size >= 0.7),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM exact GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT r, label, score FROM found UNION ALL SELECT r, label, 1.0 FROM exact) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""
