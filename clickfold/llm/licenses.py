"""License scans by diagonal voting, with built-in functions only.

The words of every text form rolling k-grams. Their hashes are joined to the positions of the
same k-grams in short license notices; a match votes for the diagonal (text position less
template position), that is for the place where the template would start. Neighbouring
diagonals are merged, so that an inserted or missing word does not split a span, and a span is
verified by the share of the template's k-grams it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals at most this far apart belong to one span.
SLACK = 3
#: Share of a template's k-grams a span must hold.
COVERAGE = 0.8

# Phrases that count wherever their words stand consecutively.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Usual wordings of license notices, in lower case without punctuation.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)


def template_rows() -> list[tuple[int, str, bool, int, int, tuple[str, ...]]]:
    """(template, label, base, number of k-grams, position, k-gram) of all templates."""
    rows = []
    texts = [(*x, True) for x in BASE_PHRASES] + [(*x, False) for x in NOTICES]
    for number, (label, text, base) in enumerate(texts):
        words = text.split()
        grams = [tuple(words[i : i + K]) for i in range(len(words) - K + 1)]
        rows += [(number, label, base, len(grams), i, gram) for i, gram in enumerate(grams)]
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    values = ", ".join(
        f"({t}, '{label}', {str(base).lower()}, {n}, {i}, '{a}', '{b}', '{c}')"
        for t, label, base, n, i, (a, b, c) in template_rows()
    )
    table = spark.sql(
        "SELECT * FROM VALUES " + values + " AS t(template, label, base, grams, tpos, t0, t1, t2)"
    )
    return table.withColumn("h", F.xxhash64("t0", "t1", "t2"))


def lower_ascii(text: Column) -> Column:
    """Lower case that maps to ASCII letters from A-Z only: the Kelvin sign, the one other
    character whose lower case is an ASCII letter alone, makes way for one that has none."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ⱪ")))


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Votes, and one row without a template for every document's first word."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)).alias("words"),
    )
    rolling = words.select("row", "id", "words", F.posexplode_outer("words").alias("pos", "w0"))
    rolling = rolling.select(
        "row",
        "id",
        F.size("words").cast("long").alias("n_words"),
        "pos",
        "w0",
        F.get("words", F.col("pos") + 1).alias("w1"),
        F.get("words", F.col("pos") + 2).alias("w2"),
    ).withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    # A fixed table of a few hundred rows.
    templates = F.broadcast(_templates(docs.sparkSession))
    same = (
        (F.col("gram") == F.col("h"))
        & (F.col("w0") == F.col("t0"))
        & (F.col("w1") == F.col("t1"))
        & (F.col("w2") == F.col("t2"))
    )
    found = rolling.join(templates, same, "left").filter(
        F.col("template").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)
    )
    return found.select(
        *("row", "id", "n_words", "template", "label", "base", "grams", "tpos"),
        (F.col("pos") - F.col("tpos")).cast("long").alias("diagonal"),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``n_words``, ``n_base`` (places of base phrases),
    ``first_word`` and ``last_word`` (their smallest and largest start), ``base_labels``,
    ``labels``, ``score`` (the best span's share of its template) and ``spans``
    (label, first_word, end_word, coverage) of the verified spans by position.

    A null or empty text has no words, empty label lists, no spans and score 0; repeated rows
    give repeated results, an empty table an empty one. Other columns are not read.
    """
    # All votes of a document meet in one task: a few, or as many as a long text can hold.
    votes = _matches(docs, id_col, text_col).repartition("row")
    per_document = ["row", "id", "n_words"]
    per_template = [*per_document, "template", "label", "base", "grams"]
    diagonals = votes.groupBy(*per_template, "diagonal").agg(
        F.collect_list("tpos").alias("held"), F.count("tpos").alias("votes")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > SLACK
    merged = diagonals.withColumn("span", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(along))
    exact = F.when(F.col("base") & (F.col("votes") == F.col("grams")), F.col("diagonal"))
    spans = merged.groupBy(*per_template, "span").agg(
        F.count(exact).alias("places"),
        F.min(exact).alias("first"),
        F.max(exact).alias("last"),
        F.min(F.col("diagonal") + F.array_min("held")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("held") + K).alias("end"),
        (
            F.size(F.array_distinct(F.flatten(F.collect_list("held")))) / F.max("grams")
        ).alias("coverage"),
    )
    verified = F.col("coverage") >= COVERAGE
    # A base phrase counts in full or not at all.
    verified = verified & (~F.col("base") | (F.col("places") > 0))
    listed = F.struct(
        F.col("start").alias("first_word"),
        F.col("end").alias("end_word"),
        "label",
        "coverage",
    )

    def joined(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    return spans.groupBy(*per_document).agg(
        F.sum("places").alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        joined(F.col("places") > 0).alias("base_labels"),
        joined(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(verified, listed))).alias("spans"),
    ).select(
        F.col("id").alias(id_col),
        *("n_words", "n_base", "first_word", "last_word"),
        *("base_labels", "labels", "score", "spans"),
    )


_VALUES = ",\n    ".join(
    f"({t}, '{label}', {base}, {n}, {i}, '{a}', '{b}', '{c}')"
    for t, label, base, n, i, (a, b, c) in template_rows()
)

SQL = rf"""
WITH templates(template, label, base, grams, tpos, t0, t1, t2) AS (
  VALUES
    {_VALUES}
), texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{WORD}') AS words
  FROM documents
), rolling AS (
  SELECT r, unnest(list_zip(words, words[2:], words[3:])) AS gram,
         unnest(range(len(words))) AS pos
  FROM texts
), votes AS (
  SELECT r, template, label, base, grams, tpos, pos - tpos AS diagonal
  FROM (SELECT r, pos, gram[1] AS w0, gram[2] AS w1, gram[3] AS w2 FROM rolling)
  JOIN templates ON w0 = t0 AND w1 = t1 AND w2 = t2
), diagonals AS (
  SELECT r, template, label, base, grams, diagonal, count(*) AS votes, list(tpos) AS held
  FROM votes GROUP BY ALL
), parted AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER along > {SLACK}, false) AS apart
  FROM diagonals WINDOW along AS (PARTITION BY r, template ORDER BY diagonal)
), merged AS (
  SELECT *, sum(apart::INT) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM parted
), spans AS (
  SELECT r, template, label, base, span,
         count(*) FILTER (base AND votes = grams) AS places,
         min(diagonal) FILTER (base AND votes = grams) AS first,
         max(diagonal) FILTER (base AND votes = grams) AS last,
         len(list_distinct(flatten(list(held)))) / max(grams) AS coverage
  FROM merged GROUP BY ALL
), verified AS (
  SELECT *, coverage >= {COVERAGE} AND (NOT base OR places > 0) AS ok FROM spans
)
SELECT doc_id, len(any_value(words))::BIGINT AS n_words,
       coalesce(sum(places), 0)::BIGINT AS n_base,
       min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok), '') AS labels,
       coalesce(max(coverage) FILTER (ok), 0.0)::DOUBLE AS score
FROM texts LEFT JOIN verified USING (r)
GROUP BY r, doc_id
"""
