"""License scan by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined to the positions at which the
templates have it (the templates are a fixed list, so their table is broadcast); the k-gram
itself is compared too, so a hit is exact. A hit votes for the diagonal "position in the
text minus position in the template". Votes are summed per text, template and
diagonal. For a phrase, a diagonal with all of its k-grams is one verified place. For a
notice, every diagonal with votes begins a span that takes in the diagonals up to ``gap`` further,
so that a few inserted or left-out words do not split it; its share is the number of distinct
template positions voted for, over the notice's k-grams, however often each occurs. A span is
verified when its share reaches ``coverage`` and it holds the k-grams that tell the notice from
its relatives (``must``). Spans are bounded: in the template by its size, in the text by size and gap.

Defined cases: null text is empty: no words, no places, labels empty, score 0; whole
texts of any length are scanned; repeated rows come back each, whatever their ids;
overlapping phrases count each; spans of one notice that overlap give its label once; an empty table
gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, documents, let, once, text_of

K = 3
#: Diagonals from a span's first one on that belong to it; share of a notice's k-grams that verifies it.
GAP, COVERAGE = 8, 0.6
#: Phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices as their licences word them, label, k-grams without which a text is another licence's.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3", ("gnu general public", "license version 3")),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", ("commons attribution 4",)),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", ("commons attribution sharealike", "attribution sharealike 4")),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", ("commons attribution noncommercial", "attribution noncommercial 4")),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "mit",
        ("deal in the", "copies of the"),
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache-2",
        ("the apache license", "version 2 0"),
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "bsd",
        ("source and binary", "following conditions are"),
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
        "gpl",
        ("gnu general public",),
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at",
        "mpl-2",
        ("mozilla public license", "v 2 0"),
    ),
)

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for "this text exists": one such row per text goes through the votes.
_SELF = "\n"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _SPLIT), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """k-grams in order."""
    at = lambda i, j: F.element_at(words, i + j + 1)
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(at(i, j) for j in range(1, k)))
    )


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """template, label, exact, size (in k-grams), must, tpos, gram; bounded by the lists given."""
    rows = [(i, label, i < len(phrases), text, tuple(must[0]) if must else ()) for i, (text, label, *must) in enumerate((*phrases, *notices))]
    for _, _, _, text, must in rows:
        words = text.split()
        own = {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
        if not own or not own.issuperset(must):
            raise ValueError(f"a template needs {k} words at least, and its own k-grams as those it must hold: {text!r}")
    array = lambda must: F.array(*(F.lit(x) for x in must)).cast("array<string>")
    made = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(e).alias("exact"), F.lit(t).alias("text"), array(m).alias("must")) for i, a, e, t, m in rows))
    df = spark.range(1).select(F.explode(made).alias("t")).select("t.*", _grams(F.split(F.col("t.text"), " "), k).alias("g"))
    return df.select("template", "label", "exact", F.size("g").alias("size"), "must", F.posexplode("g").alias("tpos", "gram"))


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``docs``."""
    spark = docs.sparkSession
    entry = F.struct(F.lit(-1).alias("pos"), F.lit(_SELF).alias("gram"))
    grams = lambda w: F.transform(_grams(w, k), lambda g, i: F.struct(i.alias("pos"), g.alias("gram")))
    made = let(words_of(text_of()), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(F.array(entry), grams(w)).alias("grams")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    rolling = once(texts, "m", made).select("row", "doc_id", F.col("m.n").alias("n_words"), F.explode("m.grams").alias("g"))
    rolling = rolling.select("row", "doc_id", "n_words", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram")).withColumn("h", F.xxhash64("gram"))

    self_row = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("exact"), F.lit(1).alias("size"),
        F.array().cast("array<string>").alias("must"), F.lit(-1).alias("tpos"), F.lit(_SELF).alias("gram"),
    )
    table = template_table(spark, phrases, notices, k).unionByName(self_row).withColumn("h", F.xxhash64("gram"))
    hits = rolling.alias("r").join(F.broadcast(table.alias("t")), (F.col("r.h") == F.col("t.h")) & (F.col("r.gram") == F.col("t.gram")))
    of = ["row", "doc_id", "n_words", "template", "label", "exact", "size"]
    hit = F.struct(F.col("tpos"), F.col("t.gram").alias("gram"))
    votes = hits.groupBy(*of, "must", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set(hit).alias("own"))

    # a phrase's diagonal stands for itself; a notice's takes in those that follow closely
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, gap)
    merged = F.when(F.col("exact"), F.col("own")).otherwise(F.array_distinct(F.flatten(F.collect_list("own").over(near))))
    spans = votes.withColumn("held", merged).select(
        *of, F.col("diagonal").alias("start"), F.size("held").cast("long").alias("n"), (F.size(F.array_except("must", "held.gram")) == 0).alias("whole")
    )
    share = F.col("n") / F.col("size")
    is_self = F.col("template") == -1
    place = F.col("exact") & (F.col("n") == F.col("size"))
    label = ~is_self & F.when(F.col("exact"), F.col("n") == F.col("size")).otherwise((share >= coverage) & F.col("whole"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        joined(F.collect_set(F.when(label, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(~is_self, share)), F.lit(0.0)).alias("score"),
    ).drop("row")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def oracle_sql(phrases=PHRASES, notices=NOTICES, gap: int = GAP, coverage: float = COVERAGE) -> str:
    """From the definition: a span of a notice is a diagonal d; a template position counts if the k-gram
    there stands in the text at a place whose diagonal is from d to d + gap."""
    shown = lambda must: "[" + ", ".join(f"'{x}'" for x in must) + "]::VARCHAR[]"
    templates = ",\n    ".join(
        f"({i}, '{label}', {i < len(phrases)}, '{text}', {shown(must[0] if must else ())})" for i, (text, label, *must) in enumerate((*phrases, *notices))
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '{_SPLIT}'), lambda x: x <> '') AS w
  FROM documents),
templates(template, label, exact, t, must) AS (VALUES
    {templates}),
own AS (
  SELECT template, label, exact, must, len(w) - 2 AS size, i AS tpos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
  FROM (SELECT *, unnest(range(len(w) - 2)) AS i FROM (SELECT *, string_split(t, ' ') AS w FROM templates))),
phrases AS (SELECT label, string_split(t, ' ') AS words FROM templates WHERE exact),
places AS (
  SELECT r, label, i AS start FROM (SELECT r, label, words, w, unnest(range(len(w) - len(words) + 1)) AS i FROM d, phrases)
  WHERE w[i + 1 : i + len(words)] = words),
base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY r),
found AS (
  SELECT r, template, label, exact, must, size, tpos, pos - tpos AS diagonal, own.g
  FROM (SELECT r, i AS pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d)) grams
  JOIN own ON own.g = grams.g),
spans AS (
  SELECT s.r, s.template, s.diagonal, any_value(h.label) AS label, any_value(h.exact) AS exact, count(DISTINCT h.tpos) / any_value(h.size) AS share,
         list_has_all(list(DISTINCT h.g), any_value(h.must)) AS whole
  FROM (SELECT DISTINCT r, template, diagonal FROM found) s JOIN found h
    ON h.r = s.r AND h.template = s.template AND h.diagonal BETWEEN s.diagonal AND s.diagonal + CASE WHEN h.exact THEN 0 ELSE {gap} END
  GROUP BY s.r, s.template, s.diagonal),
labelled AS (SELECT r, label FROM places UNION SELECT r, label FROM spans WHERE NOT exact AND share >= {coverage} AND whole),
listed AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY r),
scored AS (SELECT r, max(share) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base ON base.r = d.r LEFT JOIN listed ON listed.r = d.r LEFT JOIN scored ON scored.r = d.r"""


ORACLE_SQL = oracle_sql()
