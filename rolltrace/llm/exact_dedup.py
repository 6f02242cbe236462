"""Exact dedup by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after white space is deleted. Three stages, each of
which compares the whole normalised text and not only its digest:

1. every task combines its own rows, one row per (digest, text) it has seen;
2. those rows meet in salted groups, so a text that holds a third of all rows is
   spread over ``salts`` reducers;
3. the winners of the salts meet per digest.

The decision is then joined back to narrow rows (a row number, id, length, digest), which were
written once. Stage 3 counts the texts of every digest; when each stands for one text, which is
all that can be told from it, the digest is the key of this join, else the whole text
joins it. Keys that many rows have are joined where the rows are.

Of the rows that share the winning id and length one stays, the one of smallest row number, so
of a row that occurs twice one copy is kept.

Defined cases: a null text counts as empty, and empty texts equal each other; a text of
white space only equals an empty one; rows repeated with the same id count each
in ``group_size`` and come back each, one of them kept; a null id never wins over another id of
equally long texts, and rows with null ids are told apart like all others; an empty table gives
an empty table; other columns are ignored and may have any names but doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, by_hot_and_cold, documents, keyed, materialise, text_of

#: Reducers over which one group may be spread in the second stage.
SALTS = 8

#: More than the distance between any two ids; and an id past all others, for null.
_SPAN, _PAST = 2**64, 2**63


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def normalise(text: Column) -> Column:
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(length: Column, doc_id: Column) -> Column:
    """Longest first, then smallest id, as one number: its fixed width keeps the
    aggregate in the hash path, which a struct would not."""
    top = F.coalesce(doc_id.cast("decimal(20,0)"), _number(_PAST))
    return (length.cast("decimal(10,0)") * _number(_SPAN) - top).cast("decimal(38,0)")


def _unranked(rank: Column, length: Column) -> Column:
    top = (length.cast("decimal(10,0)") * _number(_SPAN)).cast("decimal(38,0)") - rank
    return F.when(top < _number(_PAST), top.cast("decimal(20,0)").cast("long"))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    best = [F.max("rank").alias("rank"), F.max("length").alias("longest")]
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(*best, F.count(F.lit(1)).alias("n"))
        .withColumnRenamed("longest", "length")
    )
    return salted.repartition("digest").groupBy("digest", "norm").agg(*best, F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, digest=sha256, rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text. ``digest`` makes the grouping digest of the normalised text, of
    which text_sha256 is independent. ``rid`` names a column that tells rows apart, if there is one."""
    text = text_of()
    own = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(
        own.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), normalise(text).alias("norm"), F.length(text).alias("length")
    ).withColumn("digest", digest(F.col("norm")))
    groups = _combined(rows.drop("rid").withColumn("rank", _rank(F.col("length"), F.col("doc_id"))), salts)
    winners = materialise(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("rank").alias("rank"), F.max("longest").alias("longest"), F.sum("n").alias("n")
        ),
        "exact-dedup",
    )
    shown, on = F.col("digest") if digest is sha256 else sha256(F.col("norm")), ["digest"]
    members = rows.withColumn("text_sha256", shown)
    if winners.filter("texts > 1").limit(1).count():
        winners, on = materialise(groups, "exact-dedup-texts"), ["digest", "norm"]
    else:
        members = members.drop("norm")
    members = materialise(members, "exact-dedup-rows")
    keep = _unranked(F.col("rank"), F.col("longest"))
    joined = by_hot_and_cold(members, winners, on, "n", members.count()).withColumn("keep_id", keep)
    joined = materialise(joined.withColumn("first", keep.eqNullSafe(F.col("doc_id")) & (F.col("length") == F.col("longest"))), "exact-dedup-joined")
    stays = joined.filter("first").groupBy(*on).agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("kept"))
    return joined.join(stays, "rid", "left").select(
        "rid", "doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce("kept", F.lit(False)).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    rows, rid = keyed(docs, "exact-dedup-docs")
    stays = exact_dedup(rows, salts, rid=rid).filter("kept").select(F.col("rid").alias(rid))
    return rows.join(stays, rid, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("rid")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) = 1 AS kept,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256
FROM g
"""
