"""Joins in which null equals null, and pairs kept in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``taken``, whatever their case."""
    low, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
        low.add(name.lower())
    return out


def same_types(a: DataFrame, b: DataFrame, columns: list[str]) -> None:
    """Spark would coerce silently where key types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    if wrong := [c for c in columns if x.get(c) != y.get(c)]:
        raise TypeError("types differ: " + ", ".join(f"{c}: {x.get(c)} and {y.get(c)}" for c in wrong))


def equal(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda p, q: p & q, (F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns))


def semi(a: DataFrame, b: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``a`` with (or without, ``left_anti``) an equal in ``b``."""
    return a.alias("l").join(b.select(columns).alias("r"), equal("l", "r", columns), how)


def anti(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return semi(a, b, columns, "left_anti")


def common_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``_n``: place among the rows of the same ``column``, in the order of the other columns."""
    order = [F.col(f"`{c}`").asc_nulls_last() for c, kind in df.dtypes if c != column] or [F.col(column)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(column).orderBy(*order)))


def zipped(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Pairs (struct a, struct b) of rows with equal ``column``, first with first and so on."""
    whole = lambda df: numbered(df, column).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("s"), F.col(column).alias("_k"), "_n")
    x, y = whole(a).alias("x"), whole(b).alias("y")
    on = F.col("x._k").eqNullSafe(F.col("y._k")) & (F.col("x._n") == F.col("y._n"))
    return x.join(y, on).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))


def repeated(df: DataFrame, columns: list[str], count: str = "n") -> DataFrame:
    """The groups of ``columns`` that several rows share, once per row, with their number of rows. Counted first,
    so only the counts are shuffled before the rows meet them."""
    many = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)
    return df.select(*columns).alias("l").join(many.alias("r"), equal("l", "r", columns)).select(*(F.col(f"l.`{c}`") for c in columns), f"r.{count}")


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every ``key`` in the order of ``order``; combined before the shuffle."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rank = F.struct(*(x for c in order for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, rank).alias("_row")).select("_row.*")


def full_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by ``key``, null equal to null: the key, and every other column with ``_a`` or ``_b``."""
    same_types(a, b, [key])
    joined = a.alias("l").join(b.alias("r"), equal("l", "r", [key]), "full_outer")
    own = [F.col(f"{s}.`{c}`").alias(f"{c}_{t}") for s, t, df in (("l", "a", a), ("r", "b", b)) for c in df.columns if c != key]
    return joined.select(F.coalesce(F.col(f"l.`{key}`"), F.col(f"r.`{key}`")).alias(key), *own)


def union_filled(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows by column name; what a side lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)
