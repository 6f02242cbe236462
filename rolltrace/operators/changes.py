"""What changed in paired records, field by field, and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import Match


def paired(match: Match) -> DataFrame:
    return match.changed.select("a", "b").unionByName(match.id_pairs.select("a", "b"))


def is_changed(a: Column, b: Column, null_changes: str = "reference") -> Column:
    """``reference``: a null on either side (or both) counts; ``strict``: only a difference does."""
    if null_changes not in ("reference", "strict"):
        raise ValueError("null_changes is 'reference' or 'strict'")
    return F.coalesce(a != b, F.lit(True)) if null_changes == "reference" else ~a.eqNullSafe(b)


def changes_extract(match: Match, varnames: list[str] | None = None, nrow: str = "nrow", null_changes: str = "reference") -> DataFrame:
    """field, value_a, value_b, change_kind, and both whole records (a, b), one row per change."""
    if varnames and nrow in varnames:
        raise ValueError(f"nrow={nrow!r} is also a field; give it another name")
    names = varnames or match.only_a.columns
    pairs = paired(match)
    fields = F.array(
        *(
            F.struct(F.lit(v).alias("field"), F.col(f"a.`{v}`").cast("string").alias("value_a"), F.col(f"b.`{v}`").cast("string").alias("value_b"),
                     is_changed(F.col(f"a.`{v}`"), F.col(f"b.`{v}`"), null_changes).alias("hit"))
            for v in names
        )
    )
    kind = (
        F.when(F.col("c.value_a").isNull() & F.col("c.value_b").isNull(), "both_null")
        .when(F.col("c.value_b").isNull(), "to_null")
        .when(F.col("c.value_a").isNull(), "from_null")
        .otherwise("value")
    )
    long = pairs.select("a", "b", F.explode(F.filter(fields, lambda x: x["hit"])).alias("c"))
    return long.select("c.field", "c.value_a", "c.value_b", kind.alias("change_kind"), "a", "b")


def changes_report(match: Match, varnames: list[str] | None = None, null_changes: str = "reference", date_origin: str | None = None) -> DataFrame:
    """labels, totalA, totalB, change_n, change_prop in the order of the labels.

    All buckets and all fields are counted in one pass each and one aggregate together."""
    names = list(varnames or ())
    counted = ["exact", "only_a", "only_b"]
    zero = F.lit(0).cast("long")
    hit = lambda v: is_changed(F.col(f"a.`{v}`"), F.col(f"b.`{v}`"), null_changes).cast("long")
    one = F.lit(1).cast("long")
    parts = [paired(match).select(F.lit("changed").alias("bucket"), one.alias("n"), *(hit(v).alias(f"v{i}") for i, v in enumerate(names)))]
    parts += [getattr(match, k).select(F.lit(k).alias("bucket"), one.alias("n"), *(zero.alias(f"v{i}") for i in range(len(names)))) for k in counted]
    of = lambda k: F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("n"))), zero)
    total = reduce(DataFrame.union, parts).agg(
        of("exact").alias("e"), of("changed").alias("c"), of("only_a").alias("oa"), of("only_b").alias("ob"), *(F.coalesce(F.sum(f"v{i}"), zero).alias(f"v{i}") for i in range(len(names)))
    )
    labels = [("Exact Matches", "e"), ("Changed", "c"), ("Dropped", "oa"), ("Added", "ob"), *((v, f"v{i}") for i, v in enumerate(names))]
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("labels"), F.col(c).alias("change_n")) for i, (t, c) in enumerate(labels)))
    out = total.select((F.col("e") + F.col("c") + F.col("oa")).alias("totalA"), (F.col("e") + F.col("c") + F.col("ob")).alias("totalB"), F.explode(rows).alias("r"))
    out = out.select("r.labels", "totalA", "totalB", "r.change_n", F.try_divide(F.col("r.change_n").cast("double"), F.col("totalB").cast("double")).alias("change_prop"))
    return out if date_origin is None else out.select(F.lit(date_origin).alias("date_origin"), "*")
