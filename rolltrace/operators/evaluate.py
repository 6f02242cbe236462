"""Precision and recall of a match by true ids, and comparison of two matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import Match


def _flag(df: DataFrame, name: str, ids: DataFrame, flag: str) -> DataFrame:
    known = ids.select(F.col(name).alias("_k")).distinct().withColumn(flag, F.lit(True))
    return df.join(known, F.col(f"`{name}`").eqNullSafe(F.col("_k")), "left").drop("_k").withColumn(flag, F.coalesce(flag, F.lit(False)))


def performance(match: Match, ids: list[str] = ("lVoterUniqueID", "sAffNumber"), cond: str = "or", date_origin: str | None = None) -> DataFrame:
    """precision, recall, f1, pr, pt, tp, fn, fp, tnA, tnB (, date_origin), one row.

    Positive: rows of A that were paired by linkage. True: rows of A whose id is among the linked
    or unmatched rows of B. A row counts if any id says so (``or``), or all do (``and``)."""
    if cond not in ("or", "and"):
        raise ValueError("cond is 'or' or 'and'")
    changed_a, changed_b = match.changed.select("a.*"), match.changed.select("b.*")
    whole = {"changed_b": changed_b, "only_b": match.only_b, "changed_a": changed_a, "only_a": match.only_a}
    a_side = changed_a.withColumn("_pr", F.lit(True)).unionByName(match.only_a.withColumn("_pr", F.lit(False)))
    b_only = match.only_b
    for i, name in enumerate(ids):
        a_side = _flag(a_side, name, whole["changed_b"], f"_c{i}")
        a_side = _flag(a_side, name, whole["only_b"], f"_o{i}")
        b_only = _flag(b_only, name, whole["only_a"], f"_o{i}")
    both = (lambda xs: reduce(lambda p, q: p | q, xs)) if cond == "or" else (lambda xs: reduce(lambda p, q: p & q, xs))
    of = lambda k: both([F.col(f"{k}{i}") for i in range(len(ids))])
    true = both([F.col(f"_c{i}") | F.col(f"_o{i}") for i in range(len(ids))])
    pr = F.col("_pr")
    counts = a_side.agg(
        F.count_if(pr).alias("pr"), F.count_if(true).alias("pt"), F.count_if(pr & of("_c")).alias("tp"), F.count_if(~pr & of("_o")).alias("fn"),
        F.count_if(pr & ~of("_c")).alias("fp"), F.count_if(~pr & ~of("_o")).alias("tnA"),
    )
    rest = b_only.agg(F.count_if(~of("_o")).alias("tnB"))
    out = counts.join(F.broadcast(rest))  # one row each
    d = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    out = out.withColumn("precision", d(F.col("tp"), F.col("pr"))).withColumn("recall", d(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    out = out.select("precision", "recall", "f1", "pr", "pt", "tp", "fn", "fp", "tnA", "tnB")
    return out if date_origin is None else out.withColumn("date_origin", F.lit(date_origin))


def _common(m1: Match, m2: Match, names: list[str] | None) -> list[str]:
    return names or [c for c in m1.only_a.columns if c in m2.only_a.columns]


def compare(m1: Match, m2: Match, vars: list[str] | None = None, id: str = "lVoterUniqueID") -> dict[str, DataFrame]:
    """setdiff_1, setdiff_2, common, union, id_match (pairs each) and nrow, over the shared columns.

    A linked pair whose ids agree counts as an id match, as either run may have found it so.
    ``union`` holds every pair of either run once; its id matches without an id are left out."""
    names = _common(m1, m2, vars)
    cut = lambda df: df.select(*(F.struct(*(F.col(f"{s}.`{c}`") for c in names)).alias(s) for s in "ab"))
    same = F.col(f"a.`{id}`").eqNullSafe(F.col(f"b.`{id}`"))
    linked = [cut(m.changed).filter(~same) for m in (m1, m2)]
    by_id = [cut(m.id_pairs).unionByName(cut(m.changed).filter(same)) for m in (m1, m2)]
    on = F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    meet = lambda how, i, j: linked[i].alias("x").join(linked[j].alias("y"), on, how)
    only1, only2, both = meet("left_anti", 0, 1), meet("left_anti", 1, 0), meet("left_semi", 0, 1)
    ids = by_id[0].unionByName(by_id[1]).distinct().filter(F.col(f"a.`{id}`").isNotNull())
    union = only1.unionByName(both).unionByName(only2).unionByName(ids)
    parts = {"setdiff_1": only1, "setdiff_2": only2, "common": both, "id_match": ids, "union": union}
    nrow = reduce(DataFrame.union, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()))
    return parts | {"nrow": nrow}
