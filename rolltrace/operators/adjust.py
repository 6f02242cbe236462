"""Repair of a match by ids that can be trusted."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nullsafe import anti, common_ids, semi, zipped
from ..functions.storage import settled
from .match import ConservationError, Match


def _by(pairs: DataFrame, side: str, name: str, ids: DataFrame, how: str) -> DataFrame:
    """Pairs whose ``side`` has (``left_semi``) or lacks (``left_anti``) an id of ``ids``."""
    own = ids.select(F.col(name).alias("_k")).distinct()
    return pairs.join(own, F.col(f"{side}.`{name}`").eqNullSafe(F.col("_k")), how)


def settle(match: Match) -> Match:
    """The repaired buckets as tables: each is read several times by every later step."""
    return replace(match, **{k: settled(getattr(match, k), f"adjust-{k}") for k in ("changed", "only_a", "only_b")})


def dissolve_known(match: Match, name: str) -> Match:
    """Pairs of which one side's id waits, alone, among the other side's unmatched rows."""
    for mine, theirs in (("a", "b"), ("b", "a")):
        pairs = match.changed
        waiting = match.only_b if mine == "a" else match.only_a
        ids = common_ids(pairs.select(f"{mine}.*"), waiting, name).subtract(pairs.select(F.col(f"{theirs}.`{name}`").alias(name)))
        gone = _by(pairs, mine, name, ids, "left_semi")
        match = settle(
            replace(
                match,
                changed=_by(pairs, mine, name, ids, "left_anti"),
                only_a=match.only_a.unionByName(gone.select("a.*")),
                only_b=match.only_b.unionByName(gone.select("b.*")),
            )
        )
    return match


def pair_known(match: Match, name: str) -> Match:
    """Unmatched rows with the same id on both sides become pairs."""
    a, b = match.only_a.distinct(), match.only_b.distinct()
    ids = common_ids(a, b, name)
    found = zipped(semi(a, ids, [name]), semi(b, ids, [name]), name)
    return replace(match, changed=match.changed.select("a", "b").unionByName(found), only_a=anti(a, ids, [name]), only_b=anti(b, ids, [name]))


def drop_repeated(match: Match, name: str) -> Match:
    """Unmatched B rows whose id has a B row, equal in all columns, among the pairs."""
    paired = match.changed.select("b.*")
    equal = semi(match.only_b, paired, paired.columns).select(name).distinct()
    return replace(match, only_b=anti(match.only_b, equal, [name]))


def repoint(match: Match, name: str) -> Match:
    """Among pairs whose ids differ, a pair gets the B row that has its A row's id. A displaced
    B row goes to the unmatched ones unless another pair has it."""
    pairs = match.changed
    differ = ~F.col(f"a.`{name}`").eqNullSafe(F.col(f"b.`{name}`"))
    wrong = pairs.filter(differ)
    ids = wrong.select(F.col(f"a.`{name}`").alias(name)).intersect(wrong.select(F.col(f"b.`{name}`").alias(name)))
    moving, staying = _by(wrong, "a", name, ids, "left_semi"), _by(wrong, "a", name, ids, "left_anti").unionByName(pairs.filter(~differ))
    order = [F.col(f"b.`{c}`").asc_nulls_last() for c in match.only_b.columns]
    first = wrong.select("b", F.col(f"b.`{name}`").alias("_k"), F.row_number().over(Window.partitionBy(f"b.`{name}`").orderBy(*order)).alias("_n")).filter("_n = 1")
    moved = moving.alias("m").join(first.alias("f"), F.col(f"m.a.`{name}`").eqNullSafe(F.col("f._k"))).select(F.col("m.a").alias("a"), F.col("f.b").alias("b"))
    changed = staying.select("a", "b").unionByName(moved)
    left = anti(moving.select("b.*"), changed.select("b.*"), match.only_b.columns)
    return replace(match, changed=changed, only_b=match.only_b.unionByName(left))


def adjust_fn(match: Match, fn_ids: list[str] = ("lVoterUniqueID", "sAffNumber"), check: bool = True) -> Match:
    """Correct false negatives: the four repairs for each id in turn."""
    for name in fn_ids:
        for step in (dissolve_known, pair_known, drop_repeated, repoint):
            match = settle(step(match, name))
        if check and common_ids(match.only_a, match.only_b, name).limit(1).count():
            raise ConservationError(f"{name} is still on both unmatched sides")
    return match


def adjust_dups(match: Match, dedup_ids: list[str] = ("lVoterUniqueID", "sAffNumber"), compat: str = "intent") -> Match:
    """Where several A rows are paired with B rows of one id, keep the pairs whose ids agree.

    ``compat="literal"`` also takes apart every pair that was no duplicate at all, as soon as one
    duplicate has a pair that agrees. Demoted A rows are unmatched again; demoted B rows only
    if no remaining pair has their id."""
    if compat not in ("intent", "literal"):
        raise ValueError("compat is 'intent' or 'literal'")
    for name in dedup_ids:
        pairs = match.changed.select("a", "b")
        same: Column = F.col(f"a.`{name}`").eqNullSafe(F.col(f"b.`{name}`"))
        marked = pairs.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(f"b.`{name}`")) > 1).withColumn("_good", F.col("_many") & same)
        if compat == "literal" and marked.filter("_good").limit(1).count():
            kept, gone = marked.filter("_good"), marked.filter("NOT _good")
        else:
            kept, gone = marked.filter("NOT _many OR _good"), marked.filter("_many AND NOT _good")
        kept = kept.select("a", "b")
        back = anti(gone.select("b.*").distinct(), kept.select("b.*"), [name])
        match = replace(match, changed=kept, only_a=match.only_a.unionByName(gone.select("a.*")), only_b=match.only_b.unionByName(back))
        match = settle(drop_repeated(settle(match), name))
    return replace(match, only_a=match.only_a.distinct(), only_b=match.only_b.distinct())


def assert_adjusted(match: Match, a: DataFrame, b: DataFrame, ids: list[str]) -> dict[str, int]:
    """Row conservation on both sides, and no id lost."""
    n, na, nb = match.counts(), a.count(), b.count()
    paired = n["exact"] + n["id_pairs"] + n["changed"]
    if paired + n["only_a"] != na or paired + n["only_b"] != nb:
        raise ConservationError(f"{n} for {na} and {nb} rows")
    for name in ids:
        for whole, parts in ((a, (match.exact, match.id_pairs.select("a.*"), match.changed.select("a.*"), match.only_a)), (b, (match.exact, match.id_pairs.select("b.*"), match.changed.select("b.*"), match.only_b))):
            there = parts[0].select(name)
            for p in parts[1:]:
                there = there.union(p.select(name))
            if whole.select(name).subtract(there).limit(1).count():
                raise ConservationError(f"ids of {name} were lost")
    return n
