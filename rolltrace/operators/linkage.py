"""Probabilistic record linkage: Fellegi-Sunter agreement patterns and EM.

After Enamorado, Fifield and Imai (2019) and Fellegi and Sunter (1969). Candidate pairs
come from blocking passes (equi-joins); their agreement patterns are counted on the
cluster, and only the pattern table (at most 4^k rows of k fields) reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settled
from ..functions.text import similarity

#: Similarity from which strings agree, and agree partially; difference up to which numbers agree.
CUT, CUT_PARTIAL, CUT_NUMBER = 0.92, 0.88, 0.0
#: Least posterior of a link.
THRESHOLD = 0.85
#: Without blocking, so many pairs are compared at most.
MAX_PAIRS = 50_000_000
#: Fields that a pattern table may have: 4^k rows reach the driver.
MAX_FIELDS = 9


@dataclass
class Fit:
    """share of matches, P(level | match) and P(level | non-match) by field, and how it was reached."""

    share: float
    match: list[np.ndarray]
    other: list[np.ndarray]
    iterations: int
    pairs: int


def roles(varnames: list[str], varnames_str: list[str], partial: list[str] | None = None, varnames_num: list[str] | None = None):
    """Checked (strings, partially matched ones, numbers)."""
    if not set(varnames_str) <= set(varnames):
        raise ValueError(f"varnames_str has names that varnames lacks: {sorted(set(varnames_str) - set(varnames))}")
    if partial is not None and not set(partial) <= set(varnames_str):
        raise ValueError(f"partial has names that are no string variables: {sorted(set(partial) - set(varnames_str))}")
    numbers = [v for v in varnames if v not in varnames_str] if varnames_num is None else list(varnames_num)
    return list(varnames_str), list(varnames_str if partial is None else partial), numbers


def candidates(a: DataFrame, b: DataFrame, block: list[list[str]] | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Pairs (struct a, struct b). Each pass of ``block`` is a list of columns that must be equal
    and not null; a pair found by several passes comes once."""
    x = a.select(F.struct(*(F.col(f"`{c}`") for c in a.columns)).alias("a"))
    y = b.select(F.struct(*(F.col(f"`{c}`") for c in b.columns)).alias("b"))
    if not block:
        n = a.count() * b.count()
        if n > max_pairs:
            raise ValueError(f"{n} pairs without blocking; give blocking passes or raise max_pairs ({max_pairs})")
        return x.crossJoin(y)
    passes = []
    for k, columns in enumerate(block):
        on = reduce(lambda p, q: p & q, (F.col(f"a.`{c}`") == F.col(f"b.`{c}`") for c in columns))
        earlier = [reduce(lambda p, q: p & q, (F.coalesce(F.col(f"a.`{c}`") == F.col(f"b.`{c}`"), F.lit(False)) for c in before)) for before in block[:k]]
        pairs = x.join(y, on)
        passes.append(reduce(lambda df, e: df.filter(~e), earlier, pairs))
    return reduce(DataFrame.unionByName, passes)


def gammas(pairs: DataFrame, strings: list[str], partial: list[str], numbers: list[str], cut=CUT, cut_partial=CUT_PARTIAL, cut_number=CUT_NUMBER, close: str | None = None) -> DataFrame:
    """``pairs`` with columns g_<field>: 2 agree, 1 partly, 0 not, null where a value is missing; in ``close`` the sum of
    the strings' similarities."""
    out = pairs if close is None else pairs.withColumn(close, F.lit(0.0))
    for v in strings:
        a, b = F.col(f"a.`{v}`"), F.col(f"b.`{v}`")
        s = F.col(f"s_{v}")
        out = out.withColumn(f"s_{v}", similarity(a, b))
        level = F.when(s >= cut, 2)
        level = level.when(s >= cut_partial, 1) if v in partial else level
        out = out.withColumn(f"g_{v}", F.when(s.isNotNull(), level.otherwise(0)))
        out = (out if close is None else out.withColumn(close, F.col(close) + F.coalesce(s, F.lit(0.0)))).drop(f"s_{v}")
    for v in numbers:
        gap = F.abs(F.col(f"a.`{v}`").cast("double") - F.col(f"b.`{v}`").cast("double"))
        out = out.withColumn(f"g_{v}", F.when(gap.isNotNull(), F.when(gap <= cut_number, 2).otherwise(0)))
    return out


def patterns(levels: DataFrame, fields: list[str]) -> DataFrame:
    return levels.groupBy(*(f"g_{v}" for v in fields)).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Rest:
    """Pairs that no block has: how many, and how many of each level by field (none where not counted)."""

    pairs: float
    levels: list[np.ndarray]


def level_counts(a: DataFrame, b: DataFrame, strings: list[str], partial: list[str], numbers: list[str], max_pairs: float | None = None, **cuts) -> dict[str, np.ndarray]:
    """How many of all pairs of ``a`` and ``b`` have level 0, 1 and 2 of each field, by its distinct values: those that may
    agree are compared, all others have level 0.

    Every field is counted, whatever its size. Only a caller who gives ``max_pairs`` leaves out fields with more pairs of values, unless
    their level is plain equality; no query does."""
    out, wide = {}, a.sparkSession.sparkContext.defaultParallelism
    for v in strings + numbers:
        x, y = (df.filter(F.col(f"`{v}`").isNotNull()).groupBy(F.col(f"`{v}`").cast("string" if v in strings else "double").alias(v)).agg(F.count(F.lit(1)).alias("n")) for df in (a, b))
        sizes = [df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first() for df in (x, y)]
        gap = cuts.get("cut_number", CUT_NUMBER)
        if max_pairs is not None and (v in strings or gap != 0) and sizes[0][0] * sizes[1][0] > max_pairs:
            continue
        one, two = (df.repartition(wide).select(F.struct(v, "n").alias(s)) for df, s in ((x, "a"), (y, "b")))
        near = _alike(one, two, v, _least_jaro(v in partial, **cuts)) if v in strings else _near(one, two, v, gap)
        levels = gammas(near, *(([v], [v] if v in partial else [], []) if v in strings else ([], [], [v])), **cuts)
        found = {r[0]: r["n"] for r in levels.groupBy(f"g_{v}").agg(F.sum(F.col("a.n").cast("double") * F.col("b.n")).alias("n")).collect()}
        agree = [found.get(k, 0.0) for k in (1, 2)]
        out[v] = np.array([float(sizes[0][1] * sizes[1][1]) - sum(agree), *agree])
    return out


def _least_jaro(partly: bool, cut=CUT, cut_partial=CUT_PARTIAL, **_) -> float:
    """Jaro similarity below which no pair reaches level 1: a common prefix adds 0.4 of what is missing to 1 at most, from 0.7 on."""
    least = min(cut, cut_partial) if partly else cut
    return least if least <= 0.7 else max(0.7, (least - 0.4) / 0.6)


def _alike(one: DataFrame, two: DataFrame, v: str, jaro: float) -> DataFrame:
    """Pairs of strings (struct a, struct b) without those whose common letters rule out that Jaro similarity."""
    count = lambda c: F.size(F.filter(F.col("_l"), lambda d: d == c))
    bag = F.flatten(F.transform(F.array_distinct(F.col("_l")), lambda c: F.transform(F.sequence(F.lit(1), count(c)), lambda k: F.concat(c, F.lit("\u0001"), k.cast("string")))))

    def lettered(df: DataFrame, side: str) -> DataFrame:
        df = df.withColumn("_v", F.col(f"{side}.`{v}`")).withColumn("_l", F.split("_v", "")).withColumn("_m", F.char_length("_v"))
        return df.select(side, F.col("_m").alias(f"_m{side}"), bag.alias(f"_bag{side}"))

    ma, mb = F.col("_ma").cast("double"), F.col("_mb").cast("double")
    need = (3 * jaro - 1) * ma * mb - 1e-6
    fits = (F.least(ma, mb) * (ma + mb) >= need) & (F.size(F.array_intersect("_baga", "_bagb")) * (ma + mb) >= need)
    return lettered(one, "a").join(lettered(two, "b"), (F.col(f"a.`{v}`") == F.col(f"b.`{v}`")) | fits).select("a", "b")


def _near(one: DataFrame, two: DataFrame, v: str, gap: float) -> DataFrame:
    """Pairs of numbers (struct a, struct b), all of which ``gap`` or less lies between among them: in one bin of twice the gap or
    in neighbouring ones."""
    bin_of = lambda s: F.floor(F.col(f"{s}.`{v}`") / (2 * gap)).cast("double") if gap > 0 else F.col(f"{s}.`{v}`")
    around = F.array_distinct(F.transform(F.array(*map(F.lit, (-1.0, 0.0, 1.0))), lambda k: bin_of("b") + k)) if gap > 0 else F.array(bin_of("b"))
    return one.withColumn("_bin", bin_of("a")).join(two.withColumn("_bin", F.explode(around)), "_bin").select("a", "b")


def unblocked(a: DataFrame, b: DataFrame, rows: list, strings: list[str], partial: list[str], numbers: list[str], **cuts) -> Rest:
    """All pairs of ``a`` and ``b`` without those that ``rows``, their pattern counts, have."""
    fields = strings + numbers
    all_levels = level_counts(a, b, strings, partial, numbers, **cuts)
    blocked = {v: np.array([float(sum(r["n"] for r in rows if r[f"g_{v}"] == k)) for k in range(3)]) for v in fields}
    levels = [np.maximum(all_levels[v] - blocked[v], 0) if v in all_levels else np.zeros(3) for v in fields]
    return Rest(max(float(a.count()) * b.count() - sum(r["n"] for r in rows), 0.0), levels)


def em(table: np.ndarray, counts: np.ndarray, share: float | None = None, max_iter: int = 2000, tol: float = 1e-8, rest: Rest | None = None) -> Fit:
    """Fit the mixture. ``table`` has a row per pattern and levels 0, 1, 2 or -1 (missing) per field;
    missing levels leave the likelihood. ``share`` fixes the share of matches. Deterministic.

    Pairs that share a block are no fair picture of the non-matches: what brought them together nearly always agrees.
    So the pairs outside, ``rest``, count as non-matches, by field."""
    rest = rest or Rest(0.0, [np.zeros(3)] * table.shape[1])
    total = counts.sum() + rest.pairs
    k = table.shape[1]
    lam = share or 0.1
    match = [np.array([0.05, 0.15, 0.8]) for _ in range(k)]
    other = [np.array([0.8, 0.15, 0.05]) for _ in range(k)]
    done = 0
    for done in range(1, max_iter + 1):
        post = posterior(table, lam, match, other)
        wm, wu = post * counts, (1 - post) * counts
        new = share or float(min(max(wm.sum() / total, 1e-12), 1 - 1e-12))
        for f in range(k):
            for probs, w, more in ((match, wm, 0), (other, wu, rest.levels[f])):
                sums = np.array([w[table[:, f] == level].sum() for level in range(3)]) + more
                probs[f] = (sums + 1e-9) / (sums.sum() + 3e-9)
        if abs(new - lam) < tol * max(lam, 1e-12) and done > 5:
            lam = new
            break
        lam = new
    return Fit(lam, match, other, done, int(counts.sum()))


def weights(table: np.ndarray, share: float, match: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """log P(match | pattern) / P(non-match | pattern), which still differs where the posterior rounds to 1."""
    log_m, log_u = np.full(len(table), np.log(share)), np.full(len(table), np.log1p(-share))
    for f in range(table.shape[1]):
        there = table[:, f] >= 0
        log_m[there] += np.log(match[f][table[there, f]])
        log_u[there] += np.log(other[f][table[there, f]])
    return log_m - log_u


def posterior(table: np.ndarray, share: float, match: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """P(match | pattern)."""
    return 1 / (1 + np.exp(np.clip(-weights(table, share, match, other), -700, 700)))


def fit_patterns(pattern_counts: DataFrame, fields: list[str], share: float | None = None, rest_of=None, weighted: bool = False) -> tuple[DataFrame, Fit]:
    """Posterior of each pattern (``weighted``: and its log odds); the pattern table is bounded by 4^k rows.
    ``rest_of`` takes its rows and gives the :class:`Rest`."""
    spark = pattern_counts.sparkSession
    if len(fields) > MAX_FIELDS:
        raise ValueError(f"{len(fields)} fields make up to 4^{len(fields)} patterns; {MAX_FIELDS} fields are the most")
    rows = pattern_counts.orderBy(*(f"g_{v}" for v in fields)).collect()
    schema = ", ".join(f"g_{v} int" for v in fields) + ", posterior double" + ", _weight double" * weighted
    if not rows:
        return spark.createDataFrame([], schema), Fit(0.0, [], [], 0, 0)
    table = np.array([[-1 if r[f"g_{v}"] is None else r[f"g_{v}"] for v in fields] for r in rows])
    fit = em(table, np.array([r["n"] for r in rows], float), share, rest=rest_of(rows) if rest_of else None)
    scores, odds = (f(table, fit.share, fit.match, fit.other) for f in (posterior, weights))
    levels = [tuple(None if x < 0 else int(x) for x in t) for t in table]
    return spark.createDataFrame([(*t, float(p), float(w))[: None if weighted else -1] for t, p, w in zip(levels, scores, odds)], schema), fit


def one_to_one(links: DataFrame, key_a: str = "_rid_a", key_b: str = "_rid_b", best: tuple[str, ...] = ("posterior",)) -> DataFrame:
    """The pair that is ``best`` per A, so a row of A is in one pair; then per B, where ties stay. Rows of A whose B goes to
    a better pair try again among the rows of B that are left, until none has a link to one.

    Rows of A that tie for the same rows of B take them in turn, both in the order of their columns. Where they are more than
    those, or tie for some of them only, several may claim one row of B until they are repaired."""
    left, kept = settled(links, "links"), []
    while True:
        kept.append(settled(_claimed(left, key_a, key_b, best), "links-kept"))
        for key in (key_a, key_b):
            left = left.join(kept[-1].select(F.col(key).alias("_key")).distinct(), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        left = settled(left, "links-left")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, kept)


def _claimed(links: DataFrame, key_a: str, key_b: str, best: tuple[str, ...]) -> DataFrame:
    """One round: of the best pair of every A, those that no other pair of their B is better than."""
    rank = F.struct(*best)
    top = links.withColumn("_best", F.max(rank).over(Window.partitionBy(key_a))).filter(rank == F.col("_best"))
    whole = F.struct("b", key_b, *(F.col(f"`{c}`") for c in links.columns if c not in ("b", key_b)))
    per_a = top.groupBy(F.col(key_a).alias("_key")).agg(F.first("a").alias("_a"), F.sort_array(F.collect_list(whole)).alias("_rows"))
    turn = F.row_number().over(Window.partitionBy(F.col(f"_rows.{key_b}")).orderBy("_a", "_key")) - 1
    per_a = per_a.withColumn("_turn", turn).select(F.get("_rows", (F.col("_turn") % F.size("_rows")).cast("int")).alias("_row")).select("_row.*")
    per_b = per_a.groupBy(F.col(key_b).alias("_key")).agg(F.max(rank).alias("_best"))
    return per_a.join(per_b, F.col(key_b).eqNullSafe(F.col("_key")) & (rank == F.col("_best"))).select(*(f"`{c}`" for c in links.columns))


def link(
    a: DataFrame, b: DataFrame, varnames: list[str], varnames_str: list[str], partial: list[str] | None = None, varnames_num: list[str] | None = None,
    block: list[list[str]] | None = None, threshold: float = THRESHOLD, share: float | None = None, key: str = "_rid", dedupe: bool = True, **cuts,
) -> tuple[DataFrame, Fit]:
    """Linked pairs (a, b, posterior) of rows, which ``key`` tells apart on either side.

    Of a row's links, the pair that is equal in most of the columns that both sides have comes first: levels alone put a
    neighbour of a like name before the row itself. Then the weight of the pattern counts, then the strings' similarities."""
    strings, partial, numbers = roles(varnames, varnames_str, partial, varnames_num)
    fields = strings + numbers
    levels = gammas(candidates(a, b, block), strings, partial, numbers, **cuts, close="_close")
    levels = settled(levels, "link-levels")
    rest_of = (lambda rows: unblocked(a, b, rows, strings, partial, numbers, **cuts)) if block else None
    scored, fit = fit_patterns(patterns(levels, fields), fields, share, rest_of, weighted=True)
    on = reduce(lambda p, q: p & q, (F.col(f"l.g_{v}").eqNullSafe(F.col(f"s.g_{v}")) for v in fields))
    links = levels.alias("l").join(F.broadcast(scored.alias("s")), on).filter(F.col("posterior") >= threshold)
    common = [c for c in a.columns if c in b.columns and c not in (key, "_rid", "_sampled")]
    equal = reduce(Column.__add__, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")).cast("int") for c in common), F.lit(0))
    links = links.select("a", "b", "posterior", equal.alias("_equal"), "_weight", "_close", F.col(f"a.`{key}`").alias("_rid_a"), F.col(f"b.`{key}`").alias("_rid_b"))
    return (one_to_one(links, best=("_equal", "_weight", "_close")) if dedupe else links).drop("_equal", "_weight", "_close"), fit
