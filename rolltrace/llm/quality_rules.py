"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Four features of a text, each bad when high, are held against cutoffs. The cutoffs are
chosen per stratum from labelled holdouts: for every (rule, cutoff) of a fixed grid
the number k of the n good holdout texts that the cutoff rejects gives a one-sided exact
binomial (Clopper-Pearson) test of "false rejection >= alpha". A cutoff is eligible
when P(Binomial(n, alpha) <= k) <= delta / tests, where tests counts every stratum,
rule and cutoff (Bonferroni); the strictest eligible cutoff of each rule is taken, provided
that it rejects relatively more bad holdout texts than good ones. With the rules
sharing ``risk`` equally, all of them together reject at most ``risk`` of a stratum's
good texts, in every stratum at once, with probability 1 - ``delta``. A stratum with too
few labels rejects nothing by these rules. Trials are distinct texts: copies of a text in a stratum
count once, as the bound needs independent ones.

The cutoffs meet the texts in an equi-join on the stratum. The cutoffs' side is repeated ``SALTS``
times, so a stratum with a third of all rows is spread over that many tasks where the join is shuffled.

Defined cases: a null or blank text has no words and fails the base; null
labels are ignored; a text labelled both good and bad counts as good; labels of
unknown documents, and with null ids, are ignored; a null stratum is a stratum; repeated rows come
back each; an empty table of documents gives an empty table, empty labels reject nothing
beyond the base; columns beyond doc_id, text and the stratum are carried untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, documents, free_name, let, materialise, once, text_of

#: Bound on the share of good texts that all rules together reject in a stratum.
RISK = 0.05
#: Probability with which the bound may fail, over all strata.
DELTA = 0.05
#: Cutoffs that are tried, from strict to lax. A text is rejected when feature > cutoff.
GRID = {
    "symbol_ratio": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3),
    "dup_line_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "long_words": (8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0),
}
#: Tasks over which a stratum is spread where its cutoffs are joined by a shuffle.
SALTS = 16

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(words: Column) -> Column:
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.element_at(words, i + 2), F.element_at(words, i + 3)),
    )


def _covered(windows: Column) -> Column:
    """Positions covered by 3-word windows that occur twice or more: equal windows are
    neighbours once sorted, then the starts of repeated ones are walked in order."""
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    starts = let(
        F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda pairs: F.array_sort(
            F.transform(F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1))), lambda x: x["i"])
        ),
    )
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    )


def _repeat_words(words: Column) -> Column:
    none = F.lit(0).cast("long")
    return let(_windows(words), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), none).otherwise(_covered(x)))


def counts(text: Column) -> Column:
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    by_chars = F.struct(without(SPACE_CHARS).cast("long").alias("word_chars"), (F.length(text) - without("#*$%&|<>")).cast("long").alias("n_symbols"))
    return F.struct(by_words.alias("w"), by_lines.alias("l"), by_chars.alias("c"))


def with_counts(docs: DataFrame, q: str = "q") -> DataFrame:
    """``docs`` with a struct column ``q`` of the counts in COUNTS, and of n_lines."""
    made = free_name("made", [*docs.columns, q])
    found = once(docs, made, counts(text_of()))
    return found.withColumn(q, F.struct(f"{made}.w.*", f"{made}.l.*", f"{made}.c.*")).drop(made)


def features(q: Column) -> dict[str, Column]:
    return {
        "symbol_ratio": F.try_divide(q["n_symbols"], q["word_chars"]),
        "dup_line_ratio": F.try_divide(q["n_dup_lines"], q["n_lines"]),
        "repeat_ratio": F.try_divide(q["n_repeat_words"], q["n_words"]),
        "long_words": F.try_divide(q["word_chars"], q["n_words"]),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k), summed term by term from logarithms."""
    first = n * F.log(1 - p)
    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] + F.log((n - j) / (j + 1)) + F.log(p / (1 - p))).alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total")
        ),
        lambda acc: acc["total"],
    )


def thresholds(counted: DataFrame, labels: DataFrame, risk: float, delta: float, grid=None) -> DataFrame:
    """One row per stratum and rule for which a cutoff is eligible: stratum, rule, cutoff,
    n_good, false_rejected, n_bad, rejected, p_value. ``counted`` has doc_id, stratum, digest and q."""
    grid = grid or GRID
    truth = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("quality") > 0).alias("good"))
    q = F.col("q")
    rows = counted.filter(~base_failed(q)).select(F.col("doc_id").alias("id"), "stratum", "digest", *(c.alias(k) for k, c in features(q).items()))
    held = rows.join(truth, "id").groupBy("stratum", "digest").agg(F.max("good").alias("good"), *(F.first(k).alias(k) for k in grid))
    tried = [
        F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.coalesce(F.col(rule) > c, F.lit(False)).alias("hit"))
        for rule, cutoffs in grid.items()
        for c in cutoffs
    ]
    hit = lambda good: F.count_if((F.col("good") == good) & F.col("t.hit"))
    tests = held.select("stratum", "good", F.explode(F.array(*tried)).alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(
        F.count_if("good").alias("n_good"), hit(True).alias("false_rejected"), F.count_if(~F.col("good")).alias("n_bad"), hit(False).alias("rejected")
    )
    tests = materialise(tests, "quality-tests")
    alpha = F.lit(risk / len(grid))
    level = F.lit(delta / max(tests.count(), 1))
    # more hits than alpha * n can't pass, so the sum needs no terms beyond
    p_value = F.when(F.col("false_rejected") <= alpha * F.col("n_good"), binomial_cdf(F.col("false_rejected"), F.col("n_good"), alpha)).otherwise(1.0)
    passed = (
        tests.withColumn("p_value", p_value)
        .filter((F.col("n_good") > 0) & (F.col("p_value") <= level))
        .filter(F.col("rejected") * F.col("n_good") > F.col("false_rejected") * F.col("n_bad"))
    )
    kept = F.struct("cutoff", "n_good", "false_rejected", "n_bad", "rejected", "p_value")
    return passed.groupBy("stratum", "rule").agg(F.min_by(kept, "cutoff").alias("x")).select("stratum", "rule", "x.*")


def judge(counted: DataFrame, chosen: DataFrame, stratum: Column, q: str, ok: str, grid=None) -> DataFrame:
    """``counted`` with a boolean ``ok``: false when a chosen cutoff is exceeded. ``q`` names the counts."""
    grid = grid or GRID
    chosen = materialise(chosen, "quality-cutoffs")
    key, salt, cut = (free_name(x, [*counted.columns, ok]) for x in ("key", "salt", "cut"))
    # equal where both are null too, and an equi-join
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    wide = chosen.groupBy(named(F.col("stratum")).alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(cut))
    wide = wide.withColumn(salt, F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    rows = counted.withColumn(key, named(stratum)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    bad = reduce(lambda a, b: a | b, (F.coalesce(c > F.col(cut)[r], F.lit(False)) for r, c in features(F.col(q)).items() if r in grid))
    return rows.join(wide, [key, salt], "left").withColumn(ok, ~bad).drop(key, salt, cut)


def _stratum(docs: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in docs.columns else F.lit(None).cast("string")


def _held_out(counted: DataFrame, stratum: Column, q: str) -> DataFrame:
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), F.sha2(text_of(), 256).alias("digest"), F.col(q).alias("q"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> tuple[DataFrame, DataFrame]:
    """The counts of every row (doc_id, stratum, digest, struct ``q``), and the cutoffs chosen.

    Texts are read once and never shuffled: the counts are written out, and only they meet
    the labels."""
    counted = materialise(_held_out(with_counts(docs.select("doc_id", "text", _stratum(docs, stratum).alias("stratum"))), F.col("stratum"), "q"), "quality-counts")
    return counted, thresholds(counted, labels, risk, delta)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass the base and the learned rules. Texts are counted once: those
    that pass the base are written with their counts, which then serve for both."""
    q, ok = free_name("q", docs.columns), free_name("ok", docs.columns)
    passed = materialise(with_counts(docs, q).filter(~base_failed(F.col(q))), "quality-passed")
    chosen = thresholds(_held_out(passed, _stratum(docs, stratum), q), labels, risk, delta)
    return judge(passed, chosen, _stratum(docs, stratum), q, ok).filter(F.col(ok)).select(*(f"`{c}`" for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, chosen = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = base_failed(F.col("q"))
    return judge(counted, chosen, F.col("stratum"), "q", "ok").select(
        "doc_id", *(F.col(f"q.{c}").alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & F.col("ok")).alias("kept")
    )


def oracle_sql(stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> str:
    tried = ", ".join(f"('{rule}', CAST({c} AS DOUBLE))" for rule, cutoffs in GRID.items() for c in cutoffs)
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule in GRID) + " END"
    alpha = risk / len(GRID)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {stratum} AS stratum, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT r, i, [w[i + 1], w[i + 2], w[i + 3]] AS g FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
c AS (
  SELECT d.r, doc_id, stratum, t, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.r = d.r),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / nullif(word_chars, 0) AS symbol_ratio,
         n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_repeat_words / nullif(n_words, 0) AS repeat_ratio,
         word_chars / nullif(n_words, 0) AS long_words
  FROM c),
truth AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (
  SELECT stratum, t, max(good) AS good, any_value(symbol_ratio) AS symbol_ratio, any_value(dup_line_ratio) AS dup_line_ratio,
         any_value(repeat_ratio) AS repeat_ratio, any_value(long_words) AS long_words
  FROM f JOIN truth ON truth.doc_id = f.doc_id WHERE NOT base_failed GROUP BY stratum, t),
grid(rule, cutoff) AS (VALUES {tried}),
tests AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k,
         count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (NOT good AND hit) AS rejected
  FROM (SELECT stratum, good, rule, cutoff, coalesce({value} > cutoff, false) AS hit FROM held, grid)
  GROUP BY stratum, rule, cutoff),
terms AS (SELECT *, unnest(range(k + 1)) AS j FROM tests),
chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff
  FROM (SELECT stratum, rule, cutoff FROM terms WHERE n > 0 AND k <= {alpha} * n AND rejected * n > k * n_bad
        GROUP BY stratum, rule, cutoff, n, k
        HAVING sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))
               <= {delta} / (SELECT count(*) FROM tests))
  GROUP BY stratum, rule),
hit AS (
  SELECT DISTINCT r FROM f JOIN chosen ON f.stratum IS NOT DISTINCT FROM chosen.stratum WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hit.r IS NULL AS kept
FROM f LEFT JOIN hit ON hit.r = f.r"""


ORACLE_SQL = oracle_sql()
