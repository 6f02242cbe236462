"""URL filter: host and path rules first, then a weighted vocabulary.

A url without a fitting rule is held against a weighted vocabulary by one Aho-Corasick pass
over its lower-cased form. A hit counts only between boundaries, that is where
neither neighbour is a letter a-z or a digit. One strict term, or distinct soft terms whose weights
come to ``soft_limit``, block the url. The vocabulary is (term, weight) rows, weight null for a
strict term: the lists below, or a table given as ``vocabulary``, which may have up to MAX_TERMS terms.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule
and is still scanned (null: no hits, allowed); null ids are carried and repeated rows come back each; a term given twice
has its greatest weight, strict over soft; empty and null terms are ignored, an empty vocabulary blocks
nothing; empty table, empty result; long urls are scanned whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of which one blocks.
STRICT = (
    "casino casinos porn porno pornhub xxx viagra cialis levitra escort escorts pills warez hentai keygen keygens cracks crackz serialz nulled "
    "torrentz sportsbook sportsbetting bookmaker bookmakers milf bdsm camgirl camgirls camsex sexcam sexchat sexshop sextoys hardcore upskirt "
    "voyeur fetish stripper strippers hookers brothel tramadol xanax phentermine payday paydayloan paydayloans counterfeit"
).split()
#: Terms that add up, each with the weight behind which it stands.
SOFT = {
    1: (
        "free bets bet betting win winner cheap bonus bonuses poker loan loans slots slot adult dating nude nudes jackpot discount discounts replica "
        "replicas roulette blackjack baccarat bingo lottery lotto gamble gambling wager odds jackpots credit debt refinance mortgage forex crypto "
        "bitcoin coupon coupons deal deals sale promo voucher giveaway prize prizes sexy erotic singles hookup hot babes lingerie amateur webcam cams "
        "diet weightloss detox steroids pharmacy rx meds pill supplement supplements miracle anabolic download torrent torrents crack cracked serial "
        "mp3 ringtones clickbait viral earn income rich money fast cash profit guaranteed followers likes traffic seo backlinks"
    ).split()
}
SOFT_LIMIT = 2
#: Terms that a vocabulary may have: it is collected and held by every worker.
MAX_TERMS = 100_000

#: (term, weight), null weight for strict
VOCABULARY = (*((t, None) for t in STRICT), *((t, w) for w, terms in SOFT.items() for t in terms))


def checked(vocabulary) -> tuple[tuple[str, int | None], ...]:
    """Lower-cased terms of (term, weight) pairs, or of a DataFrame of them, once each."""
    if isinstance(vocabulary, DataFrame):
        vocabulary = [tuple(r) for r in vocabulary.select("term", "weight").limit(MAX_TERMS + 1).collect()]
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"a vocabulary may have {MAX_TERMS} terms at most")
    found: dict[str, int | None] = {}
    for term, weight in vocabulary:
        if term:
            term = term.translate(_LOWER)
            found[term] = None if weight is None or found.get(term, 0) is None else max(weight, found.get(term, 0))
    return tuple(sorted(found.items(), key=lambda x: x[0]))


_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@lru_cache(maxsize=8)
def _automaton(vocabulary: tuple[tuple[str, int | None], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def hits(url: str | None, vocabulary: tuple[tuple[str, int | None], ...]) -> tuple[int, int, int]:
    """Distinct strict terms and soft terms in a lower-cased url, and the weight of the soft ones."""
    if not url or not vocabulary:
        return 0, 0, 0
    strict, soft = set(), {}
    for end, (term, weight) in _automaton(vocabulary).iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in _INSIDE) and (end + 1 == len(url) or url[end + 1] not in _INSIDE):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
    return len(strict), len(soft), sum(soft.values())


def _vocabulary_hits(url: Column, vocabulary: tuple[tuple[str, int | None], ...]) -> Column:
    @F.pandas_udf("strict int, soft int, weight int")
    def scan(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(x, vocabulary) for x in urls], columns=["strict", "soft", "weight"])

    return scan(url)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; both null without one."""
    name = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def url_filter(pages: DataFrame, rules=RULES, vocabulary=VOCABULARY, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits; ``pages`` needs page_id and url."""
    url = F.col("url").cast("string")
    host, path = host_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), ascii_lower(url).alias("low"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("v", _vocabulary_hits(F.col("low"), checked(vocabulary)))
    method = F.when((F.col("v.strict") > 0) | (F.col("v.weight") >= soft_limit), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        F.col("v.strict").alias("strict_hits"), F.col("v.soft").alias("soft_hits"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle_sql(rules=RULES, vocabulary=VOCABULARY, soft_limit: int = SOFT_LIMIT) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    terms = ", ".join(f"({quoted(t)}, {'NULL' if w is None else w})" for t, w in checked(vocabulary))
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    ]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH terms(term, weight) AS (SELECT term, CAST(weight AS INT) FROM (VALUES {terms}) t(term, weight)),
u AS (
  SELECT row_number() OVER () AS r, page_id, coalesce({lower.format('url')}, '') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (
  SELECT r, page_id, low, {lower.format("coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM u),
h AS (
  SELECT r, count(*) FILTER (weight IS NULL) AS strict_hits, count(weight) AS soft_hits, coalesce(sum(weight), 0) AS weight
  FROM s JOIN terms ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)') GROUP BY r)
SELECT page_id, host, path, {case(1)} AS rule,
       coalesce({case(2)}, CASE WHEN strict_hits > 0 OR weight >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(coalesce(strict_hits, 0) AS INT) AS strict_hits, CAST(coalesce(soft_hits, 0) AS INT) AS soft_hits
FROM s LEFT JOIN h ON h.r = s.r"""


ORACLE_SQL = oracle_sql()
