"""Scalar functions on names, contacts and dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of ISO-8859-1 and the ASCII letter each becomes.
LATIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ"
ASCII = "AAAAAACEEEEIIIIDNOOOOOOUUUUYaaaaaaceeeeiiiidnoooooouuuuyy"
#: Letters that become two.
DOUBLE = {"ß": "ss", "æ": "ae", "Æ": "AE", "þ": "th", "Þ": "TH"}
#: strftime codes and the patterns of Java's formatter.
STRFTIME = {"%m": "MM", "%d": "dd", "%y": "yy", "%Y": "yyyy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss"}


def latin_ascii(value: Column) -> Column:
    out = F.translate(value, LATIN, ASCII)
    for letter, two in DOUBLE.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def java_pattern(strftime: str) -> str:
    """Java date pattern of a strftime format; letters outside codes are quoted."""
    out, k = [], 0
    while k < len(strftime):
        code = strftime[k : k + 2]
        if code in STRFTIME:
            out.append(STRFTIME[code])
            k += 2
        elif strftime[k] == "%":
            raise ValueError(f"unknown date code {code!r}")
        else:
            out.append(f"'{strftime[k]}'" if strftime[k].isalpha() else strftime[k])
            k += 1
    return "".join(out)


def as_days(value: Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp."""
    return F.unix_date(F.to_date(value)).cast("long")


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler similarity: prefix weight 0.1, at most 4 characters, from Jaro 0.7 on."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used, left = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler by Arrow batches; equal pairs of a batch are compared once."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(x, y):
            if pair not in known:
                known[pair] = jaro_winkler(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run(a.cast("string"), b.cast("string"))
