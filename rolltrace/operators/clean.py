"""Cleaning of contact fields, dates, numbers, names and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import latin_ascii

#: Day formats by the order of a date's parts.
DATE_FORMATS = {
    "mdy": ("M/d/yyyy", "M-d-yyyy", "MMddyyyy", "MM/dd/yy"),
    "dmy": ("d/M/yyyy", "d-M-yyyy", "ddMMyyyy", "dd/MM/yy"),
    "ymd": ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd"),
}
#: Gender that a title tells.
TITLES = {"MR": "M", "SR": "M", "MS": "F", "MRS": "F", "MISS": "F", "SRA": "F"}


def clean_email(value: Column, exclude=("abc@example.com",)) -> Column:
    """Lower-case ASCII; null where one of the patterns is found."""
    out = latin_ascii(F.lower(value))
    for x in exclude:
        out = F.when(~F.coalesce(out.rlike(x), F.lit(False)), out)
    return out


def clean_phone(value: Column, exclude=("___-____",)) -> Column:
    """Null where nothing but one repeated character is left of the number, or a pattern is found."""
    runs = F.regexp_replace(F.regexp_replace(value, "[()_ -]", ""), r"([\p{L}\p{N}])\1+", "$1")
    out = F.when(F.coalesce(F.length(runs) != 1, F.lit(True)), value)
    for x in exclude:
        out = F.when(~F.coalesce(out.rlike(x), F.lit(False)), out)
    return out


def clean_contact(df: DataFrame, email: str | None = None, email_exc=("abc@example.com",), phone: str | None = None, phone_exc=("___-____",)) -> DataFrame:
    """Null out placeholder e-mails and phones."""
    if email is not None:
        df = df.withColumn(email, clean_email(F.col(email), email_exc))
    if phone is not None:
        df = df.withColumn(phone, clean_phone(F.col(phone), phone_exc))
    return df


def parse_date(value: Column, order: str = "mdy") -> Column:
    if order not in DATE_FORMATS:
        raise ValueError(f"unknown date order {order!r}")
    return F.coalesce(*(F.to_date(F.try_to_timestamp(value, F.lit(p))) for p in DATE_FORMATS[order]))


def clean_vars(
    df: DataFrame, varnames=None, varnames_date=None, date_order: str = "mdy", varnames_num=None, firstname=None, prefix=None, gender_original=None
) -> DataFrame:
    """Our own definition: names trimmed, upper-case ASCII without punctuation; dates parsed by
    their order; numbers tried; titles without stops; gender told by the title where missing."""
    names = list(df.columns) if varnames is None else list(varnames)
    apart = {*(varnames_date or ()), *(varnames_num or ())}
    for c in varnames_date or ():
        df = df.withColumn(c, parse_date(F.col(c), date_order))
    for c in varnames_num or ():
        df = df.withColumn(c, F.col(c).try_cast("double"))
    if firstname and firstname in df.columns and firstname in names and firstname not in apart:
        plain = F.regexp_replace(F.upper(latin_ascii(F.col(firstname))), "[^A-Z ]", "")
        df = df.withColumn(firstname, F.trim(F.regexp_replace(plain, " +", " ")))
    if prefix and prefix in df.columns:
        df = df.withColumn(prefix, F.upper(F.regexp_replace(F.trim(F.col(prefix)), "[.]", "")))
        if gender_original and gender_original in df.columns:
            told = F.coalesce(*(F.when(F.col(prefix) == t, g) for t, g in TITLES.items()))
            own = F.upper(F.trim(F.col(gender_original)))
            df = df.withColumn(gender_original, F.coalesce(F.when(own.isin("M", "F"), own), told))
    return df
