"""Catalogue of the snapshots for which a file exists."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_pattern


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> list[str]:
    """Base names of the files in a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(folder, recursive)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(found)


def interval(period: int | str) -> str:
    """SQL interval of a step: days as int, or "day", "week", "2 weeks", "month", "quarter", "year"."""
    if isinstance(period, int) or str(period).isdigit():
        return f"INTERVAL {int(period)} DAY"
    m = re.fullmatch(r"(?:(\d+) )?(day|week|month|quarter|year)s?", str(period))
    if not m:
        raise ValueError(f"unknown period {period!r}")
    n, unit = int(m[1] or 1), m[2]
    return f"INTERVAL {3 * n} MONTH" if unit == "quarter" else f"INTERVAL {n} {unit.upper()}"


def date_spine(spark: SparkSession, start: str, end: str, period: int | str = 1, format: str = "%m%d%y") -> DataFrame:
    """date, weekday, date_label; month steps are clamped to the end of shorter months."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{start}', DATE '{end}', {interval(period)})")).alias("date"))
    return days.select("date", F.date_format("date", "EEE").alias("weekday"), F.date_format("date", java_pattern(format)).alias("date_label"))


def with_labels(spine: DataFrame, labels: DataFrame) -> DataFrame:
    """The days whose label occurs in ``labels`` (column date_label)."""
    return spine.join(labels.select("date_label").distinct(), "date_label", "left_semi").select("date", "weekday", "date_label")


def snapshot_list(
    spark: SparkSession, start: str = "2018-04-26", end: str = "2021-01-01", path: str = "7z", pattern: str = r"^(?=.*Cntywd_)(?!.*Hist)",
    file_type: str = ".txt", format: str = "%m%d%y", recursive: bool = False, period: int | str = 1, file_prefix: str = "Cntywd_",
) -> DataFrame:
    """date, weekday, date_label of the days between ``start`` and ``end`` for which ``path`` has a
    file. ``file_type`` and ``pattern`` are regular expressions; the label follows the prefix."""
    spine = date_spine(spark, start, end, period, format)
    size = len(spine.select("date_label").first()[0])
    names = [PurePosixPath(f).name for f in list_files(spark, path, recursive)]
    names = [n for n in names if re.search(file_type, n) and re.search(pattern, n)]
    labels = [(n[len(file_prefix) : len(file_prefix) + size],) for n in names]
    return with_labels(spine, spark.createDataFrame(labels, "date_label string")).orderBy("date")
