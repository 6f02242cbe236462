"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space, \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a folder of our own only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rolltrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that :func:`materialise` wrote and nothing has released.
_written: list[str] = []


def written() -> list[str]:
    """The tables written so far and not released."""
    return list(_written)


def release(paths: list[str], still_read: DataFrame) -> list[str]:
    """Delete those tables of ``paths`` of which ``still_read`` reads no file; return the others. Results
    that read a deleted table must have been written before."""
    spark = still_read.sparkSession
    read = still_read.inputFiles()
    kept = [p for p in paths if any(f"/{p.rsplit('/', 1)[1]}/" in x for x in read)]
    for path in set(paths).difference(kept):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        if path in _written:
            _written.remove(path)
    return kept


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the
    lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken``, whatever its case."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once: a lambda's variable is never
    copied into the places where it is used, as the optimizer does with a column."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once per row: filters on it stay above the
    generator instead of being pushed down with a copy of ``value`` each."""
    return df.select("*", F.explode(F.array(value)).alias(name))


#: Rows that a worker takes from an Arrow batch at once, so that it never has thousands of long texts as objects.
BATCH_ROWS = 500


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a number for every row, in a column whose name is free, and that name. Written out,
    so that a row keeps its number whatever is computed again."""
    rid = free_name("rid", df.columns)
    return materialise(df.withColumn(rid, F.monotonically_increasing_id()), name), rid


#: Keys that one :func:`by_hot_and_cold` may call hot.
HOT_KEYS = 4096


def by_hot_and_cold(rows: DataFrame, groups: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, ``n`` rows of ``rows`` each) on ``key``.

    Keys that hold more than ``total / HOT_KEYS`` rows go by broadcast, so their rows stay where they
    are: there are at most HOT_KEYS of them, whatever the data. All others are shuffled, and
    none of these fills a task."""
    least = total // HOT_KEYS
    hot, cold = groups.filter(F.col(n) > least), groups.filter(F.col(n) <= least)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(names, key, "left_anti").join(cold, key))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
