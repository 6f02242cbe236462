"""Snapshot pairs made of the driver's tables, in SQL that Spark and the oracle share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import Match

SNAPSHOT_A = """
SELECT c.c_custkey AS voter_id, concat('AF', cast(100000 + c.c_custkey AS varchar(20))) AS aff_number, p.p_name AS full_name,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE concat('(714)555-', cast(1000 + c.c_custkey % 9000 AS varchar(20))) END AS phone,
       n.n_name AS city, cast((c.c_custkey * 7919) % 20000 AS bigint) AS dob_days, c.c_mktsegment AS party
FROM {customer} c JOIN {part} p ON p.p_partkey = c.c_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey"""

_CHANGED = """
SELECT CASE WHEN voter_id % 20 = 5 THEN voter_id + 1000000 ELSE voter_id END AS voter_id,
       CASE WHEN voter_id % 20 IN (5, 6) THEN concat('NEW', aff_number) ELSE aff_number END AS aff_number,
       CASE WHEN voter_id % 20 IN (3, 5) THEN concat(substring(full_name, 1, 2), substring(full_name, 4, 60)) ELSE full_name END AS full_name,
       CASE WHEN voter_id % 20 = 1 THEN NULL WHEN voter_id % 20 = 7 THEN '(949)555-0000' ELSE phone END AS phone,
       city, dob_days, CASE WHEN voter_id % 20 = 2 THEN 'OTHER' ELSE party END AS party
FROM {a} WHERE voter_id % 20 <> 0"""

_ADDED = """
UNION ALL
SELECT 2000000 + s_suppkey, concat('AF9', cast(s_suppkey AS varchar(20))), s_name, NULL, 'NOWHERE', cast(s_suppkey AS bigint), 'NEW'
FROM {supplier}"""

SNAPSHOT_B = _CHANGED + _ADDED

#: A third day: some of B moves, some is gone.
SNAPSHOT_C = """
SELECT voter_id, aff_number, full_name, phone, CASE WHEN voter_id % 20 = 11 THEN 'MOVED' ELSE city END AS city, dob_days, party
FROM {b} WHERE voter_id % 20 <> 12"""

#: A match with every kind of fault that the repairs are for: (a_id, b_id) pairs and both unmatched sides.
PAIRS = """
SELECT a.voter_id AS a_id, b.voter_id AS b_id FROM {a} a JOIN {b} b
ON b.voter_id = CASE WHEN a.voter_id % 20 IN (1, 6) THEN a.voter_id WHEN a.voter_id % 40 = 2 THEN a.voter_id + 20 WHEN a.voter_id % 40 = 22 THEN a.voter_id - 20
                     WHEN a.voter_id % 20 = 7 THEN a.voter_id + 1 WHEN a.voter_id % 20 = 9 THEN a.voter_id - 3 END"""
ONLY_A = "SELECT voter_id AS id FROM {a} WHERE voter_id % 20 IN (0, 3, 5, 8)"
ONLY_B = "SELECT voter_id AS id FROM {b} WHERE voter_id % 20 IN (3, 7, 9) OR voter_id >= 1000000"
#: All other rows of both sides are matched by their id.
ID_PAIRS = """
SELECT a.voter_id AS a_id, b.voter_id AS b_id FROM {a} a JOIN {b} b ON a.voter_id = b.voter_id
WHERE a.voter_id % 20 = 4 OR a.voter_id % 20 >= 10"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def snapshots(spark: SparkSession, sf_dir: str, added: bool = True) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, sf_dir, "customer", "part", "nation", "supplier")
    a = spark.sql(SNAPSHOT_A, customer=t["customer"], part=t["part"], nation=t["nation"])
    return a, spark.sql(SNAPSHOT_B, a=a, supplier=t["supplier"]) if added else spark.sql(_CHANGED, a=a)


def third(spark: SparkSession, b: DataFrame) -> DataFrame:
    return spark.sql(SNAPSHOT_C, b=b)


def faulty_match(spark: SparkSession, sf_dir: str) -> Match:
    a, b = snapshots(spark, sf_dir)
    keys = {k: spark.sql(sql, **{s: df for s, df in (("a", a), ("b", b)) if f"{{{s}}}" in sql}) for k, sql in (("p", PAIRS), ("ip", ID_PAIRS), ("oa", ONLY_A), ("ob", ONLY_B))}
    whole = lambda df, s: df.select(F.struct(*df.columns).alias(s))
    pairs, id_pairs = (
        keys[k].join(whole(a, "a"), F.col("a_id") == F.col("a.voter_id")).join(whole(b, "b"), F.col("b_id") == F.col("b.voter_id")).select("a", "b")
        for k in ("p", "ip")
    )
    one = lambda df, k: df.join(keys[k], F.col("voter_id") == F.col("id"), "left_semi")
    return Match(a.limit(0), id_pairs, pairs, one(a, "oa"), one(b, "ob"))


def oracle_views() -> str:
    """The fixtures as the first members of a WITH clause."""
    plain = {n: n for n in ("customer", "part", "nation", "supplier", "a", "b")}
    parts = {"a": SNAPSHOT_A, "b": SNAPSHOT_B, "c": SNAPSHOT_C, "p": PAIRS, "ip": ID_PAIRS, "oa": ONLY_A, "ob": ONLY_B}
    return ", ".join(f"{k} AS ({v.format(**plain)})" for k, v in parts.items())


def saved_days(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Three cleaned snapshots in ``folder``; their catalogue."""
    a, b = snapshots(spark, sf_dir)
    for label, df in (("d1", a), ("d2", b), ("d3", third(spark, b))):
        df.write.parquet(f"{folder}/clean/df_cleaned_{label}.parquet")
    return spark.createDataFrame([(f"2024-01-0{k}", f"d{k}") for k in (1, 2, 3)], "date string, date_label string")


def raw_file(df: DataFrame, folder: str, name: str, header: bool) -> None:
    """``df`` as one tab-separated file."""
    spark = df.sparkSession
    df.coalesce(1).write.csv(f"{folder}/parts-{name}", sep="\t", header=header, quote="", escape="", encoding="ISO-8859-1", emptyValue="")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(f"{folder}/parts-{name}")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
