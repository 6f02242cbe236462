"""Snapshots that arrive as files: compare each with the one before it as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import changes_report
from ..operators.match import exact_match, id_match
from ..plans.audit import exists, match_none


def watch(spark: SparkSession, source: str, schema, state: str, reports: str, ids: list[str], fields: list[str], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of new files in ``source`` is a snapshot: it is matched by id against the last
    one, kept under ``state``, and a report of the changes is appended to ``reports``."""

    def arrive(df: DataFrame, epoch: int) -> None:
        current = f"{state}/{epoch:09d}"
        df.write.mode("overwrite").parquet(current)
        before = f"{state}/{epoch - 1:09d}"
        if epoch and exists(spark, before):
            inter = id_match(exact_match(spark.read.parquet(before), spark.read.parquet(current)), ids, on_unbalanced="demote")
            changes_report(match_none(inter), fields, date_origin=str(epoch)).write.mode("overwrite").parquet(f"{reports}/epoch={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(arrive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
