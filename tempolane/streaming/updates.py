"""Merges of a stream of updates into a versioned table, batch by batch.

A batch writes the next version of the table whole; the version's number is the batch's, so a batch that runs again after a
failure writes the same version again, and readers see the last complete one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tempolane.operators.merging import latest, upsert


def current(spark: SparkSession, table: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The last complete version of the table (before a batch), or an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(n.removeprefix("version=")) for n in found if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{table}/version={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def merge_stream(updates: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: str, keep_when_null: Sequence[str] = ()) -> StreamingQuery:
    """Upsert a stream of rows by key: of a batch's rows of one key the last in ``order`` counts. Runs what is available, then
    stops."""

    def merge(batch: DataFrame, number: int) -> None:
        newest = latest(batch, keys, [F.desc(order)])
        upsert(current(batch.sparkSession, table, batch.schema, number), newest, keys, keep_when_null).write.mode("overwrite").parquet(f"{table}/version={number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
