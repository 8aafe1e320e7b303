"""Shared-folder tables and small column helpers used by the corpus operators.

Everything that must outlive an executor is written to the folder named by ``spark.checkpoint.dir``; a folder of our own is
made only where that setting is absent (tests, a laptop). The session's settings are never changed for good.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Lists that note the tables made while they are open; see :func:`noted`.
_OPEN: list[list[str]] = []


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tempolane-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, a local one, and an error unless all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes its rows against recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """Notes the tables that are made inside, so that the caller can delete just these when nothing reads them any more."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables in the shared folder."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows inside: several stages share a worker's and an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that are sent to all executors to filter documents by (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: A key with more than this share of all rows is hot; there are at most as many hot keys as the share's inverse.
HOT_SHARE = 1e-5


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per key, never null), where ``size`` says how many rows a key has.

    A key with a great share of the rows would all come to one task, so hot keys are joined by broadcast: at most 1 / HOT_SHARE
    of them can exist, whatever the data. All other keys are joined by a shuffle.
    """
    hot = facts.where(F.col(size) > HOT_SHARE * total)
    if total <= 1 / HOT_SHARE:  # too few rows for any task to be large
        return rows.join(facts, key)
    many = F.broadcast(hot)
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(facts.where(F.col(size) <= HOT_SHARE * total), key))


def hashable(value: Column, kind: DataType) -> Column:
    """``value`` with every map, at any depth, as its entries in order: Spark hashes no maps, whose order means nothing."""
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(hashable(e["key"], kind.keyType).alias("key"), hashable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, ArrayType) and "map<" in kind.simpleString():
        return F.transform(value, lambda x: hashable(x, kind.elementType))
    if isinstance(kind, StructType) and "map<" in kind.simpleString():
        return F.when(value.isNotNull(), F.struct(*(hashable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return value


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_key``: the id and a 128-bit hash of all columns. Rows with one key are equal in every column."""
    columns = [hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields]
    # The first argument seeds the hash of all that follow.
    hashes = [F.xxhash64(F.lit(seed), *columns, *(c.isNull() for c in columns)) for seed in (0, 1)]
    return docs.withColumn("_key", F.struct(F.col(id_col).alias("id"), hashes[0].alias("h1"), hashes[1].alias("h2")))


def keep_rows(docs: DataFrame, decisions: DataFrame, kept_col: str = "kept", single: bool = False) -> DataFrame:
    """The rows of ``docs`` (see :func:`keyed`) whose own decision is to keep them, without the key.

    A decision belongs to a row, not to an id: rows that share an id or have none are kept or dropped each for itself. Texts are
    not shuffled while the dropped rows are few. ``single``: of rows equal in every column one stays, which takes a shuffle only
    if such rows exist among the kept ones at all.
    """
    verdict = materialise(decisions.select(F.col("_key.h1").alias("_h1"), F.col("_key.h2").alias("_h2"), F.col(kept_col).cast("boolean").alias("_kept")), "decisions")
    by_key = verdict.groupBy("_h1", "_h2").agg(F.max("_kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    facts = by_key.agg(F.count(F.when(~F.col("_kept"), 1)).alias("dropped"), F.max(F.when(F.col("_kept"), F.col("_rows"))).alias("rows")).first()
    dropped = by_key.where(~F.col("_kept")).select("_h1", "_h2")
    if facts["dropped"] <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    out = docs.join(dropped, (docs["_key.h1"] == dropped["_h1"]) & (docs["_key.h2"] == dropped["_h2"]), "left_anti")
    return (out.dropDuplicates(["_key"]) if single and (facts["rows"] or 0) > 1 else out).drop("_key")
