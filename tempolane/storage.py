"""Tables that several queries of one application share, written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tempolane-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where the session names none, a local one, and an error unless all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def parts(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes but much work, which would else be joined into few tasks by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, so that loops and reuse don't recompute."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from the tables in ``source``: written at its first use in an application, then read.

    The tables in ``source`` are taken as fixed while the application runs.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STORED:
        df = build()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
