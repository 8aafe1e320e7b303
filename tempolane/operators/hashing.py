"""Content hashes: canonical rows, ordered row sets, cumulative chains, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from tempolane.operators.asof import asof_sums
from tempolane.operators.bootstrap import placed


def canonical_value(value: Column, kind: DataType) -> Column:
    """A value in canonical form at every depth: fields of structs and keys of maps in order, doubles as text."""
    if isinstance(kind, (DoubleType, FloatType)):
        out = F.format_string("%.17e", value.cast("double"))
    elif isinstance(kind, StructType):
        out = F.struct(*(canonical_value(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
    elif isinstance(kind, MapType):
        # Keys are text in JSON, so that is how they are ordered.
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), canonical_value(e["value"], kind.valueType).alias("value")))
        out = F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    elif isinstance(kind, ArrayType):
        out = F.transform(value, lambda x: canonical_value(x, kind.elementType))
    else:
        return value
    # format_string gives the text null for NULL, and a struct of NULLs is none.
    return F.when(value.isNotNull(), out)


def canonical(columns: Sequence[str], dtypes: dict[str, str]) -> Column:
    """Canonical JSON of a row: keys in order at every depth, NULLs kept, strings escaped, so that different rows have different
    texts and rows that differ only in the order of keys have one.

    Floating-point numbers are text with seventeen digits after the point, which no two different numbers share.
    """
    kept = [canonical_value(F.col(n), DataType.fromDDL(dtypes[n])).alias(n) for n in sorted(columns)]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(columns, dict(df.dtypes)), 256)


def fingerprints(df: DataFrame, key: Sequence[str], columns: Sequence[str], levels: Sequence[int] = (4, 2)) -> DataFrame:
    """For each key: number of rows and the hash of its row hashes in order; the order of the rows doesn't matter.

    Hashes meet in a fixed tree of their leading digits, so that a large key is never one long list: ``levels`` are the digits
    of each level from the leaves up. (6, 4, 2) keeps a leaf of ten billion rows below a thousand hashes.
    """
    level = df.select(*key, row_hash(df, columns).alias("h")).withColumns({"p": F.col("h"), "n": F.lit(1).cast("long")})
    for digits in levels:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
        level = level.groupBy(*key, F.substring("p", 1, digits).alias("q")).agg(F.sha2(F.concat_ws("\n", ordered), 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])
    return level.groupBy(*key).agg(F.sum("n").alias("row_count"), F.sha2(F.concat_ws("\n", ordered), 256).alias("fingerprint"))


def manifest(fingerprint: DataFrame, scope: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """For each scope: the hash of its parts' fingerprints in the parts' order, with the number of parts and rows."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*parts, "fingerprint"))), lambda x: x["fingerprint"])
    return fingerprint.groupBy(*scope).agg(F.count(F.lit(1)).alias("parts"), F.sum("row_count").alias("row_count"), F.sha2(F.concat_ws("\n", ordered), 256).alias("manifest"))


#: Parts below one node of an ordered fingerprint.
FAN = 1000


def ordered_fingerprints(df: DataFrame, scope: str, group: str, order: Sequence[str], columns: Sequence[str], levels: int = 2) -> DataFrame:
    """For each scope: groups, rows and a hash that keeps the order of groups and of rows inside them.

    A group's rows are one leaf, in ``order``. Groups are numbered through (``group`` is a whole number), FAN neighbours make a node,
    FAN nodes the next, and the last nodes the hash; so the same rows give the same hash however they are partitioned, a task
    holds FAN hashes, and any change of order shows. Two levels hold a scope of a billion groups under a thousand nodes.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, row_hash(df, columns).alias("_h")))), lambda x: x["_h"])
    leaf = df.groupBy(F.col(scope).alias("scope"), F.col(group).cast("long").alias("race_id")).agg(F.sha2(F.concat_ws("\n", lines), 256).alias("h"), F.count(F.lit(1)).alias("rows"))
    level = placed(leaf).select("scope", "place", "h", "rows", F.lit(1).cast("long").alias("groups"))
    for _ in range(levels):
        inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"])
        level = level.groupBy("scope", F.floor(F.col("place") / FAN).alias("node")).agg(F.sha2(F.concat_ws("\n", inside), 256).alias("h"), F.sum("rows").alias("rows"), F.sum("groups").alias("groups")).withColumnRenamed("node", "place")
    inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"])
    return level.groupBy(F.col("scope").alias(scope)).agg(F.sum("groups").alias("groups"), F.sum("rows").alias("row_count"), F.sha2(F.concat_ws("\n", inside), 256).alias("manifest"))


def chain(events: DataFrame, key: Sequence[str], order: Sequence[str], event_hash: str) -> DataFrame:
    """For each key: the hash of the previous hash and the event's, through all its events in order.

    A chain is sequential by definition, so a key's events are one array.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*order, event_hash)))
    folded = F.aggregate(ordered, F.lit(""), lambda a, x: F.sha2(F.concat(a, x[event_hash]), 256))
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("events"), folded.alias("chain"))


def input_hashes(targets: DataFrame, events: DataFrame, context: Sequence[str], subject: str = "player_id", id_col: str = "entry_id") -> DataFrame:
    """For each target: the hash of its context, that of its subject's events before the cutoff, and of both.

    The history's hash is the chain's state after the last event before the cutoff, so no target gathers its history: a subject's
    states are computed once, in one pass over its events in order, and looked up by the number of events.
    """

    def states_of(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = "", []
        for own in frame.sort_values(["start_at", "race_id", id_col])["h"]:
            state = hashlib.sha256((state + own).encode()).hexdigest()
            out.append(state)
        return pd.DataFrame({subject: frame[subject].iloc[0], "events": range(1, len(out) + 1), "history_hash": out})

    past = events.where(F.col(subject).isNotNull()).select(subject, "start_at", "race_id", id_col, "h")
    states = past.groupBy(subject).applyInPandas(states_of, f"{subject} {dict(events.dtypes)[subject]}, events long, history_hash string")
    seen = asof_sums(targets, events, [subject], {"n": F.lit(1)}, [None])
    own = targets.select(id_col, subject, row_hash(targets, context).alias("context_hash")).join(seen, id_col, "left").withColumn("events", F.coalesce("n_all", F.lit(0.0)).cast("long"))
    out = own.join(states, [subject, "events"], "left").withColumn("history_hash", F.coalesce("history_hash", F.lit("")))
    return out.select(id_col, "context_hash", "events", "history_hash", F.sha2(F.concat("context_hash", "history_hash"), 256).alias("input_hash"))


def drift(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose fingerprint differs, appears or vanishes between two tables of fingerprints."""
    b, a = (x.select(*key, F.col("fingerprint").alias(n)) for x, n in ((before, "old"), (after, "new")))
    joined = b.join(a, list(key), "full_outer")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("CHANGED"))
