"""Operator 7: exact deduplication with counting quotient filters and byte verification.

Each partition counts its fingerprints (the first 64 bits of the text's SHA-256) in quotient filters, one for each range of
quotients that occurs; filters of a range meet in one group, whose size is the number of distinct fingerprints of the range,
and merge without loss. Fingerprints that are counted more than once route their rows to verification, which groups by the
text's bytes themselves. All other rows are unique and are never shuffled.

Defined results: a null text counts as empty; a null id is lower than any other; a repeated row (same id, same text) is given
once for each repeat and only one of them is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.quotient import build, entries, merge, tally
from tempolane.llm.shared import join_facts, materialise, text_or_empty

#: Distinct fingerprints that a merged filter is to hold at most, on average.
PER_FILTER = 1_000_000
#: Repeated fingerprints that are sent to all executors (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def repeated_fingerprints(rows: DataFrame, n_rows: int, per_filter: int = PER_FILTER) -> DataFrame:
    """From a column fp (long): the fingerprints that occur in more than one row."""
    shard_bits = max(0, int(np.ceil(np.log2(max(1, n_rows / per_filter)))))

    def count(batches):
        held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        pending, size = [], 0

        def fold():
            parts = [held[0], *pending]
            counts = np.concatenate([held[1], np.ones(sum(map(len, pending)), np.int64)])
            held[0], held[1] = tally(np.concatenate(parts), counts)

        def filters():
            if not len(held[0]):
                return
            shard = (held[0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(held[0]), np.int64)
            bounds = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            # One frame for all ranges that a partition has now.
            made = [build(held[0][a:b], held[1][a:b]) for a, b in zip(bounds, [*bounds[1:], len(shard)], strict=True)]
            yield pd.DataFrame({"shard": shard[bounds], "filter": made})

        for batch in batches:
            pending.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            size += len(pending[-1])
            if size >= per_filter:
                fold()
                pending, size = [], 0
                if len(held[0]) >= per_filter:
                    yield from filters()
                    held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        fold()
        yield from filters()

    def join(_, group: pd.DataFrame) -> pd.DataFrame:
        found, counts = entries(merge(list(group["filter"])))
        return pd.DataFrame({"fp": found[counts > 1].view(np.int64)})

    return rows.select("fp").mapInPandas(count, "shard long, filter binary").groupBy("shard").applyInPandas(join, "fp long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id (largest id of the group), group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    hashed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    # Two's complement of the first 16 hex digits.
    half = lambda at: F.conv(F.substring("sha", at, 8), 16, 10).cast("long")
    hashed = hashed.withColumn("fp", F.shiftleft(half(1), 32).bitwiseOR(half(9)))
    # The small table of ids and digests is written once: texts are read again only for the rows that need verification.
    digests = materialise(hashed.select("id", "sha", "fp"), "exact-digests")
    n_rows = digests.count()
    repeated = materialise(repeated_fingerprints(digests, n_rows), "exact-repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    suspects = hashed.join(repeated, "fp", "left_semi")
    # Grouping by the text compares bytes; digests name the verified groups, and two texts under one name stop the run.
    by_text = suspects.groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = by_text.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    collision = F.raise_error(F.concat(F.lit("two texts with SHA-256 "), F.col("sha")))
    groups = groups.withColumn("group_size", F.when(F.col("texts") > 1, collision.cast("long")).otherwise(F.col("group_size"))).drop("texts")
    groups = materialise(groups, "exact-groups")  # read twice below, and made of texts
    copies = digests.join(repeated, "fp", "left_semi").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("rows"))
    # One text may be a great share of all rows.
    copies = join_facts(copies, groups, "sha", "group_size", n_rows).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    unique = digests.join(repeated, "fp", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    out = copies.select("id", "keep_id", "group_size", first.alias("kept"), "sha").unionByName(unique)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
