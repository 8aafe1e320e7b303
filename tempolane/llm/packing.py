"""Operator 4: conflict-constrained best-fit packing of documents into training sequences.

A sequence (bin) holds ``capacity`` tokens; each document costs its tokens and one end token. Documents longer than a bin give
full bins of their own and a rest, which is packed like a document, so that no token is lost. Within a shard documents go in
order of size, longest first, each into the tightest bin that has room and no conflict: bins are kept in order of their room,
and the search starts at the successor of the size and goes on until a compatible bin is found. Every bin carries a bitmap of
its sources and one of its duplicate clusters; a document conflicts with a bin that holds its cluster already or, if its source
has reached ``per_source`` documents in the bin, its source.

Shards are hashes of the ids and hold SHARD_DOCS documents on average, so neither a hot source nor a large cluster decides
the size of a group; the packing of a shard depends on its own rows alone. An id with more than HOT_ROWS rows (null ids are one
id) is dealt over the shards row by row. Clusters are equal texts but for case and white space, or a column that names them, such
as the classes of near duplicates.

Defined results: a null text counts as empty and costs its end token; a null source or cluster never conflicts; repeated rows
are packed each time; ties in size go to the lower id, ties in room to the older bin; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.counting import counter
from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import HOT_SHARE, materialise, text_or_empty

CAPACITY, SHARD_DOCS, PER_SOURCE = 8192, 20_000, 8
#: Rows of one id that share a shard, at most.
HOT_ROWS = 1000


class Bins:
    """Open bins of one shard in order of (room, age), with their bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def put(self, size: int, source: int | None, cluster: int | None) -> int:
        """Number of the bin that takes the document."""
        at = bisect_left(self.order, (size, -1))
        for k in range(at, len(self.order)):
            room, b = self.order[k]
            if cluster is not None and self.clusters[b] >> cluster & 1:
                continue
            if source is not None and self.sources[b][-1] >> source & 1:
                continue
            del self.order[k]
            break
        else:
            b, room = len(self.used), self.capacity
            self.used.append(0)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        self.used[b] += size
        if cluster is not None:
            self.clusters[b] |= 1 << cluster
        if source is not None:
            # The k-th bitmap has the sources with more than k documents in the bin.
            for k in range(self.per_source):
                if not self.sources[b][k] >> source & 1:
                    self.sources[b][k] |= 1 << source
                    break
        if room > size:
            insort(self.order, (room - size, b))
        return b


def pack(items: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int]]:
    """(piece, bin, tokens) of each piece of the items (tokens, source, cluster), in the order given; also used by tests."""
    bins, names = Bins(capacity, per_source), ({}, {})
    full, out = 0, []
    for size, source, cluster in items:
        pieces = []
        while size > capacity:
            full += 1
            pieces.append((len(pieces), -full, capacity))
            size -= capacity
        bits = [None if x is None else d.setdefault(x, len(d)) for x, d in zip((source, cluster), names, strict=True)]
        pieces.append((len(pieces), bins.put(size, *bits), size))
        out.append(pieces)
    return out


def squeezed_hash(text: str) -> int | None:
    """Hash of the words in lower case; None without a word."""
    words = text.lower().split()
    return xxhash.xxh3_64_intdigest(" ".join(words).encode()) - (1 << 63) if words else None


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, source_col: str, cluster_col: str | None) -> DataFrame:
    """id, source, cluster and tokens (with the end token) of each document; the cluster is the hash of the squeezed text, or of
    ``cluster_col``."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        encoding = counter(ranks_path, pattern).encoding
        for batch in batches:
            for at, texts in text_groups(batch.column(2).to_pylist()):
                counts = pa.array([len(encoding.encode_to_numpy(t, disallowed_special=())) + 1 for t in texts], pa.int64())
                cluster = batch.column(3).slice(at, len(texts)) if cluster_col else pa.array([squeezed_hash(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), cluster, counts], names=["id", "source", "cluster", "tokens"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("t"), *([F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col)).alias("c")] if cluster_col else []))
    return chosen.mapInArrow(run, f"id {id_type}, source string, cluster long, tokens long")


def best_fit(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_docs: int = SHARD_DOCS, cluster_col: str | None = None) -> DataFrame:
    """One row per piece: id, piece, bin_id, tokens, bin_tokens (all tokens of the bin), oversize (a full bin of one document)."""
    counted = token_counts(docs, ranks_path, pattern, id_col, text_col, source_col, cluster_col)
    counted = materialise(counted.withColumn("row", F.monotonically_increasing_id()), "pack-counts")
    total = counted.count()
    shards = max(1, -(-total // shard_docs))
    id_type = dict(docs.dtypes)[id_col]
    # Few by the bound: an id is hot above a share of all rows.
    hot = F.broadcast(counted.groupBy(F.col("id").alias("h_id")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > max(HOT_ROWS, HOT_SHARE * total)))
    dealt = counted.join(hot, F.col("id").eqNullSafe(F.col("h_id")), "left")
    sharded = dealt.withColumn("shard", F.pmod(F.xxhash64("id", F.when(F.col("times").isNotNull(), F.col("row"))), F.lit(shards))).drop("h_id", "times", "row")

    def group(key, rows):
        rows = rows.sort_by([("tokens", "descending"), ("id", "ascending"), ("cluster", "ascending")])
        ids, tokens, sources, clusters = (rows.column(x).to_pylist() for x in ("id", "tokens", "source", "cluster"))
        packed = pack(list(zip(tokens, sources, clusters, strict=True)), capacity, per_source)
        flat = [(i, piece, b, n) for i, pieces in zip(ids, packed, strict=True) for piece, b, n in pieces]
        frame = pd.DataFrame(flat, columns=["id", "piece", "bin", "tokens"], dtype=object)
        used = frame.groupby("bin")["tokens"].sum()
        shard = key[0].as_py()
        names = [f"{shard}-{'full' if b < 0 else 'bin'}-{abs(b)}" for b in frame["bin"]]
        return pa.Table.from_arrays(
            [pa.array(frame["id"].tolist(), rows.column("id").type), pa.array(frame["piece"].tolist(), pa.int32()), pa.array(names, pa.string()), pa.array(frame["tokens"].tolist(), pa.int64()), pa.array([int(used[b]) for b in frame["bin"]], pa.int64()), pa.array([b < 0 for b in frame["bin"]], pa.bool_())],
            names=[id_col, "piece", "bin_id", "tokens", "bin_tokens", "oversize"],
        )

    schema = f"`{id_col}` {id_type}, piece int, bin_id string, tokens long, bin_tokens long, oversize boolean"
    return sharded.groupBy("shard").applyInArrow(group, schema)
