"""Operator 11: importance resampling towards a target distribution, with weights from bit-sliced sums.

Features are runs of words hashed into BUCKETS buckets. What all documents and all target texts hold of each bucket gives a
bucket's gain, an integer. A document's weight is the sum of count times gain over its buckets, and that product of two vectors
is taken plane by plane: bit j of all its counts is one plane of BUCKETS bits, bit k of the magnitudes of all positive (or
negative) gains is another; the set bits of their AND, times 2**(j + k), is one term of the sum. Every term is an integer, so the
weight is exact whatever the order of documents.

Gumbel noise from a hash of the id turns weights into scores, of which the highest are drawn without replacement. Ranks come from
a range partitioning by score: each range counts its rows, and a rank is the rows of all earlier ranges plus the place in the own
one; only the numbers of rows of ranges reach the driver.

Defined results: a null or empty text has no feature and weight 0; a null id counts as the empty text in the hash and ranks after
other ids of one score; rows with one id are ranked each for itself; without target texts, or without documents, all counts of
that side are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import materialise, text_or_empty

BUCKETS = 10_000
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Percent of the eligible documents that are drawn.
PERCENT = 10
SEED = "2024"
#: Documents whose planes are held at once.
BLOCK = 256
#: Words with more bytes are hashed one by one, others by position.
SHORT = 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: 0-9, a-z and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data``: one step per byte position for all short spans together."""
    length = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    short = np.flatnonzero(length <= SHORT)
    # The longest spans first, so that those still running are a prefix.
    short = short[np.argsort(-length[short], kind="stable")]
    running = np.searchsorted(-length[short], -np.arange(SHORT + 1), side="left")
    for at in range(SHORT):
        live = short[: running[at]]
        if not len(live):
            break
        now = state[live]
        state[live] = (now >> np.uint32(8)) ^ _CRC[(now ^ data[starts[live] + at]) & np.uint32(255)]
    out = ~state
    for k in np.flatnonzero(length > SHORT):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def features(texts: list[str], longest_run: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and bucket of every feature of all texts, and each text's number of words."""
    raw = [t.encode() for t in texts]
    starts_of = np.cumsum([0, *(len(x) + 1 for x in raw)])
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    inside = np.concatenate(([False], _WORD[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(starts_of, starts, side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    owners, hashes = [owner], [crc32_of_spans(data, starts, ends)]
    for run in range(2, longest_run + 1):
        at = np.flatnonzero(owner[: max(0, len(owner) - run + 1)] == owner[run - 1 :])
        words = [[data[starts[k + j] : ends[k + j]].tobytes() for j in range(run)] for k in at]
        owners.append(owner[at])
        hashes.append(np.array([zlib.crc32(b" ".join(w)) for w in words], np.uint32))
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64), n_words


def planes(values: np.ndarray) -> np.ndarray:
    """The bits of non-negative integers, one row of 64-bit words for each place: (..., n) gives (..., places, words)."""
    places = max(1, int(values.max(initial=0)).bit_length())
    width = -(-values.shape[-1] // 64) * 64
    bits = (values[..., None, :] >> np.arange(places)[:, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")
    room = np.zeros((*packed.shape[:-1], width // 8), np.uint8)
    room[..., : packed.shape[-1]] = packed
    return room.view("<u8")


def weights(owner: np.ndarray, bucket: np.ndarray, n: int, gain_planes: tuple[np.ndarray, np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """Sum of gains over the features of each of ``n`` documents, by AND and popcount of planes."""
    out = np.zeros(n, np.int64)
    key, counts = np.unique(owner * buckets + bucket, return_counts=True)
    doc, place = key // buckets, key % buckets
    for first in range(0, n, BLOCK):
        mine = slice(*np.searchsorted(doc, (first, first + BLOCK)))
        held = counts[mine]
        for j in range(int(held.max(initial=0)).bit_length()):
            # One plane of each document of the block: bit j of its counts.
            at = np.flatnonzero((held >> j) & 1)
            rows, row = np.unique(doc[mine][at] - first, return_inverse=True)
            plane = np.zeros((len(rows), -(-buckets // 64) * 8), np.uint8)
            spot = place[mine][at]
            np.bitwise_or.at(plane, (row, spot >> 3), np.left_shift(1, spot & 7).astype(np.uint8))
            words = plane.view("<u8")
            for sign, gains in zip((1, -1), gain_planes, strict=True):
                for k, gain in enumerate(gains):
                    ones = np.bitwise_count(words & gain).sum(1, dtype=np.int64)
                    out[first + rows] += sign * (ones << (j + k))
    return out


def bucket_totals(texts: DataFrame, text_col: str = "text", longest_run: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: summed in each task, then by bucket; ``buckets`` rows reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, group in text_groups(batch.column(0).to_pylist()):
                total += np.bincount(features(group, longest_run, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    summed = texts.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log ratio of its add-one shares, rounded down."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def ranked(rows: DataFrame, order: list, total: int) -> DataFrame:
    """``rows`` with ``place`` (1, 2, 3 ... in ``order``), without a task that sees them all.

    Rows go to ranges of the order, are sorted inside and written; a row's place is the number of rows in earlier ranges, which
    the driver sums from one row a range, plus its place in its own.
    """
    ranges = max(1, min(-(-total // 1_000_000), 100_000), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranks").withColumn("_range", F.shiftright("_at", 33))  # the id has its partition above 33 bits of the place inside
    before, offsets = 0, []
    for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["n"]
    spark = rows.sparkSession
    offset = F.broadcast(spark.createDataFrame(offsets, "_range long, _before long"))  # one row a range: at most 100,000
    return dealt.join(offset, "_range").withColumn("place", F.col("_before") + (F.col("_at") - F.shiftleft("_range", 33)) + 1).drop("_at", "_range", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, longest_run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null where it is not drawn)."""
    gain = gains(bucket_totals(docs, text_col, longest_run, buckets), bucket_totals(target, target_col, longest_run, buckets))
    signed = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for at, texts in text_groups(batch.column(1).to_pylist()):
                owner, bucket, n_words = features(texts, longest_run, buckets)
                n = len(texts)
                columns = [np.bincount(owner, minlength=n), weights(owner, bucket, n, signed, buckets), n_words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(x.astype(np.int64)) for x in columns)], names=["id", "n_features", "weight", "n_words"])

    measured = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_features long, weight long, n_words long")
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296)))
    scored = materialise(measured.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "resampling")
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    drawn = percent * n // 100
    placed = ranked(eligible, [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], n) if n else eligible.withColumn("place", F.lit(0).cast("long"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(rest)
