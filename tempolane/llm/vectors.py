"""Operator 13: compression of vectors into codes of their parts, by Lloyd rounds over resident members.

A vector is cut into PARTS equal parts; each position has a codebook of ENTRIES entries. The parts, not the vectors, are the
members of an entry. They are dealt once to owners, an owner being a (position, entry, salt), and written. In a round the owners
sum up their resident members into new entries; then every member looks for its nearest entry where it is. Most stay: these are
written in place and are not shuffled again. Only the parts that change their entry are shuffled, to their new owners. At the
end the codes go back to their rows, with one partially aggregated sum of bytes for each row.

The salt is a hash of the row over as many values as let an owner hold OWNED members at most, even if one entry holds all parts
of its position. Codebooks are PARTS x ENTRIES short vectors whatever the input, and are the only thing that reaches the driver.

Arithmetic is on integers, so sums don't depend on the order of rows.

Defined results: a row whose vector is null or holds a null or non-finite component is dropped; components beyond LARGEST in
magnitude after scaling count as LARGEST; a vector shorter than the longest is taken as padded with zeros, and so is the longest
up to a multiple of PARTS; null ids come after all others, rows of one id by their components; a row that repeats is coded for
each repeat; with fewer kept rows than ENTRIES the codebooks have as many entries as there are rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.shared import delete, join_facts, materialise, scratch_path

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24
#: Members of one owner at most, on average over its entry's rows.
OWNED = 200_000
#: Members whose distances are held at once.
BLOCK = 8192

MEMBER = "row long, part int, member array<long>, entry int"


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties to the lower) and its squared distance."""
    index, error = np.zeros(len(values), np.int32), np.zeros(len(values), np.int64)
    for at in range(0, len(values), BLOCK):
        block = values[at : at + BLOCK]
        away = np.empty((len(block), len(book)), np.int64)
        for k, entry in enumerate(book):
            away[:, k] = np.square(block - entry).sum(1)
        index[at : at + BLOCK] = best = away.argmin(1)
        error[at : at + BLOCK] = away[np.arange(len(block)), best]
    return index, error


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """``members`` with ``nearest`` and ``error`` under the codebooks (parts x entries x width)."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_numpy()
            values = batch.column(2).flatten().to_numpy().reshape(len(part), width)
            index, error = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                index[mine], error[mine] = nearest(values[mine], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index), pa.array(error)], names=["row", "part", "member", "entry", "nearest", "error"])

    return members.select("row", "part", "member", "entry").mapInArrow(run, f"{MEMBER}, nearest int, error long")


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after the owners' sums: each entry the mean of its members rounded down; an entry without members stays."""
    out = books.copy()
    sums = [F.sum(F.col("member")[k]).alias(f"s{k}") for k in range(books.shape[2])]
    for r in members.groupBy("part", "entry").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(books.shape[2])]
    return out


def dealt(members: DataFrame, salts: int) -> DataFrame:
    """Members at their owners: one shuffle by position, entry and salt."""
    salt = F.pmod(F.xxhash64("row"), F.lit(salts))
    return members.repartition("part", "entry", salt).sortWithinPartitions("part", "entry")


def lloyd(members: DataFrame, books: np.ndarray, rounds: int, salts: int) -> tuple[DataFrame, np.ndarray]:
    """The members with their last ``nearest`` entry and ``error``, and the codebooks after ``rounds`` rounds."""
    spark = members.sparkSession
    first = assigned(members, books).select("row", "part", "member", F.col("nearest").alias("entry"))
    resident, moved, made = materialise(dealt(first, salts), "residents"), None, None
    for k in range(rounds):
        books = updated(resident, books)
        looked = assigned(resident, books)
        if k == rounds - 1:
            return looked, books
        # Stayers are written where they are; only those with another entry go through a shuffle.
        last, made = made, scratch_path(spark, "stay-or-move")
        looked.withColumn("moves", F.col("nearest") != F.col("entry")).write.partitionBy("moves").parquet(made)
        both = spark.read.schema(f"{MEMBER}, nearest int, error long, moves boolean").parquet(made)
        moved = materialise(dealt(both.where("moves").select("row", "part", "member", F.col("nearest").alias("entry")), salts), "moved")
        resident = both.where("NOT moves").select("row", "part", "member", "entry").unionByName(moved)
        if last:
            delete(spark, [last])
    return assigned(resident, books), books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owned: int = OWNED) -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256. At most 16 parts and 128 entries."""
    if not (1 <= parts <= 16 and 1 <= entries <= 128):
        raise ValueError("codes have at most 16 parts of at most 128 entries")
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v.cast("double") * SCALE))).cast("long"))
    rows = vectors.where(sound).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled.alias("ints")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ints")).alias("longest")).first()
    width = max(1, -(-(facts["longest"] or 0) // parts))
    padded = F.concat("ints", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("ints")))
    start = rows.select("id", padded.alias("ints")).orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    if not start:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = np.array([r["ints"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), F.slice("ints", p * width + 1, width).alias("member")))
    members = rows.select("row", padded.alias("ints")).select("row", F.explode(cut).alias("m")).select("row", "m.part", "m.member", F.lit(0).alias("entry"))
    last, books = lloyd(members, books, rounds, max(1, -(-facts["n"] // owned)))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def byte(first: int):
        """Eight parts' indexes as the bytes of a number, which sum up part by part."""
        mine = (F.col("part") >= first) & (F.col("part") < first + 8)
        return F.sum(F.when(mine, F.col("nearest").cast("long") * F.expr(f"shiftleft(1L, 8 * ({first + 7} - part))")).otherwise(F.lit(0).cast("long")))

    coded = last.groupBy("row").agg(byte(0).alias("high"), byte(8).alias("low"), F.sum("error").alias("error"))
    text = F.substring(F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("high", "low"))), 1, 2 * parts)
    coded = materialise(rows.select("row", "id", "label").join(coded, "row").select("id", F.concat_ws(":", F.col("label").isNull().cast("string"), F.col("label").cast("string")).alias("same"), text.alias("code"), "error"), "codes")
    by_label = coded.groupBy("same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    return join_facts(coded, by_label, "same", "size", facts["n"]).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
