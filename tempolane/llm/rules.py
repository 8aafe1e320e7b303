"""Operator 3: quality rules with cross-document line frequency.

Base rules count words, symbols, repeated lines and repeated three-word windows of each whole text. The method itself works
across documents: lines are normalised (lower case, white space squeezed) and hashed; for each host (source) the distinct
documents of a line are counted; lines above the host's limit are removed; a document whose remaining words are too few a
share of all its words is depleted and rejected.

Exact copies of a document are one document for this count: it is known by the digest of its set of lines. Everything else counts
one by one, near copies too, so a page that is a template with few words of its own is counted, and rejected, like any other.

A line's limit is LINE_DOCS, the same number of documents for small and large hosts. A line that is frequent occurs once for each
of many documents, so line counts are pre-aggregated before the shuffle, and the lines with a great share of all rows, of which
there can only be few, are joined by broadcast.

Defined results: a null text has no words, so base_failed is true; a null source is a host of its own; null and repeated ids
are kept apart row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import join_facts, materialise, text_or_empty
from tempolane.llm.words import WordHasher, join_texts, window_hashes

#: A line is frequent in a host above this many distinct documents.
LINE_DOCS = 10
#: A document is depleted if less than this share of its words remains.
REMAINING_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]").search


def base_counts(texts: list[str], hasher: WordHasher) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each text."""
    data, starts = join_texts([t.encode() for t in texts])
    s, e = hasher.spans(data)
    owner = np.searchsorted(starts, s, side="right") - 1
    hashed = hasher.hashes(data, s, e)
    windows, at = window_hashes(hashed, owner, 3)
    repeated = np.zeros(len(s) + 2, bool)
    if len(windows):
        # Order by text, then by window; equal neighbours are windows found twice or more.
        order = np.lexsort((windows, owner[at]))
        w, o = windows[order], owner[at][order]
        same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        first = at[order[twice]]
        for k in range(3):
            repeated[first + k] = True
    n = len(texts)
    words = np.bincount(owner, minlength=n)
    repeat_words = np.bincount(owner, weights=repeated[: len(s)], minlength=n).astype(np.int64)
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    dup = np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        lines = list(filter(_HAS_WORD, t.split("\n")))
        dup[k] = len(lines) - len(set(lines))
    return [words, chars, symbols, dup, repeat_words]


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash of each normalised line with a word, and its number of words; a line that repeats is given each time."""
    hashes, sizes = [], []
    for line in text.lower().encode().split(b"\n"):
        parts = line.split()
        if parts:
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63))
            sizes.append(len(parts))
    return hashes, sizes


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, remaining_share: float = REMAINING_SHARE) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words."""
    id_type = dict(docs.dtypes)[id_col]
    schema = f"id {id_type}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<int>"

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at, texts in text_groups(batch.column(2).to_pylist()):
                base = [pa.array(x, pa.int64()) for x in base_counts(texts, hasher)]
                lines = [line_hashes(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *base, pa.array([x for x, _ in lines], pa.list_(pa.int64())), pa.array([x for _, x in lines], pa.list_(pa.int32()))],
                    names=["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes"],
                )

    measured = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
    # Texts are read once; from here on only numbers move. Row numbers keep equal and null ids apart.
    measured = materialise(measured.withColumn("row", F.monotonically_increasing_id()), "rules")
    page = F.xxhash64(F.array_sort(F.array_distinct("lines"))).alias("page")
    # A null host is one of its own.
    key = F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("host"), F.col("x.lines").alias("line")).alias("key")
    line = measured.select("row", "host", page, F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("row", "page", key, F.col("x.sizes").alias("words"))
    seen = line.groupBy("key", "page").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.count(F.lit(1)).alias("seen"), F.sum("rows").alias("rows"))
    frequent = materialise(seen.where(F.col("seen") > line_docs).select("key", "rows"), "rules-lines")
    total = measured.agg(F.sum(F.size("lines"))).first()[0] or 0
    removed = join_facts(line.drop("page"), frequent, "key", "rows", total).groupBy("row").agg(F.sum("words").alias("removed_words"))
    out = measured.drop("lines", "sizes").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < remaining_share * F.col("n_words")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words")
