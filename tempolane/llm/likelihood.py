"""Operator 9: language-model scores of a hidden Markov model over word classes, with an add-one unigram score beside it.

Work flows in chunks of documents (some megabytes of text). A chunk is written once as its dictionary of distinct words and
its tokens as places in that dictionary, so that words meet the corpus-wide counts once for each chunk instead of once for
each occurrence: a word that is everywhere has one row a chunk. Counts of training documents are summed in one shuffle over the
dictionaries.

The model: tokens are emitted as classes by hidden states, words by their classes. The TOP_WORDS most frequent training words
(count, then word) are classes of their own; other words share SUFFIX_CLASSES classes by their last two characters and have
the add-one share of their corpus count there, with one more outcome for all unseen words; the end of a text is a class. So
every word of the corpus has a probability of its own; the number of classes bounds only what the states tell apart, and is a
parameter.

Training starts from the corpus-wide class counts, disturbed for each state by a fixed seed, and takes rounds of Baum-Welch over
all training documents, each from its first to its last token; expected counts are summed across partitions. It ends when a
round gains less than SETTLED of the log likelihood, or after ``rounds``. Nothing depends on the order or partitioning of the
documents but the last digits of the sums. Scores are exact: the scaled forward recursion runs over each whole text.

Defined results: a null text counts as empty, one end token; a null id hashes as the empty text; repeated rows are learned
from and scored each time; without training documents all counts are 0 and classes are equally likely; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tempolane.llm.hmm import Layout, expect, forward, normalise, seeded
from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import fold, materialise, text_or_empty
from tempolane.llm.words import WordHasher, join_texts

STATES, TOP_WORDS, SUFFIX_CLASSES = 8, 2048, 256
#: Training ends when a round gains less than this share of the log likelihood; ROUNDS only stops a series that never settles.
ROUNDS, SETTLED = 100, 1e-3
#: Symbols of documents that a task takes at once (and one chunk).
GROUP_SYMBOLS = 2_000_000
CHUNK_CHARS = 6_000_000
#: Above so many chunks, words in more than HOT_CHUNKS of a sample of SAMPLE chunks are counted apart from the others.
SAMPLE, HOT_CHUNKS = 1000, 0.2
#: Dictionary entries whose counts are packed together.
PACK_ROWS = 1_000_000
#: Tasks that add up the expected counts of a round, and rows that reach the driver, at most.
SUMS = 16


def suffix_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % SUFFIX_CLASSES


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers as byte planes, of which the upper ones compress to little."""
    return np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def chunk_texts(texts: list[str], learn: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """starts (one for each text and the end), tokens, the dictionary, and each word's count in training texts."""
    raw = [t.encode().lower() for t in texts]  # bytes: lowers A-Z alone
    data, place = join_texts(raw)
    s, e = hasher.spans(data)
    owner = np.searchsorted(place, s, side="right") - 1
    _, first, token = np.unique(hasher.hashes(data, s, e), return_index=True, return_inverse=True)
    joined = data.tobytes()
    words = [joined[a:b].decode() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
    counts = np.bincount(token[learn[owner]], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
    return np.searchsorted(owner, np.arange(len(texts) + 1)), token, words, counts


def chunks(docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    id_type = dict(docs.dtypes)[id_col]
    schema = f"ids array<{id_type}>, held array<boolean>, starts array<int>, tokens binary, words array<string>, counts array<long>"

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at, texts in text_groups(batch.column(2).to_pylist(), CHUNK_CHARS):
                ids, held = batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts))
                starts, tokens, words, counts = chunk_texts(texts, ~held.to_numpy(zero_copy_only=False).astype(bool), hasher)
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(held)], held), one(starts.astype(np.int32), pa.int32()), pa.array([pack(tokens)], pa.binary()), one(words, pa.string()), one(counts.astype(np.int64), pa.int64())],
                    names=["ids", "held", "starts", "tokens", "words", "counts"],
                )

    chosen = docs.select(F.col(id_col), held_out.alias("_held"), text_or_empty(text_col).alias("_t"))
    return materialise(chosen.mapInArrow(run, schema).withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


def everyday_words(chunk: DataFrame, sample: int = SAMPLE) -> DataFrame | None:
    """Words that a great share of all chunks have, None where there are few chunks. Found in a sample of chunks: whether a word is
    among them decides where it is counted, not what comes out. At most 1 / HOT_CHUNKS dictionaries' worth."""
    n = chunk.count()
    if n <= 2 * sample:
        return None
    some = chunk.where(F.pmod(F.xxhash64("chunk"), F.lit(n // sample)) == 0)
    seen = some.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    return materialise(seen.where(F.col("k") > HOT_CHUNKS * some.count()).select("word"), "lm-everyday")


def corpus_counts(entry: DataFrame, everyday: DataFrame | None) -> DataFrame:
    """chunk, pos, c (the word's count in all chunks) and first: the word itself at its first place, if its count is not 0.

    Words meet in one shuffle with a row for each chunk that has them. Everyday words would have a row for every chunk: their sums
    are made in the tasks that read them, and come back by broadcast.
    """
    word = Window.partitionBy("word").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(Window.partitionBy("word").orderBy("chunk"))
    first = lambda own: F.when(own & (F.col("c") > 0), F.col("word")).alias("first")
    rest = entry if everyday is None else entry.join(F.broadcast(everyday), "word", "left_anti")
    out = rest.select("word", "chunk", "pos", F.sum("n").over(word).alias("c"), nth.alias("nth")).select("chunk", "pos", "c", first(F.col("nth") == 1))
    if everyday is None:
        return out
    hot = entry.join(F.broadcast(everyday), "word", "left_semi")
    sums = hot.groupBy("word").agg(F.sum("n").alias("c"), F.min("chunk").alias("least"))
    return out.unionByName(hot.join(F.broadcast(sums), "word").select("chunk", "pos", "c", first(F.col("chunk") == F.col("least"))))


def looked_up(entry: DataFrame, top_words: int, everyday: DataFrame | None = None) -> DataFrame:
    """The corpus count of every word of every chunk's dictionary, packed by chunk; and sums for the model.

    Rows with a chunk hold places and counts of some of its words; rows without hold a partition's sums by suffix class and its
    most frequent words.
    """
    counted = corpus_counts(entry, everyday)
    names = ["chunk", "pos", "c", "tokens", "kinds", "words", "word_counts"]

    def run(batches):
        tokens, kinds, best = np.zeros(SUFFIX_CLASSES, np.int64), np.zeros(SUFFIX_CLASSES, np.int64), []
        held, size = [], 0

        def flush():
            chunk, pos, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((pos, chunk))
            chunk, pos, c = chunk[order], pos[order], c[order]
            cut = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            parts = list(zip(cut, [*cut[1:], len(chunk)], strict=True))
            rows = [pa.array(chunk[cut], pa.int64()), pa.array([pack(pos[i:j]) for i, j in parts], pa.binary()), pa.array([pack(c[i:j], 8) for i, j in parts], pa.binary())]
            return pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(cut), t) for t in (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())))], names=names)

        for batch in batches:
            c = batch.column(2).to_numpy()
            first = batch.column(3)
            here = np.flatnonzero(first.is_valid().to_numpy(zero_copy_only=False))
            words = first.take(pa.array(here)).to_pylist()
            classes = np.array([suffix_class(w) for w in words], np.int64)
            np.add.at(tokens, classes, c[here])
            np.add.at(kinds, classes, 1)
            best = heapq.nsmallest(top_words, [*best, *zip((-c[here]).tolist(), words, strict=True)])
            known = c > 0
            held.append((batch.column(0).to_numpy()[known], batch.column(1).to_numpy()[known], c[known]))
            size += len(held[-1][0])
            if size >= PACK_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary())), pa.array([tokens], pa.list_(pa.int64())), pa.array([kinds], pa.list_(pa.int64())), pa.array([[w for _, w in best]], pa.list_(pa.string())), pa.array([[-n for n, _ in best]], pa.list_(pa.int64()))],
            names=names,
        )

    return materialise(counted.mapInArrow(run, "chunk long, pos binary, c binary, tokens array<long>, kinds array<long>, words array<string>, word_counts array<long>"), "lm-counts")


def classify(chunk: pa.Table, found: pa.Table, n_tokens: int, n_words: int, rare_tokens: list[int], rare_words: list[int], ranks: dict[str, int], top_words: int) -> dict:
    """Base score, class sequence and within-class probability of the documents of one chunk."""
    row = {x: chunk.column(x)[0].as_py() for x in ("starts", "tokens", "words")}
    starts, tokens, words = np.array(row["starts"]), unpack(row["tokens"]), row["words"]
    count, top = np.zeros(len(words) + 1, np.int64), np.array([*(ranks.get(w, -1) for w in words), -1], np.int64)
    for pos, c in zip(found.column("pos").to_pylist(), found.column("c").to_pylist(), strict=True):
        count[unpack(pos)] = unpack(c, 8)
    count, top = count[:-1], top[:-1]
    suffix = np.array([suffix_class(w) for w in words], np.int64)
    rare = top < 0
    symbol = np.where(rare, top_words + suffix, top)
    total, kinds = np.array(rare_tokens)[suffix], np.array(rare_words)[suffix]
    inside = np.where(rare, np.log10((count + (count > 0)) + (count == 0)) - np.log10(total + kinds + 1), 0.0)
    base = np.log10((count + 1) / (n_tokens + n_words + 1))
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    per_text = lambda x: np.bincount(owner, weights=x[tokens], minlength=n)
    # The end symbol is put after each text's own.
    out = np.full(len(tokens) + n, top_words + SUFFIX_CLASSES, np.uint16)
    out[np.arange(len(tokens)) + owner] = symbol[tokens]
    return {"row": row, "base": per_text(base), "inside": per_text(inside), "known": per_text((count > 0).astype(float)), "n": np.diff(starts), "symbols": out.tobytes()}


def grouped(batches) -> Iterator[list[dict]]:
    """Rows (chunks) until their symbols are enough: long documents of several chunks run side by side."""
    rows, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            rows.append(batch.slice(k, 1).to_pylist()[0])
            size += len(rows[-1]["symbols"]) // 2
            if size >= GROUP_SYMBOLS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def sequences(rows: list[dict], training: bool) -> Layout:
    """The documents of some chunks, whole, or the training ones alone."""
    symbols, lengths = [], []
    for row in rows:
        own, length = np.frombuffer(row["symbols"], np.uint16), np.diff(row["starts"])
        if training:
            keep = ~np.array(row["held"], bool)
            own, length = own[np.repeat(keep, length)], length[keep]
        symbols.append(own)
        lengths.append(length)
    return Layout(np.concatenate(symbols), np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64))))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, states: int = STATES, rounds: int = ROUNDS, top_words: int = TOP_WORDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = fold(id_col, 7) == 2 if held_out is None else held_out
    id_type, id_arrow = dict(docs.dtypes)[id_col], to_arrow_type(docs.schema[id_col].dataType)
    chunk = chunks(docs, id_col, text_col, held_out)
    entry = chunk.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("chunk", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    found = looked_up(entry, top_words, everyday_words(chunk))
    ends = chunk.select(F.explode("held").alias("h")).where("NOT h").count()
    # The most frequent words: bounded by top_words.
    def best_of(group: pd.DataFrame) -> pd.DataFrame:
        pairs = heapq.nsmallest(top_words, ((-n, w) for words, counts in zip(group["words"], group["word_counts"], strict=True) for w, n in zip(words, counts, strict=True)))
        return pd.DataFrame({"words": [[w for _, w in pairs]], "word_counts": [[-n for n, _ in pairs]]})

    lists = found.where("words IS NOT NULL").groupBy(F.pmod(F.xxhash64("words"), F.lit(SUMS))).applyInPandas(best_of, "words array<string>, word_counts array<long>").collect()
    top = [{"word": w, "c": -n} for n, w in heapq.nsmallest(top_words, ((-n, w) for r in lists for w, n in zip(r["words"], r["word_counts"], strict=True)))]
    ranks = {r["word"]: k for k, r in enumerate(top)}
    sums = [F.sum(F.element_at(x, k + 1)).alias(f"{x}{k}") for x in ("tokens", "kinds") for k in range(SUFFIX_CLASSES)]
    row = found.where("tokens IS NOT NULL").agg(*sums).first()
    rare_tokens, rare_words = ([row[f"{x}{k}"] or 0 for k in range(SUFFIX_CLASSES)] for x in ("tokens", "kinds"))
    n_tokens, n_words = sum(rare_tokens) + ends, sum(rare_words) + (ends > 0)
    for r in top:
        rare_tokens[suffix_class(r["word"])] -= r["c"]
        rare_words[suffix_class(r["word"])] -= 1
    end_base, end_known = float(np.log10((ends + 1) / (n_tokens + n_words + 1))), int(ends > 0)

    packed = found.where("chunk IS NOT NULL").select(F.col("chunk").alias("of"), "pos", "c")
    schema = f"chunk long, ids array<{id_type}>, held array<boolean>, starts array<int>, symbols binary, n array<long>, known array<long>, base array<double>, inside array<double>"

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        x = classify(left, right, n_tokens, n_words, rare_tokens, rare_words, ranks, top_words)
        row, n = x["row"], x["n"]
        columns = [left.column("chunk"), left.column("ids"), left.column("held"), pa.array([np.array(row["starts"], np.int32) + np.arange(len(n) + 1, dtype=np.int32)], pa.list_(pa.int32())), pa.array([x["symbols"]], pa.binary())]
        columns += [pa.array([v], pa.list_(t)) for v, t in ((n + 1, pa.int64()), (x["known"].astype(np.int64) + end_known, pa.int64()), (x["base"] + end_base, pa.float64()), (x["inside"], pa.float64()))]
        return pa.Table.from_arrays(columns, names=["chunk", "ids", "held", "starts", "symbols", "n", "known", "base", "inside"])

    coded = materialise(chunk.drop("counts").groupBy("chunk").cogroup(packed.groupBy("of")).applyInArrow(code, schema), "lm-coded")
    classes = np.array([r["c"] for r in top] + [0] * (top_words - len(top)) + rare_tokens + [ends], float)
    model = baum_welch(coded, classes, states, rounds)

    def score(batches):
        for rows in grouped(batches):
            total, at = forward(sequences(rows, training=False), *model), 0
            for row in rows:
                n = len(row["ids"])
                own = total[at : at + n] + np.array(row["inside"])
                at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], id_arrow), pa.array(row["held"], pa.bool_()), pa.array(row["n"], pa.int64()), pa.array(row["known"], pa.int64()), pa.array([n_tokens] * n, pa.int64()), pa.array(row["base"], pa.float64()), pa.array(own, pa.float64())],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(score, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def baum_welch(coded: DataFrame, classes: np.ndarray, states: int, rounds: int, trace: list | None = None):
    """Start, move and emit probabilities learned from the training documents; ``trace`` gets each round's log likelihood."""
    model = seeded((classes + 1) / (classes + 1).sum(), states)
    k, before = states, None
    for _ in range(rounds):
        now = model

        def count(batches, now=now):
            sums, chunk = None, 0
            for rows in grouped(batches):
                got = expect(sequences(rows, training=True), *now)
                flat = np.concatenate([got[0], got[1].ravel(), got[2].ravel(), [got[3]]])
                sums, chunk = flat if sums is None else sums + flat, rows[-1]["chunk"]
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["chunk", "sums"])

        def add(batches):
            sums = None
            for batch in batches:
                for x in batch.column("sums").to_pylist():
                    sums = np.frombuffer(x) + (0 if sums is None else sums)
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        counted = coded.select("chunk", "symbols", "starts", "held").mapInArrow(count, "chunk long, sums binary")
        parts = counted.repartition(SUMS, "chunk").mapInArrow(add, "sums binary").collect()
        if not parts:
            break
        total = np.sum(sorted((np.frombuffer(r["sums"]) for r in parts), key=lambda x: x[-1]), axis=0)
        model = normalise(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -1].reshape(len(classes), k))
        if trace is not None:
            trace.append(float(total[-1]))
        if before is not None and total[-1] - before < SETTLED * abs(before):
            break
        before = total[-1]
    return model
