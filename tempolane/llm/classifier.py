"""Operator 6: quality classifier, a linear-chain conditional random field over the lines of a text.

Every line with a word is labelled good or bad from its own features (shares of kinds of characters, word counts and lengths,
repetition inside the line and in the text, function words) and those of the lines before and after it. A text's score is the
mean, weighted by characters, of its lines' marginal probabilities of being good, by forward-backward over the whole text.

The field is fitted on a bounded sample of the labelled rows whose fold is not held out: in order of the id's hash, TRAIN_DOCS
rows at most, each with all its lines, while their lines together are TRAIN_LINES at most (a row that would exceed this is left
out of the sample as a whole). Every line of every text is scored. Labels, language, source and ids are never inputs of a score.

Defined results: a null text counts as empty; a text without words has score 0; null ids belong to the fold of the empty
text and are never learned from; a null or repeated label row is ignored or used once each; without labels of both kinds every
score with a word is 0.5; repeated rows are repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.crf import fit, marginals
from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import fold, materialise, text_or_empty
from tempolane.llm.words import WordHasher, join_texts, mix, window_hashes

#: Labelled rows of the sample, and lines of all of them together, at most.
TRAIN_DOCS, TRAIN_LINES = 4000, 200_000
ROUNDS, PENALTY = 300, 1e-5
THRESHOLD = 0.3
#: Common function words of the languages at hand.
FUNCTION_WORDS = "the of and to in a is that for on was with be it as de la el en que los las un una y por con se les et des le du est der die das und zu den von ist mit im ein eine".split()
_KINDS = 10


def _kinds() -> np.ndarray:
    """Kind of each code point below 0x3000: 0 other, 1 space, 2 lower, 3 upper, 4 digit, 5 symbol, 6 ! or ?, 7 stop, 8 other mark."""
    table = np.zeros(0x3000, np.uint8)
    for code in range(0x3000):
        ch = chr(code)
        table[code] = 1 if ch.isspace() else 3 if ch.isupper() else 2 if ch.isalpha() else 4 if ch.isdigit() else 5 if ch in "#*$%&|<>" else 6 if ch in "!?" else 7 if ch in ".,;:" else 8 if code < 128 else 0
    table[10] = 9
    return table


class LineFeatures:
    """Features of the lines with a word of many texts."""

    def __init__(self):
        self.hasher, self.kinds = WordHasher(), _kinds()
        raw = [w.encode() for w in FUNCTION_WORDS]
        data, place = join_texts(raw)
        self.function = np.sort(self.hasher.hashes(data, *self.hasher.spans(data)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts of each text's lines, the features (one row a line), and each line's characters."""
        lower = [t.lower().encode() for t in texts]
        data, place = join_texts(lower)
        line_at = np.concatenate(([0], np.cumsum(data == 10)))
        n_lines = int(line_at[-1])
        first_line = line_at[place[:-1]]
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 0x3000, self.kinds[np.minimum(codes, 0x2FFF)], 0)
        own = np.concatenate(([0], np.cumsum(kind[:-1] == 9)))
        kinds = np.bincount(own * _KINDS + kind, minlength=n_lines * _KINDS)[: n_lines * _KINDS].reshape(n_lines, _KINDS).astype(float)
        chars = kinds[:, :9].sum(1)
        s, e = self.hasher.spans(data)
        words = self.hasher.hashes(data, s, e)
        line = line_at[s]
        per = lambda w=None: np.bincount(line, weights=w, minlength=n_lines)
        count = per()
        # Words that stand earlier in their line.
        order = np.lexsort((words, line))
        again = np.zeros(len(words))
        if len(words):
            again[order[1:]] = (words[order][1:] == words[order][:-1]) & (line[order][1:] == line[order][:-1])
        text = np.searchsorted(first_line, line, side="right") - 1
        windows, at = window_hashes(words, text, 3)
        repeated = np.zeros(len(words) + 2)
        if len(windows):
            order = np.lexsort((windows, text[at]))
            same = (windows[order][1:] == windows[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
            repeated[at[order[1:][same]]] = 1
        function = np.isin(words, self.function) if len(words) else np.zeros(0)
        # Lines that stand earlier in their text.
        start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        name = np.add.reduceat(mix(words + (np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))).astype(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
        with_word = line[start]
        owner = np.searchsorted(first_line, with_word, side="right") - 1
        order = np.lexsort((name, owner))
        earlier = np.zeros(len(start))
        if len(start):
            earlier[order[1:]] = (name[order][1:] == name[order][:-1]) & (owner[order][1:] == owner[order][:-1])

        k, c, w = kinds[with_word], np.maximum(chars[with_word], 1), count[with_word]
        letters = np.maximum(k[:, 2] + k[:, 3] + k[:, 0], 1)
        share = lambda x: x / c
        base = [
            share(k[:, 5]), share(k[:, 6]), k[:, 3] / letters, share(k[:, 4]), share(k[:, 8]), share(k[:, 7]), letters / c,
            np.log1p(w) / 5, c / w / 10, per(again)[with_word] / w, per(repeated[: len(words)])[with_word] / w, per(function)[with_word] / w, earlier,
        ]
        cut = [share(k[:, 5]) > 0.02, share(k[:, 5]) > 0.1, share(k[:, 6]) > 0.05, k[:, 3] / letters > 0.3, w < 4, base[9] > 0.5, base[10] > 0.3, base[11] < 0.02]
        one = np.column_stack([*base, *(x.astype(float) for x in cut)])
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        size = np.diff(starts)
        first, last = np.zeros(len(one), bool), np.zeros(len(one), bool)
        first[starts[:-1][size > 0]] = True
        last[starts[1:][size > 0] - 1] = True
        before, after = np.roll(one, 1, 0), np.roll(one, -1, 0)
        before[first], after[last] = 0, 0
        return starts, np.column_stack([np.ones(len(one)), one, before, after, first, last]), c


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int, train_lines: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The fitted field, or None without labelled documents of both kinds."""
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0)).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label"))
    # The bound makes this small enough to send to all executors.
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("l_id"), "l_id", "label").limit(train_docs))

    def run(batches):
        features = LineFeatures()
        for batch in batches:
            for at, group in text_groups(batch.column(0).to_pylist()):
                starts, x, _ = features(group)
                for k in np.flatnonzero(np.diff(starts)).tolist():
                    own = x[starts[k] : starts[k + 1]]
                    columns = [batch.column(1).slice(at + k, 1), batch.column(2).slice(at + k, 1), pa.array([len(own)], pa.int32()), pa.array([own.astype("<f4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "key", "n", "x"])

    found = docs.select(F.col(id_col), text_or_empty(text_col).alias("t")).join(chosen, F.col(id_col) == F.col("l_id"))
    lines = found.select("t", "label", F.xxhash64("l_id").alias("key")).mapInArrow(run, "label int, key long, n int, x binary")
    # Written once: an id that repeats among the documents may have more rows than the sample takes.
    lines = materialise(lines.withColumn("row", F.monotonically_increasing_id()), "classifier-lines")
    order = [F.col("key"), F.xxhash64("x"), F.col("label"), F.col("row")]
    sample, left = [], train_lines
    for r in lines.orderBy(*order).limit(train_docs).select("row", "n").collect():
        if r["n"] <= left:
            sample.append((r["row"],))
            left -= r["n"]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sample, "row long"))
    rows = lines.join(wanted, "row", "left_semi").collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["n"], bytes(r["x"]), r["label"]))  # the fit doesn't depend on the order in which tasks end
    starts = np.cumsum([0, *(r["n"] for r in rows)])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(starts[-1], -1).astype(float)
    return fit(x, starts, np.array([r["label"] for r in rows]), ROUNDS, PENALTY)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, threshold: float = THRESHOLD, carry: str | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted, n_lines, and the column ``carry`` if one is named."""
    model = train(docs, labels, id_col, text_col, label_col, train_docs, train_lines)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        features = LineFeatures()
        for batch in batches:
            for at, group in text_groups(batch.column(2).to_pylist()):
                starts, x, chars = features(group)
                good = marginals(x @ model[0], starts, model[1])[0] if model is not None else np.full(len(x), 0.5)
                owner = np.repeat(np.arange(len(group)), np.diff(starts))
                total = np.bincount(owner, weights=chars, minlength=len(group))
                score = np.bincount(owner, weights=good * chars, minlength=len(group)) / np.maximum(total, 1)
                score = np.clip(score, 0.0, 1.0)
                own = [batch.column(k).slice(at, len(group)) for k in (0, 1, *range(3, batch.num_columns))]
                columns = [*own[:2], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(np.diff(starts).astype(np.int32)), *own[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "score", "predicted", "n_lines", *batch.schema.names[3:]])

    carried = [carry] if carry else []
    chosen = docs.select(F.col(id_col), (fold(id_col, 5) == 0).alias("_held"), text_or_empty(text_col).alias("_t"), *carried)
    more = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carried)
    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int, n_lines int{more}")
