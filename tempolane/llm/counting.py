"""Operator 2: token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; a segment tree over them holds the sums of characters and tokens. An
edit finds its place by descending the tree, takes the pre-tokens it touches and the context that the pattern may have looked
at, cuts this region anew until a border falls on an old one behind the edit, counts only the region's pre-tokens and updates
the sums above them. The rest of the text is neither cut nor encoded again.

Trees are kept: :func:`build_trees` gives a table of texts, with the characters and tokens of each pre-token, which is written to
the shared folder; :func:`edit_trees` applies a batch of edits to stored trees and gives the trees of the edited texts, which may
be stored in turn. Only sums are computed when a tree is read; pre-tokens are cut and encoded once in a text's life, and again
where an edit touches them.

The pattern is matched from left to right, looks at most LOOK characters behind a match's end and never before its start, so a
border outside that reach of the edit is a border of the edited text too. A region's pre-tokens are dealt over the leaves that
they replace; a leaf that grows beyond LEAF of them makes the tree be laid out anew, without encoding anything.

Edits are applied in order, each to the text that the ones before it have left: ``remove`` characters from ``at`` (both cut to
the text's length, negative values count as 0) are replaced by ``insert`` (null: empty).

Defined results: a null text counts as empty, with 0 tokens; null or absent edits change nothing; a null edit is skipped; repeated
rows are counted each time; null ids pass through; an empty table gives an empty result; other columns are ignored. In an edit
table, equal rows are applied each, and edits of ids that no document has change nothing.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import scratch_path, text_or_empty

#: Characters behind a match that the pattern may have looked at, and one.
LOOK = 3
#: Pre-tokens a worker remembers the counts of; longer ones are not remembered.
CACHE_PIECES, CACHE_CHARS = 1_000_000, 64
EDITS = "array<struct<at:long,remove:long,insert:string>>"
#: Pre-tokens that may stand in one leaf.
LEAF = 32


class PieceCounter:
    """Tokens of single pre-tokens of a byte-level vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        found = list(map(cache.get, pieces))
        if None in found:
            if len(cache) > CACHE_PIECES:
                cache.clear()
            for k, n in enumerate(found):
                if n is None:
                    piece = pieces[k]
                    n = cache.get(piece)
                    if n is None:
                        n = len(self.encoding.encode_ordinary(piece))
                        if len(piece) <= CACHE_CHARS:
                            cache[piece] = n
                    found[k] = n
        return found


@lru_cache(maxsize=2)
def counter(ranks_path: str, pattern: str) -> PieceCounter:
    """One counter per worker process and vocabulary."""
    return PieceCounter(ranks_path, pattern)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: the width of each, then all of them in as few bytes as the largest needs."""
    width = 1 if not len(values) or values.max() < 256 else 2 if values.max() < 65536 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class CountedText:
    """Segment tree over a text's pre-tokens. A leaf holds one at first, and those that an edit put in its place later."""

    def __init__(self, text: str, by: PieceCounter, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        """``chars`` and ``tokens`` of each pre-token, if a stored tree has them; else the text is cut and encoded."""
        self.by, self.encoded = by, 0
        if chars is None:
            pieces = by.cut(text)
            chars, tokens = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(by.counts(pieces), np.int64)
        self._lay_out(text, chars, tokens)

    def _lay_out(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.base, self.ends, self.base_tokens = text, np.cumsum(chars), tokens
        self.changed: dict[int, tuple[list[str], list[int]]] = {}
        n = self.n_leaves = max(1, len(chars))
        self.size = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(chars), 1] = tokens
        low = self.size
        while low > 1:
            self.sums[low // 2 : low] = self.sums[low : 2 * low : 2] + self.sums[low + 1 : 2 * low : 2]
            low //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def leaf(self, k: int) -> str:
        """The text in a leaf."""
        if k in self.changed:
            return "".join(self.changed[k][0])
        return self.base[(self.ends[k - 1] if k else 0) : self.ends[k]] if len(self.ends) else ""

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at``, and the place where the leaf starts."""
        node, start, sums = 1, 0, self.sums
        while node < self.size:
            node *= 2
            left = int(sums[node, 0])
            if at - start >= left:
                start += left
                node += 1
        return node - self.size, start

    def edit(self, at: int, remove: int, insert: str) -> None:
        total = self.chars
        at = min(max(0, at), total)
        end = min(total, at + max(0, remove))
        if end == at and not insert:
            return
        first, start = self.find(max(0, min(at - LOOK, total - 1))) if total else (0, 0)
        last, begin = self.find(min(end, total - 1)) if total else (0, 0)
        stop, more = begin + int(self.sums[self.size + last, 0]), 4
        old = [self.leaf(k) for k in range(first, last + 1)]
        while True:
            # Some leaves more than the edit touches, for the borders to meet again.
            borders = {stop: last}
            while more and last + 1 < self.n_leaves:
                last += 1
                old.append(self.leaf(last))
                stop += len(old[-1])
                borders[stop] = last
                more -= 1
            old = ["".join(old)]
            region = old[0][: at - start] + insert + old[0][end - start :]
            pieces = self.by.cut(region)
            shift, place, whole = len(insert) - (end - at), start, stop == total
            for k, piece in enumerate(pieces):
                place += len(piece)
                leaf = borders.get(place - shift)
                if leaf is not None and place - shift >= end and (whole and k == len(pieces) - 1 or place + LOOK <= stop + shift):
                    return self._replace(first, leaf, pieces[: k + 1])
            if whole:
                return self._replace(first, self.n_leaves - 1, pieces)
            more = 2 * (last - first + 4)

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        counts = self.by.counts(pieces)
        self.encoded += len(pieces)
        n = last - first + 1
        for k in range(n):
            own = slice(len(pieces) * k // n, len(pieces) * (k + 1) // n)
            self.changed[first + k] = pieces[own], counts[own]
            self.sums[self.size + first + k] = sum(map(len, pieces[own])), sum(counts[own])
        if len(pieces) > LEAF * n:
            self._lay_out(*self.parts())
            return
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2 : 2] + self.sums[2 * low + 1 : 2 * high + 2 : 2]
            low, high = low // 2, high // 2

    def parts(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text, and the characters and tokens of each pre-token: what a stored tree holds."""
        if not self.changed:
            return self.base, np.diff(self.ends, prepend=0), self.base_tokens
        text, chars, tokens, at = [], [], [], 0
        begins = np.concatenate(([0], self.ends))
        for k in sorted(self.changed):
            pieces, counts = self.changed[k]
            if k > at:
                text.append(self.base[begins[at] : begins[k]])
                chars.append(np.diff(begins[at : k + 1]))
                tokens.append(self.base_tokens[at:k])
            text.extend(pieces)
            chars.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            tokens.append(np.array(counts, np.int64))
            at = k + 1
        if at < len(self.ends):
            text.append(self.base[begins[at] :])
            chars.append(np.diff(begins[at:]))
            tokens.append(self.base_tokens[at:])
        return "".join(text), np.concatenate(chars), np.concatenate(tokens)

    def text(self) -> str:
        return self.parts()[0]


def gather_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", seq_col: str = "seq", into: str = "edits") -> DataFrame:
    """``docs`` with a column ``into`` from an edit table (id, seq, at, remove, insert); a document's edits are few.

    A column of that name that ``docs`` has already is replaced; all others stay, whatever their names.
    """
    step = F.struct(F.col(seq_col).alias("seq"), F.col("at").cast("long").alias("at"), F.col("remove").cast("long").alias("remove"), F.col("insert").alias("insert"))
    own = edits.groupBy(F.col(id_col).alias("k")).agg(F.array_sort(F.collect_list(step)).alias("e")).select(F.struct("k", F.transform("e", lambda x: F.struct(x["at"].alias("at"), x["remove"].alias("remove"), x["insert"].alias("insert"))).alias("e")).alias("_own"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    joined = rows.join(own, F.col("_doc").getField(id_col).eqNullSafe(F.col("_own.k")), "left")
    return joined.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns if c != into), F.col("_own.e").alias(into))


TREE = "_text string, _chars binary, _tokens binary"


def build_trees(docs: DataFrame, ranks_path: str, pattern: str, carry: list, text_col: str = "text") -> DataFrame:
    """A tree per document: the columns ``carry``, then _text and the characters and tokens of its pre-tokens (see TREE)."""
    chosen = docs.select(*carry, text_or_empty(text_col).alias("_text"))
    names = chosen.columns

    def run(batches):
        by = counter(ranks_path, pattern)
        for batch in batches:
            for at, texts in text_groups(batch.column(batch.num_columns - 1).to_pylist()):
                parts = [CountedText(t, by).parts() for t in texts]
                columns = [batch.column(k).slice(at, len(texts)) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([packed(p[k]) for p in parts], pa.binary()) for k in (1, 2))], names=[*names, "_chars", "_tokens"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.mapInArrow(run, f"{shape}, _chars binary, _tokens binary")


def store_trees(trees: DataFrame) -> DataFrame:
    """``trees`` written to the shared folder, closely packed, and read back."""
    path = scratch_path(trees.sparkSession, "token-trees")
    trees.write.option("compression", "zstd").parquet(path)
    return trees.sparkSession.read.schema(trees.schema).parquet(path)


def edit_trees(trees: DataFrame, ranks_path: str, pattern: str, edits, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """One row per stored tree: id, n_tokens, n_chars, n_edits, n_tokens_edited, n_chars_edited, n_encoded (pre-tokens encoded for
    the edits), and with ``keep`` the tree of the edited text. ``edits`` is a column of the type EDITS."""
    counts = ["n_tokens", "n_chars", "n_edits", "n_tokens_edited", "n_chars_edited", "n_encoded"]
    id_type = trees.schema[id_col].dataType.simpleString()

    def run(batches):
        by = counter(ranks_path, pattern)
        for batch in batches:
            for at, texts in text_groups(batch.column(2).to_pylist()):
                own = [batch.column(k).slice(at, len(texts)) for k in range(batch.num_columns)]
                rows, after = [], []
                for text, todo, chars, tokens in zip(texts, *(own[k].to_pylist() for k in (1, 3, 4)), strict=True):
                    tree = CountedText(text, by, unpacked(chars), unpacked(tokens))
                    before = (tree.tokens, tree.chars)
                    todo = [x for x in todo or [] if x is not None]
                    for x in todo:
                        tree.edit(x["at"] or 0, x["remove"] or 0, x["insert"] or "")
                    rows.append((*before, len(todo), tree.tokens, tree.chars, tree.encoded))
                    if keep:
                        new, *sizes = tree.parts()
                        after.append((new, *map(packed, sizes)))
                columns = [own[0], *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
                if keep:
                    columns += [pa.array(c, t) for c, t in zip(zip(*after, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *counts, *(["_text", "_chars", "_tokens"] if keep else [])])

    chosen = trees.select(F.col(id_col), edits.cast(EDITS).alias("_edits"), "_text", "_chars", "_tokens")
    return chosen.mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in counts) + (f", {TREE}" if keep else ""))


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build and store the documents' trees, then apply a batch of edits to them: see :func:`edit_trees`. ``edits`` is a column of
    ``docs`` of the type EDITS."""
    trees = store_trees(build_trees(docs, ranks_path, pattern, [F.col(id_col), edits.cast(EDITS).alias("_todo")], text_col))
    return edit_trees(trees, ranks_path, pattern, F.col("_todo"), id_col)


def review_edits(id_col: str = "doc_id", text_col: str = "text"):
    """A column of three edits for each document, at places that its id decides: a removal, an insertion and a replacement."""
    size = F.length(text_or_empty(text_col)) + 1
    place = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), size)
    edit = lambda k, remove, insert: F.struct(place(k).cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(1, 24, ""), edit(2, 0, " as revised,"), edit(3, 9, "[removed]"))
