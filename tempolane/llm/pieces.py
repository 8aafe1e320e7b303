"""Operator 1: SentencePiece encoding and decoding with a score-ordered agenda.

A merge-type vocabulary is applied by keeping an agenda (heap) of adjacent symbol pairs ordered by the score of the piece
they would form, ties to the left-most pair. A popped pair that is still current is merged and its new neighbours enter the
agenda; it ends when no pair forms a piece. Symbols outside the vocabulary fall back to their UTF-8 bytes.

The agenda runs on segments: no piece of such a vocabulary has a word mark after another character, so a merge never
crosses from one word into the next word's mark; no piece holds a line feed; and some punctuation never follows a letter
inside a piece. These facts are read from the vocabulary when it is loaded, with the same character class that cuts the text.
Segments repeat, so each worker remembers a bounded number of them. By Arrow batch, every segment that is encoded anew is
compared with the sentencepiece library, and so is every whole text that holds a character which is neither ASCII nor a letter
(superscripts, fractions, emoji, foreign marks); a difference raises an error.

Defined results: a null text counts as empty and gives the begin and end ids alone; repeated rows are repeated; null ids
pass through; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.shared import text_or_empty

MARK = "▁"
#: What the cuts call a letter. It also matches such characters as a superscript two, which are no letters elsewhere.
LETTER = r"[^\W\d_]"
#: Segments a worker remembers in each of two generations; longer segments are never remembered.
CACHE_SEGMENTS, CACHE_CHARS = 500_000, 48
#: An agenda entry holds the left place in its lower bits.
SHIFT = 40
LEFT = (1 << SHIFT) - 1


class PieceCodec:
    """Encoder and decoder for one merge-type vocabulary file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        scores = {p: lib.get_score(i) for i, p in enumerate(pieces) if i not in special}
        order = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in scores.items()}
        self.id = {p: i for i, p in enumerate(pieces) if i not in special}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece crosses a word mark; segments would not be independent")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if any("\n" in p for p in self.id):
            raise ValueError("a piece contains a line feed; segments would not be independent")
        letter = re.compile(LETTER).match
        joined = {p[k + 1] for p in self.id for k in range(len(p) - 1) if letter(p[k])}
        cut = "".join(re.escape(x) for x in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~" if x not in joined)
        letters = f"{MARK}*{LETTER}+(?=[{cut}{MARK}\n]|\\Z)"
        self.segments = re.compile(f"\n|{letters}|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        back = {v: bytes([k]) for k, v in self.byte_id.items()}
        self.surface = [b"" if lib.is_control(i) else back.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment by agenda merging. An entry is the rank of the pair's piece and the pair's left place."""
        symbols, rank = list(segment), self.rank.get
        n = len(symbols)
        if n > 1:
            heap = [r << SHIFT | i for i, r in enumerate(map(rank, map(add, symbols, symbols[1:]))) if r is not None]
            heapify(heap)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while heap:
                entry = heappop(heap)
                left = entry & LEFT
                right = after[left]
                if not symbols[left] or right >= n:
                    continue
                piece = symbols[left] + symbols[right]
                if rank(piece) != entry >> SHIFT:
                    continue  # one of the two has been merged since
                symbols[left], symbols[right] = piece, ""
                after[left] = right = after[right]
                if right < n:
                    before[right] = left
                    r = rank(piece + symbols[right])
                    if r is not None:
                        heappush(heap, r << SHIFT | left)
                prev = before[left]
                if prev >= 0:
                    r = rank(symbols[prev] + piece)
                    if r is not None:
                        heappush(heap, r << SHIFT | prev)
        out: list[int] = []
        for sym in filter(None, symbols):
            found = self.id.get(sym)
            if found is not None:
                out.append(found)
            else:
                out += [self.byte_id[b] for b in sym.encode()]
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))

    def decode(self, ids) -> str:
        """The library's decode(ids): control ids vanish, one leading space is the marker's, bad byte runs are replaced."""
        raw = self.decode_bytes(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def mark(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def learn(self, texts_segments: list[list[str]]) -> dict[str, tuple[bytes, bytes]]:
        """Encode the segments of a batch that aren't remembered; check them against the library; return all it needs."""
        if len(self.young) > CACHE_SEGMENTS:
            self.old, self.young = self.young, {}
        need: dict[str, tuple[bytes, bytes]] = {}
        young, old, fresh = self.young, self.old, []
        for segment in set().union(*texts_segments):
            got = young.get(segment) or old.get(segment)
            if got is None:
                ids = self.agenda(segment)
                fresh.append((segment, ids))
                got = (array("I", ids).tobytes(), self.decode_bytes(ids))
            if len(segment) <= CACHE_CHARS:
                young[segment] = got
            need[segment] = got
        self.check(fresh)
        return need

    def check(self, fresh: list[tuple[str, list[int]]]) -> None:
        """One library call over the batch's new segments, parted by line feeds (which no piece contains)."""
        feed = self.byte_id[10]
        fresh = [x for x in fresh if x[0] != "\n" and "\n" not in x[0]]
        if not fresh or "\n" in self.id:
            return
        got = self.library.encode("\n" + "\n".join(s for s, _ in fresh), num_threads=1)
        want = [feed]
        for _, ids in fresh:
            want += ids
            want.append(feed)
        want.pop()
        if got[got.index(feed) :] != want:
            bad = next(s for s, ids in fresh if self.library.encode("\n" + s)[2:] != ids)
            raise ValueError(f"segment {bad!r} differs from the sentencepiece library")

    def check_whole(self, texts: list[str], ids: list[bytes]) -> None:
        """One library call over the batch's texts with unusual characters: a wrong cut would show here."""
        odd = [k for k, t in enumerate(texts) if unusual(t)]
        if odd:
            for k, want in zip(odd, self.library.encode([texts[k] for k in odd], num_threads=1), strict=True):
                if array("I", want).tobytes() != ids[k]:
                    raise ValueError(f"a text of {len(texts[k])} characters differs from the sentencepiece library")

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: ids as little-endian uint32 (no begin or end), and the decoded text's UTF-8 bytes."""
        split = [self.segments(self.mark(t)) for t in texts]
        need = self.learn(split)
        ids = {k: v[0] for k, v in need.items()}.__getitem__
        surface = {k: v[1] for k, v in need.items()}.__getitem__
        out = [(b"".join(map(ids, segs)), b"".join(map(surface, segs))[1:]) for segs in split]
        self.check_whole(texts, [x for x, _ in out])
        return out

    def encode(self, text: str) -> list[int]:
        raw = self.encode_batch([text])[0][0]
        return [self.begin, *memoryview(raw).cast("I"), self.end]


def unusual(text: str) -> bool:
    """Whether the text holds a character that is neither ASCII nor a letter."""
    return not text.isascii() and not all(c < "\x80" or c.isalpha() for c in set(text))


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec per worker process and vocabulary."""
    return PieceCodec(model_path)


def text_groups(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` characters together, with the first one's place: bounds a worker's memory."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int> and decoded string."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        c = codec(model_path)
        begin, end = c.begin.to_bytes(4, "little"), c.end.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, group in text_groups(texts, 4_000_000):
                out = c.encode_batch(group)
                full = [begin + ids + end for ids, _ in out]
                columns = [batch.column(0).slice(at, len(group)), pa.array([len(x) // 4 for x in full], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in full], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for _, x in out], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([list(memoryview(x).cast("I")) for x in full], pa.list_(pa.int32())), pa.array([x.decode() for _, x in out], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("_t")).mapInArrow(run, schema)
