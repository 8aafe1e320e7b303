"""Operator 12: personal data, and the terms that reveal it.

Four kinds of entities are found by pattern in the whole text: e-mail addresses, IP addresses, card numbers and telephone numbers.
Blanking them is not enough where the words around give them away, so the corpus is asked how much a term t tells of an entity a.
With p(x) the share of documents with x, and p(a, t) that of documents in which t stands within WINDOW words of a:

    information of the entity   IC(a) = -log2 p(a)
    disclosure by the term      PMI(a; t) = log2 (p(a, t) / (p(a) p(t)))

PMI reaches IC when the term occurs with the entity alone. A term near an entity is removed from REMOVE times IC on, and
generalised from GENERALISE times IC on. It takes CONTEXTS different contexts (the terms of the window), which are at least
CONTEXT_SHARE of the documents with the pair, so that a text that was copied does not testify for its own rare words. Documents
without an entity are never changed.

Pairs stay linear in the text (2 x WINDOW terms for an entity's occurrence). Documents with a term are counted over the whole
corpus, but only terms that passed the test of contexts leave the tasks that count them: a bitmap of 2**TERM_BITS bits, whose size
does not depend on the corpus, holds their hashes. A full bitmap lets more terms through, which costs time and changes nothing.

Patterns are searched so that no text takes more than a few passes, however it is made.

Defined results: a null text is empty; null and repeated ids are kept apart row by row, and rows equal in every column get equal
results; an entity that every document has (IC 0) reveals nothing; an empty table gives an empty result; other columns only
tell rows apart.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import join_facts, keyed, materialise, text_or_empty
from tempolane.llm.words import WordHasher

#: Kinds in the order in which they are listed; the last two are terms.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: Terms on each side of an entity that are its context.
WINDOW = 8
#: Different contexts that a pair of entity and term needs, and the least share of its documents that they make up.
CONTEXTS, CONTEXT_SHARE = 3, 0.5
#: Shares of the entity's information from which a term is generalised, or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Bits of the address in the bitmap of terms: 2 MB, whatever the corpus.
TERM_BITS = 24

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").finditer
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+").finditer
_CHAIN = re.compile(r"[0-9](?:[ -]?+[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile("[0-9]").search

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _TERM[_a:_b] = np.arange(_a, _b)
#: Letters and digits of terms in lower case, all other bytes as spaces.
_TERM_BYTES = _TERM[_LOWER]


def emails(text: str) -> list[tuple[int, int]]:
    """A match is a domain behind an @ and the run of local characters before it, which no earlier match has taken."""
    found, taken, last = [], 0, 0
    if "@" not in text:
        return found
    for m in _DOMAIN(text):
        at = m.start()
        # Local characters don't hold an @, so a run ends at the one before: no part of the text is looked at twice.
        before = text[max(taken, text.rfind("@", last, at) + 1) : at]
        size = len(before) - len(before.rstrip(_LOCAL))
        last = at
        if size:
            found.append((at - size, m.end()))
            taken = m.end()
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers at a time from each run of numbers with single dots between them."""
    found = []
    for m in _DOTTED(text):
        numbers, at = m[0].split("."), m.start()
        if len(numbers) < 4:
            continue
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CHAIN(text):
        if m.end() - m.start() <= 37:  # 19 digits with 18 marks between them
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all entities in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT(text):
        found += [(a, kind, b) for kind, search in ((1, addresses), (2, cards), (3, phones)) for a, b in search(text)]
    return sorted(found)


def value_hash(kind: int, value: str) -> int:
    """An entity is one whatever its case and marks."""
    plain = value.lower() if kind < 2 else "".join(filter(str.isdigit, value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def terms(text: str, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (code points) and hash of each term: runs of letters and digits, A-Z in lower case."""
    data = np.frombuffer(text.encode(), np.uint8)
    plain = _TERM_BYTES[data]
    starts, ends = hasher.spans(plain)
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return point[starts], point[ends], hasher.hashes(plain, starts, ends).view(np.int64)


def contexts(text: str, found: list[tuple[int, int, int]], hasher: WordHasher) -> list[tuple[int, int, int, int, int, int]]:
    """(entity, context, term, start, end, 1 for the first of the pair in this text) for the terms around each entity."""
    starts, ends, hashes = terms(text, hasher)
    free = np.ones(len(starts), bool)
    for a, _, b in found:
        free[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = False
    starts, ends, hashes = starts[free], ends[free], hashes[free]
    out, seen = [], set()
    for a, kind, b in found:
        entity = value_hash(kind, text[a:b])
        left, right = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        near = slice(max(0, left - WINDOW), right + WINDOW)
        context = xxhash.xxh3_64_intdigest(hashes[near].tobytes()) - (1 << 63)
        for s, e, h in zip(starts[near].tolist(), ends[near].tolist(), hashes[near].tolist(), strict=True):
            out.append((entity, context, h, s, e, int((entity, h) not in seen)))
            seen.add((entity, h))
    return out


PAIRS = "array<struct<a:long,ctx:long,t:long,s:int,e:int,first:int>>"
_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("ctx", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("first", pa.int32())]))


def base_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key (of all columns), base spans by kind and what stands around them."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at, texts in text_groups(batch.column(3).to_pylist()):
                found = [entities(t) for t in texts]
                near = [contexts(t, f, hasher) if f else [] for t, f in zip(texts, found, strict=True)]
                who = [sorted({value_hash(k, t[a:b]) for a, k, b in f}) for t, f in zip(texts, found, strict=True)]
                counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(4)]
                base = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in f) for f in found]
                pairs = pa.array([[dict(zip(("a", "ctx", "t", "s", "e", "first"), x, strict=True)) for x in n] for n in near], _PAIRS)
                own = [batch.column(k).slice(at, len(texts)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *counts, pa.array(base, pa.string()), pa.array(who, pa.list_(pa.int64())), pairs], names=["id", "h1", "h2", "n_email", "n_ip", "n_card", "n_phone", "base", "who", "pairs"])

    rows = keyed(docs, id_col).select(F.col(id_col).alias("id"), "_key.h1", "_key.h2", text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, h1 long, h2 long, n_email long, n_ip long, n_card long, n_phone long, base string, who array<long>, pairs {PAIRS}")


def documents_with(docs: DataFrame, wanted: DataFrame, text_col: str = "text", bits: int = TERM_BITS) -> DataFrame:
    """(t, in_docs): how many documents have each term; all of ``wanted``, and others that share a place in the bitmap."""
    place = F.col("t").bitwiseAND((1 << bits) - 1)
    held = wanted.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit")).distinct()
    # At most 2**bits / 64 rows reach the driver.
    words = np.zeros(1 << max(0, bits - 6), np.int64)
    for r in held.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).collect():
        words[r["word"]] = r["mask"]
    packed = words.view(np.uint8)
    mask = np.int64((1 << bits) - 1)

    def run(batches):
        hasher, flags = WordHasher(), np.unpackbits(packed, bitorder="little").astype(bool)
        for batch in batches:
            for _, texts in text_groups(batch.column(0).to_pylist()):
                raw = [t.encode() for t in texts]
                begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
                plain = _TERM_BYTES[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
                starts, ends = hasher.spans(plain)
                hashes = hasher.hashes(plain, starts, ends).view(np.int64)
                mine = np.flatnonzero(flags[hashes & mask])
                if len(mine):
                    owner = np.searchsorted(begins, starts[mine], side="right") - 1
                    order = np.lexsort((hashes[mine], owner))
                    h, o = hashes[mine][order], owner[order]
                    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
                    t, n = np.unique(h[fresh], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["t", "n"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("in_docs"))


def revealing(base: DataFrame, docs: DataFrame, text_col: str = "text", bits: int = TERM_BITS) -> DataFrame:
    """Pairs (a, t) above a threshold: both counts, share of the entity's information, and what is done to the term."""
    total = base.count()
    near = base.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.t", "p.ctx").agg(F.sum("p.first").alias("docs"))
    pairs = near.groupBy("a", "t").agg(F.count(F.lit(1)).alias("contexts"), F.sum("docs").alias("docs"))
    pairs = materialise(pairs.where((F.col("contexts") >= CONTEXTS) & (F.col("contexts") >= CONTEXT_SHARE * F.col("docs"))), "pairs")
    schema = "a long, t long, docs long, contexts long, share double, action int"
    if pairs.isEmpty():
        return base.sparkSession.createDataFrame([], schema)
    holders = base.select(F.explode("who").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("holders"))
    all_known = pairs.join(holders, "a").join(documents_with(docs, pairs.select("t"), text_col, bits), "t")
    information = F.log2(F.lit(float(total)) / F.col("holders"))
    pmi = F.log2(F.col("docs") * F.lit(float(total)) / (F.col("holders") * F.col("in_docs").cast("double")))
    shared = all_known.where(F.col("holders") < total).withColumn("share", pmi / information)
    return materialise(shared.where(F.col("share") >= GENERALISE).select("a", "t", "docs", "contexts", "share", F.when(F.col("share") >= REMOVE, 5).otherwise(4).alias("action")), "revealing")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = TERM_BITS) -> DataFrame:
    """One row per document: id, key, numbers of base entities, base spans as text, and all spans as sorted (start, kind, end)."""
    base = materialise(base_entities(docs, id_col, text_col), "entities")
    flagged = revealing(base, docs, text_col, bits)
    near = base.select("h1", "h2", F.explode("pairs").alias("p")).select("h1", "h2", F.struct("p.a", "p.t").alias("pair"), "p.s", "p.e")
    facts = flagged.select(F.struct("a", "t").alias("pair"), "docs", "action")
    hits = join_facts(near, facts, "pair", "docs", base.agg(F.sum(F.size("pairs"))).first()[0] or 0)
    # A term may reveal several entities, and rows may be equal in every column.
    added = hits.groupBy("h1", "h2", "s", "e").agg(F.max("action").alias("action")).groupBy("h1", "h2").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.col("action").alias("kind"), F.col("e").alias("end"))).alias("added"))
    fixed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), _parsed)
    spans = F.array_sort(F.concat(fixed, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return base.drop("who", "pairs").join(added, ["h1", "h2"], "left").select(F.col("id").alias(id_col), "h1", "h2", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def _parsed(span):
    kind, start, end = (F.split(span, ":")[k] for k in range(3))
    return F.struct(start.cast("int").alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1).cast("int").alias("kind"), end.cast("int").alias("end"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced: entities by their kind in brackets, generalised terms by [TERM], removed terms by nothing.

    Of overlapping spans the one that starts first is replaced. Only texts with a span are shuffled.
    """
    found = materialise(personal_data(docs, id_col, text_col).where(F.size("spans") > 0).groupBy("h1", "h2").agg(F.first("spans").alias("spans")), "spans")
    rows = keyed(docs, id_col).withColumns({"_h1": F.col("_key.h1"), "_h2": F.col("_key.h2")}).drop("_key")
    marks = {k: f"[{name.upper()}]" for k, name in enumerate(KINDS[:4])} | {4: "[TERM]", 5: ""}

    @F.pandas_udf("string")
    def replace(texts, spans):
        out = []
        for text, own in zip(texts, spans, strict=True):
            parts, at = [], 0
            for s in own if own is not None else ():
                if s["start"] >= at:
                    parts += [text[at : s["start"]], marks[s["kind"]]]
                    at = s["end"]
            out.append(None if text is None else "".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    joined = rows.join(found, (F.col("_h1") == found["h1"]) & (F.col("_h2") == found["h2"]), "left")
    return joined.withColumn(text_col, F.when(F.col("spans").isNull(), F.col(text_col)).otherwise(replace(text_col, "spans"))).select(*docs.columns)


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end joined by commas)."""
    named = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return personal_data(docs, id_col, text_col).select(id_col, "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.array_join(named, ",").alias("spans"))
