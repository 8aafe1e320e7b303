"""Operator 10: near-duplicates by ProbMinHash, banding and exact verification.

Texts are sets of five-word shingles. Documents with the same set are one node. Sketches weigh repeated shingles more, from 1 up
to TOP_WEIGHT whatever the number of occurrences: sets of similarity s have a probability Jaccard of s / TOP_WEIGHT at least,
and there are bands for that. Nodes whose sketches agree on a whole band meet in a bucket. Links are pairs of nodes with a Jaccard similarity of their shingle sets of at
least 0.8, computed from the whole sets; classes are the connected components of the links.

Buckets are not turned into all their pairs. Every bucket has a centre, which is compared with its members; a group of near
copies becomes one component by linear work. Buckets that are still in several components get a second centre, the set that
has most in common with the others. What is then left, pairs of members in different components, is compared too, so that no
link is lost between the rounds; but only pairs that the known sizes, distances from the centre and numbers of shingles that no
other set has do not exclude. A large bucket is cut for this: its members meet in blocks, and only those whose sizes allow the
similarity. What is known of a hot key (a text with many copies, a bucket with many members, a class) is joined by broadcast, of
which there can be 100,000 at most; the set of a node that many pairs name is sent to several tasks, each with some of the pairs.

Defined results: a null text counts as empty; a text of fewer than five words is one shingle of all its words; texts without
words are one class; null and repeated ids are kept apart row by row, one row of a class is kept; a class is named by its
largest id (null if it has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.components import components
from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import HOT_SHARE, join_facts, materialise, text_or_empty
from tempolane.llm.sketch import bands, sketches
from tempolane.llm.words import WordHasher, join_texts, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, ROWS, TOP_WEIGHT = 100, 4, 1.1
#: Keys of texts that are sent to all executors (a few bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs that fetch one node's set in one task, and members of a bucket that meet in one block.
PAIRS_PER_TASK, BLOCK = 4096, 512


def shingles(texts: list[str], hasher: WordHasher, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, hash and number of occurrences of the distinct shingles of each text, in order of owner and hash."""
    data, place = join_texts([t.encode() for t in texts])
    s, e = hasher.spans(data)
    owner = np.searchsorted(place, s, side="right") - 1
    words = hasher.hashes(data, s, e)
    found, at = window_hashes(words, owner, size)
    belongs = owner[at]
    # Texts of fewer words: one shingle of them all.
    count = np.bincount(owner, minlength=len(texts))
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            first = np.searchsorted(owner, short)
            rows = np.repeat(first, k) + np.tile(np.arange(k), len(short))
            whole, _ = window_hashes(words[rows], np.repeat(short, k), k)
            found, belongs = np.concatenate([found, whole + np.uint64(k)]), np.concatenate([belongs, short])
    order = np.lexsort((found, belongs))
    found, belongs = found[order], belongs[order]
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (belongs[1:] != belongs[:-1]))) if len(found) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return belongs[first], found[first], np.diff(np.append(first, len(found)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, text_key, set_key, n (distinct shingles) and bands of each document; texts are not carried on."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at, texts in text_groups(batch.column(2).to_pylist()):
                n = len(texts)
                owner, shingle, times = shingles(texts, hasher)
                sketch = sketches(owner, shingle, TOP_WEIGHT - (TOP_WEIGHT - 1) / times, n, REGISTERS)
                keys = bands(sketch, ROWS).view(np.int64)
                bound = np.searchsorted(owner, np.arange(n + 1))
                names = [xxhash.xxh3_128_hexdigest(shingle[a:b].tobytes()) for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(names, pa.string()), pa.array(np.diff(bound), pa.int64()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))],
                    names=["id", "text_key", "set_key", "n", "bands"],
                )

    text = text_or_empty(text_col)
    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("t")).mapInArrow(run, f"id {id_type}, text_key long, set_key string, n long, bands array<long>")
    return materialise(chosen.withColumn("row", F.monotonically_increasing_id()), "near-signatures")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and its sorted shingle hashes, for the given nodes (node, id, text_key)."""
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("t"))
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    wanted = wanted.select("node", F.col("id").alias("w_id"), F.col("text_key").alias("w_key"))
    chosen = texts.join(wanted, (F.col("text_key") == F.col("w_key")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "t")

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for at, group in text_groups(batch.column(1).to_pylist()):
                owner, shingle, _ = shingles(group, hasher)
                bound = np.searchsorted(owner, np.arange(len(group) + 1))
                sets = [shingle[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = materialise(chosen.mapInArrow(run, "node long, shingles binary"), "near-sets")
    if sets.count() == nodes.count():
        return sets
    # Rows equal in id and text have given their node a set each: one stays, which is found before the shuffle.
    return materialise(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")


def with_sets(pairs: DataFrame, sets: DataFrame, side: str, name: str, total: int) -> DataFrame:
    """``pairs`` with the set of the node in ``side``; the pairs of a node that many of them name are dealt to several tasks."""
    one = sets.select(F.col("node").alias(side), F.col("shingles").alias(name))
    least = max(PAIRS_PER_TASK, HOT_SHARE * total)
    hot = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > least)
    if total <= least:
        return pairs.join(one, side)
    parts = F.broadcast(materialise(hot.select(side, F.ceil(F.col("times") / PAIRS_PER_TASK).cast("int").alias("parts")), "near-hot"))
    other = "b" if side == "a" else "a"
    dealt = pairs.join(parts, side, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"))).drop("parts")
    spread = one.join(parts, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(spread, [side, "part"]).drop("part")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with ``both``, the number of shingles that both have, and ``near``, whether the sets are similar."""

    def run(batches):
        for batch in batches:
            both, near = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                both.append(n)
                near.append(n >= similarity * ((len(x) + len(y)) // 8 - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(near, pa.bool_())], names=["a", "b", "both", "near"])

    pairs = materialise(pairs, "near-pairs")
    total = pairs.count()
    pairs = with_sets(with_sets(pairs, sets, "a", "x", total), sets, "b", "y", total)
    return materialise(pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, both long, near boolean"), "near-compared")


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def centre_pairs(now: DataFrame, similarity: float) -> DataFrame:
    """Each member of a bucket with the bucket's centre (p, p_n), unless their sizes exclude the similarity."""
    near = now.where("node <> p").where(f"least(n, p_n) >= {similarity} * greatest(n, p_n)")
    return near.select(*ordered("node", "p")).distinct()


def open_members(member: DataFrame, label: DataFrame, total: int) -> DataFrame:
    """Members with their component, in buckets that are not in one component yet."""
    now = materialise(member.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labelled")
    several = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("band", "k")
    return join_facts(now, several, "band", "k", total).drop("k")


def unshared(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node and own: how many of its shingles no other of the nodes has."""

    def run(batches):
        for batch in batches:
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingle = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingle), node)), pa.array(shingle)], names=["node", "shingle"])

    each = sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(run, "node long, shingle long")
    alone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("times")).where("times = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def remaining_pairs(now: DataFrame, facts: DataFrame, similarity: float, total: int) -> DataFrame:
    """The pairs of members of a bucket in different components that can be similar at all.

    Two bounds, exact for every data. What two sets share is at most the smaller number c of shingles that are not a set's own
    alone: (1 + s) * min(c) >= s * (|a| + |b|). And with d, how far a set is from its bucket's centre (shingles in one but not
    both), sets differ by d_a + d_b less twice what they have in common among these differences, which is at most d - own; they
    may differ by (1 - s) / (1 + s) * (|a| + |b|). One of each pair is outside its bucket's largest component.

    Members meet by classes of size, in which a similar set is one class away at most, and by blocks of a large bucket.
    """
    where = ordered("node", "p")
    far = facts.select(F.col("a").alias("f_a"), F.col("b").alias("f_b"), "both")
    now = now.join(far, (where[0] == F.col("f_a")) & (where[1] == F.col("f_b")), "left").withColumn("c", F.col("n") - F.col("own"))
    now = now.withColumn("d", F.when(F.col("node") == F.col("p"), 0).otherwise(F.col("n") + F.col("p_n") - 2 * F.col("both")))
    bucket = now.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("size")).select("band", "size", F.col("m.label").alias("main"))
    every = now.groupBy("node").agg(F.array_sort(F.collect_set("band")).alias("bands"))  # as many as a sketch has at most
    now = join_facts(now, bucket, "band", "size", total).join(every, "node").withColumn("main", F.col("label") == F.col("main"))
    grade = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(similarity))).cast("int")
    now = now.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("grade", grade)
    columns = ("node", "n", "label", "own", "c", "d", "main", "bands")
    now = materialise(now.select("band", "blocks", "grade", *columns), "near-open")
    side = lambda df, x: df.select("band", "block", "grade", *(F.col(k).alias(f"{x}_{k}") for k in columns))
    meets = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.col("grade") + k)
    one = now.where("NOT main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("grade", F.explode(meets))
    two = now.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one, two = side(one, "a").alias("one"), side(two, "b").alias("two")
    s = similarity
    differ = f"{(1 - s) / (1 + s)} * (a_n + b_n)"
    possible = f"least(a_n, b_n) >= {s} * greatest(a_n, b_n) AND {1 + s} * least(a_c, b_c) >= {s} * (a_n + b_n) - 1e-6 AND coalesce(a_d + b_d - 2 * least(a_d - a_own, b_d - b_own) <= {differ} + 1e-6, true)"
    once = "a_label <> b_label AND (b_main OR a_node < b_node)"
    first = "array_intersect(a_bands, b_bands)[0] = one.band"  # a pair meets in the first bucket that both are in
    return one.join(two, F.expr(f"one.band = two.band AND one.block = two.block AND one.grade = two.grade AND {once} AND {possible} AND {first}")).select(*ordered("a_node", "b_node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id (largest id of the class), class_size, kept, n_shingles."""
    signed = signatures(docs, id_col, text_col)
    first, last = F.min(F.struct("row", "id", "text_key", "n", "bands")).alias("x"), F.max(F.struct("id", "row")).alias("last")
    node = signed.groupBy("set_key").agg(first, last, F.count(F.lit(1)).alias("times"))
    node = materialise(node.select("set_key", F.col("x.row").alias("node"), "x.id", "x.text_key", "x.n", "x.bands", "last", "times"), "near-nodes")
    band = node.where("n > 0").select("node", "n", F.explode("bands").alias("band"))
    # The least node of each bucket is its first centre.
    centre = F.min(F.struct(F.col("node").alias("p"), F.col("n").alias("p_n"))).alias("c")
    shared = materialise(band.groupBy("band").agg(centre, F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "c.p", "c.p_n", "members"), "near-buckets")
    total = shared.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    member = materialise(join_facts(band, shared, "band", "members", total), "near-members")
    sets = shingle_sets(docs, node.join(member.select("node").distinct(), "node", "left_semi").select("node", "id", "text_key"), id_col, text_col)

    links = compared(centre_pairs(member, similarity), sets, similarity).where("near").select("a", "b")
    label = components(links)
    # Second round, in the buckets left open: the set with the least share of shingles of its own, the others' common base.
    now = open_members(member.select("node", "n", "band"), label, total)
    own = unshared(now.select("node").distinct(), sets)
    alone = materialise(now.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).drop("label"), "near-own")
    best = F.min(F.struct((F.col("own") / F.col("n")).alias("x"), F.col("node").alias("p"), F.col("n").alias("p_n"))).alias("c")
    best = alone.groupBy("band").agg(best, F.count(F.lit(1)).alias("k")).select("band", "c.p", "c.p_n", "k")
    alone = materialise(join_facts(alone, best, "band", "k", total).drop("k"), "near-second")
    facts = compared(centre_pairs(alone, similarity), sets, similarity)
    links = links.unionByName(facts.where("near").select("a", "b"))
    label = components(links)
    # What is left.
    rest = compared(remaining_pairs(open_members(alone, label, total), facts, similarity, total), sets, similarity).where("near").select("a", "b")
    if not rest.isEmpty():
        label = components(links.unionByName(rest))

    rows = signed.count()
    node = materialise(node.select("set_key", "node", "last", "times").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-components")
    classes = node.groupBy("label").agg(F.max("last").alias("keep"), F.sum("times").alias("class_size"))
    node = materialise(join_facts(node.select("set_key", "label", "times"), classes, "label", "class_size", rows), "near-classes")
    out = join_facts(signed.select("row", "id", "set_key", "n"), node.drop("label"), "set_key", "times", rows)
    return out.select(F.col("id").alias(id_col), F.col("keep.id").alias("class_id"), "class_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("n").alias("n_shingles"))
