"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempolane.llm import hmm
from tempolane.llm import likelihood as LM
from tempolane.llm import near
from tempolane.llm import queries as Q
from tempolane.llm import shared
from tempolane.llm.archives import archive_pages
from tempolane.llm.classifier import classify
from tempolane.llm.components import components
from tempolane.llm import counting
from tempolane.llm.counting import EDITS, count_tokens, gather_edits
from tempolane.llm.exact import exact_duplicates
from tempolane.llm.extract import extract_pages
from tempolane.llm.likelihood import score_documents
from tempolane.llm.near import near_duplicates
from tempolane.llm.packing import best_fit, pack
from tempolane.llm.pieces import encode_decode
from tempolane.llm.rules import quality_rules

LONG = "long text with many different words number " + " ".join(f"w{k}" for k in range(30000))
BASE = " ".join(f"base{k}" for k in range(60))
ROWS = [(1, "hello world", "a"), (2, None, None), (3, "", "a"), (4, "hello world", "b"), (5, "hello world", "b"), (5, "hello world", "b"), (None, "no id", "a"), (7, LONG, "c"), (8, BASE, "c"), (9, BASE + " tail", "c"), (10, "x\ny\n" + "# " * 60, "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("id", "row", "label", "tokens", "t", "_t", "score", "node", "n", "fp", "kept", "host", "edits")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def labels_of(spark):
    return spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(1, 60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "encode": lambda s, d: encode_decode(d, Q.PIECE_MODEL),
    "count": lambda s, d: count_tokens(d, Q.BYTE_RANKS, Q.BYTE_PATTERN, F.lit(None).cast(EDITS)),
    "rules": lambda s, d: quality_rules(d),
    "classify": lambda s, d: classify(d, labels_of(s)),
    "exact": lambda s, d: exact_duplicates(d),
    "score": lambda s, d: score_documents(d),
    "near": lambda s, d: near_duplicates(d),
    "pack": lambda s, d: best_fit(d, Q.BYTE_RANKS, Q.BYTE_PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, docs, empty, name):
    rows = OPERATORS[name](spark, docs).collect()
    assert collections.Counter(r["doc_id"] for r in rows if not r.asDict().get("piece")) == collections.Counter(r[0] for r in ROWS)
    assert OPERATORS[name](spark, empty).count() == 0


def test_exact_groups(spark, docs):
    rows = exact_duplicates(docs).collect()
    hello = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"hello world").hexdigest()]
    assert len(hello) == 4 and {r["keep_id"] for r in hello} == {5} and {r["group_size"] for r in hello} == {4}
    assert sum(r["kept"] for r in hello) == 1
    assert {(r["doc_id"], r["keep_id"]) for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()} == {(2, 3), (3, 3)}


def test_near_classes(spark, docs):
    rows = {(r["doc_id"], r["class_id"], r["class_size"]) for r in near_duplicates(docs).collect()}
    assert {(8, 9, 2), (9, 9, 2), (1, 5, 4), (2, 3, 2), (7, 7, 1), (None, None, 1)} <= rows
    assert sum(r["kept"] for r in near_duplicates(docs).collect()) == 6


def test_near_classes_equal_brute_force(spark):
    import random

    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(116)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    best = collections.defaultdict(int)
    for k in range(len(texts)):
        best[find(k)] = max(best[find(k)], k)
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: best[find(k)] for k in range(len(texts))}


def test_near_classes_with_repeated_passages(spark):
    texts = {}
    for k in range(60):
        base = [f"w{k}x{j}" for j in range(88)]
        for side in (0, 1):
            passage = [f"p{2 * k + side}x{j}" for j in range(6)]
            texts[2 * k + side] = base + passage * 40
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for k, w in texts.items()}
    assert all(0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.82 for k in range(0, 120, 2))
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")).collect()}
    assert got == {k: k | 1 for k in texts}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_frequent_lines_deplete_documents(spark):
    boiler = "shared boilerplate line that stands on many pages of one host"
    rows = [(k, f"{boiler}\nonly words of page {k} " + " ".join(f"p{k}x{j}" for j in range(5)) + f"\n{boiler} " * 6, "h") for k in range(80)]
    rows += [(1000, "\n".join([boiler] * 6 + ["few own"]) + " " + " ".join(f"z{k}" for k in range(8)), "h"), (1001, " ".join(f"own{k}" for k in range(80)) + "\n" + boiler, "h"), (1002, boiler + " " + " ".join(f"q{k}" for k in range(60)), "other")]
    rows = [(i, t if i >= 1000 else boiler + "\n" + " ".join(f"p{i}x{j}" for j in range(60)), h) for i, t, h in rows]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA), line_docs=50, remaining_share=0.5).collect()}
    assert got[5]["kept"] and got[5]["removed_words"] == 11 and got[1001]["kept"] and got[1002]["removed_words"] == 0
    assert got[1000]["removed_words"] == 66 and not got[1000]["kept"]


def test_copies_are_one_document_for_line_counts(spark):
    text = "\n".join(f"line {k} " + " ".join(f"a{k}b{j}" for j in range(20)) for k in range(5))
    got = quality_rules(spark.createDataFrame([(k, text, "h") for k in range(200)], SCHEMA)).collect()
    assert all(r["kept"] and r["removed_words"] == 0 for r in got)


def test_line_counts_equal_brute_force_with_several_boiler_lines(spark):
    r = random.Random(7)
    boiler = [f"boiler line {k} of this host " + " ".join(f"b{k}x{j}" for j in range(4)) for k in range(5)]
    pages = [[*r.sample(boiler, r.randrange(1, 6)), " ".join(f"o{r.randrange(60)}x{j}" for j in range(60))] for _ in range(150)]
    rows = [(k, "\n".join(lines), "h") for k, lines in enumerate(pages)]
    seen = collections.Counter(x for lines in {frozenset(lines) for lines in pages} for x in lines)
    for limit in (60, 80, 100):
        got = {x["doc_id"]: x["removed_words"] for x in quality_rules(spark.createDataFrame(rows, SCHEMA), line_docs=limit).collect()}
        assert got == {k: sum(len(x.split()) for x in lines if seen[x] > limit) for k, lines in enumerate(pages)}
        assert limit > 60 or sum(got.values())


@pytest.mark.parametrize("own", [8, 40])
def test_template_pages_are_rejected(spark, own):
    """Twelve shared lines: with few words of its own a page is no less a template. Exact copies are one document."""
    boiler = "\n".join(f"shared line {k} " + " ".join(f"s{k}x{j}" for j in range(11)) for k in range(12))
    page = lambda k: boiler + "\n" + " ".join(f"o{k}x{j}" for j in range(own))
    rows = [(k, page(k), "templates") for k in range(200)] + [(1000 + k, page(0), "copies") for k in range(300)] + [(2000 + k, page(k), None) for k in range(11)] + [(3000 + k, page(k), "") for k in range(10)]
    got = {r["doc_id"]: (r["kept"], r["removed_words"]) for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == (False, 12 * 14) for k in range(200)) and all(got[2000 + k] == (False, 12 * 14) for k in range(11))
    assert all(got[1000 + k] == (True, 0) for k in range(300)) and all(got[3000 + k] == (True, 0) for k in range(10))


def test_many_equal_rows_give_one_set(spark, monkeypatch):
    compared = []
    inner = near.compared
    monkeypatch.setattr(near, "compared", lambda pairs, sets, s: compared.append((pairs.count(), sets.count())) or inner(pairs, sets, s))
    rows = [(None, BASE, "a")] * 3000 + [(None, BASE + " tail", "a")] * 3000 + [(1, "else " + BASE, "a")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6001 and {r["class_size"] for r in got} == {6001} and sum(r["kept"] for r in got) == 1
    assert compared and all(p <= 3 and n == 3 for p, n in compared)


def test_line_limit_is_the_same_in_small_and_large_hosts(spark):
    boiler = "\n".join(f"template line {k} " + " ".join(f"t{k}x{j}" for j in range(12)) for k in range(4))
    page = lambda k: f"{boiler}\n" + " ".join(f"o{k}x{j}" for j in range(20))
    clean = lambda k: "\n".join(" ".join(f"c{k}x{i}x{j}" for j in range(20)) for i in range(3))
    rows = [(k, page(k), "small") for k in range(30)] + [(100 + k, page(k), "large") for k in range(30)] + [(1000 + k, clean(k), "large") for k in range(3000)] + [(200 + k, page(k), "few") for k in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: k >= 200 for k, *_ in rows}


def test_scores_equal_brute_force(spark):
    texts = {k: f"The cat {'sat ' * (k % 4)}on MAT{k % 3}\x0b x{k}" for k in range(30)} | {30: ""}
    got = {r["doc_id"]: r for r in score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    lower = {k: [w.lower() for w in t.replace("\x0b", " ").split()] + [None] for k, t in texts.items()}
    seen = collections.Counter(w for k, ws in lower.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    total = sum(seen.values())
    for k, ws in lower.items():
        assert got[k]["n_tokens"] == len(ws) and got[k]["n_known"] == sum(seen[w] > 0 for w in ws) and got[k]["train_tokens"] == total
        assert abs(got[k]["base_score"] - sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in ws)) < 1e-9
        assert got[k]["score"] < 0


def naive_scores(texts, learned, states, rounds, top_words):
    """Baum-Welch and forward recursion by plain loops over whole texts; words by their classes."""
    words = {k: [w.lower() for w in t.split()] for k, t in texts.items()}
    count = collections.Counter(w for k in learned for w in words[k])
    ranked = sorted(count, key=lambda w: (-count[w], w))
    top = {w: k for k, w in enumerate(ranked[: top_words])}
    of = lambda w: top.get(w, top_words + LM.suffix_class(w))
    tokens, kinds = collections.Counter(), collections.Counter()
    for w in ranked[top_words :]:
        tokens[of(w)] += count[w]
        kinds[of(w)] += 1
    inside = lambda w: 0.0 if w in top else math.log10((count[w] + 1 if count[w] else 1) / (tokens[of(w)] + kinds[of(w)] + 1))
    classes = np.zeros(top_words + LM.SUFFIX_CLASSES + 1)
    for w in ranked:
        classes[of(w)] += count[w]
    classes[-1] = len(learned)
    start, move, emit = hmm.seeded((classes + 1) / (classes + 1).sum(), states)
    seqs = {k: [of(w) for w in ws] + [top_words + LM.SUFFIX_CLASSES] for k, ws in words.items()}

    def alphas(seq):
        out = []
        for t, x in enumerate(seq):
            a = [(start[j] if t == 0 else sum(out[-1][i] * move[i, j] for i in range(states))) * emit[x, j] for j in range(states)]
            out.append(a)
        return out

    for _ in range(rounds):
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros_like(emit)]
        for k in learned:
            seq, a = seqs[k], alphas(seqs[k])
            b = [[1.0] * states]
            for x in reversed(seq[1:]):
                b.insert(0, [sum(move[i, j] * emit[x, j] * b[0][j] for j in range(states)) for i in range(states)])
            whole = sum(a[-1])
            for t, x in enumerate(seq):
                for i in range(states):
                    g = a[t][i] * b[t][i] / whole
                    sums[2][x, i] += g
                    if t == 0:
                        sums[0][i] += g
                    if t + 1 < len(seq):
                        for j in range(states):
                            sums[1][i, j] += a[t][i] * move[i, j] * emit[seq[t + 1], j] * b[t + 1][j] / whole
        start, move, emit = hmm.normalise(*sums)
    return {k: math.log10(sum(alphas(seq)[-1])) + sum(map(inside, words[k])) for k, seq in seqs.items()}


def test_model_scores_equal_plain_loops_however_the_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(LM, "SETTLED", -1.0)
    r = random.Random(3)
    texts = {k: " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "dog", "ran", f"w{k % 7}"]) for _ in range(r.randrange(0, 25))) for k in range(40)}
    learned = [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    want = naive_scores(texts, learned, 3, 4, 6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for parts in (1, 4):
        got = {x["doc_id"]: x["score"] for x in score_documents(docs.repartition(parts), states=3, rounds=4, top_words=6).collect()}
        assert all(abs(got[k] - want[k]) < 1e-6 for k in texts)


def test_training_goes_on_until_it_settles(spark, small):
    """No round is left out for its cost: the last gain is below the limit, all before it are not."""
    trace = []
    inner = LM.baum_welch
    docs = spark.read.parquet(f"{small}/documents.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(LM, "baum_welch", lambda coded, classes, states, rounds: inner(coded, classes, states, rounds, trace))
        score_documents(docs).count()
    gains = [(b - a) / abs(a) for a, b in zip(trace, trace[1:], strict=False)]
    assert 6 < len(trace) < LM.ROUNDS and gains[-1] < LM.SETTLED and all(g >= LM.SETTLED for g in gains[:-1])


def test_everyday_words_are_counted_apart_with_the_same_result(spark, monkeypatch):
    r = random.Random(6)
    texts = [(k, " ".join(r.choice(["the", "of", "and", f"rare{r.randrange(300)}"]) for _ in range(40))) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(LM, "CHUNK_CHARS", 300)
    plain = {x["doc_id"]: tuple(x) for x in score_documents(docs, states=2, rounds=2, top_words=5).collect()}
    monkeypatch.setattr(LM, "everyday_words", lambda chunk, inner=LM.everyday_words: inner(chunk, 10))
    apart = []
    monkeypatch.setattr(LM, "corpus_counts", lambda entry, words, inner=LM.corpus_counts: apart.extend(x["word"] for x in words.collect()) or inner(entry, words))
    other = {x["doc_id"]: tuple(x) for x in score_documents(docs, states=2, rounds=2, top_words=5).collect()}
    assert {"the", "of", "and"} <= set(apart) and len(apart) < 300
    assert plain.keys() == other.keys() and all(plain[k][:5] == other[k][:5] and abs(plain[k][5] - other[k][5]) < 1e-9 and abs(plain[k][6] - other[k][6]) < 1e-6 for k in plain)


def test_kept_alphas_change_nothing(monkeypatch):
    r = np.random.default_rng(1)
    lengths = r.integers(1, 60, 50)
    layout = hmm.Layout(r.integers(0, 9, lengths.sum()), np.concatenate(([0], np.cumsum(lengths))))
    model = hmm.seeded(r.random(9), 4)
    whole = hmm.expect(layout, *model, block=40)
    for held in (0, 300, 900):
        monkeypatch.setattr(hmm, "HELD", held)
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(whole, hmm.expect(layout, *model, block=40), strict=True))


def test_model_scores_do_not_depend_on_partitioning(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, four = ({r["doc_id"]: r["score"] for r in score_documents(docs.repartition(n, "source"), rounds=3).collect()} for n in (1, 4))
    assert one.keys() == four.keys() and all(abs(one[k] - four[k]) < 1e-6 * abs(one[k]) for k in one)


def test_classifier_on_held_out_rows(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = [r for r in classify(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    assert rows and sum((r["predicted"] == 1) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_classifier_learns_from_all_lines_of_a_bounded_sample(spark):
    """Good and bad documents that differ in their last line alone; repeated ids and a row beyond the bound don't matter."""
    same = "\n".join(f"a line of plain words number {k} for the reader" for k in range(300))
    rows = [(k, f"{same}\n" * (k % 2) + ("# $ % * | < > & # $ % * " * 40 if k % 2 else "and this is the end of the text as it was told to us " * 10)) for k in range(60)]
    rows += [(7, rows[7][1])] * 50 + [(1000, "x y\n" * 5000)]
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)] + [(1000, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(spark.createDataFrame(rows, "doc_id long, text string"), labels, train_docs=100, train_lines=3000).collect()
    last = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in last.values())
    assert min(last[k] for k in range(0, 60, 2)) > 0.5


def test_classifier_without_labels(spark, docs):
    none = labels_of(spark).where("false")
    assert {r["score"] for r in classify(docs, none).collect()} == {0.0, 0.5}


def test_encoding_equals_library_on_whole_table(spark, small):
    c = __import__("sentencepiece").SentencePieceProcessor(model_file=Q.PIECE_MODEL)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for r in encode_decode(docs, Q.PIECE_MODEL, with_ids=True).join(docs, "doc_id").collect():
        assert r["ids"] == c.encode(r["text"], add_bos=True, add_eos=True) and r["decoded"] == c.decode(r["ids"])


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, None)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 0, 3, "xyz uvw"), (1, 2, 7, 99, None)], "doc_id long, seq int, at long, remove long, insert string")
    got = {r["doc_id"]: r for r in count_tokens(gather_edits(docs, edits), Q.BYTE_RANKS, Q.BYTE_PATTERN, F.col("edits")).collect()}
    by = __import__("tempolane.llm.counting", fromlist=["x"]).counter(Q.BYTE_RANKS, Q.BYTE_PATTERN)
    assert got[1]["n_tokens_edited"] == len(by.encoding.encode_ordinary("xyz uvw")) and got[2]["n_tokens"] == 0


def test_edits_with_clashing_names_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "abc def", 5, 6, "k"), (None, "one two", 7, 8, "m"), (3, "", 1, 2, "n")], "doc_id long, text string, e int, e_id int, edits string")
    edits = spark.createDataFrame([(1, 1, 0, 0, "x "), (1, 1, 0, 0, "x "), (None, 1, 0, 3, "1"), (9, 1, 0, 0, "never")], "doc_id long, seq int, at long, remove long, insert string")
    rows = gather_edits(docs, edits)
    assert sorted(rows.columns) == sorted(docs.columns) and {(r["doc_id"], r["e"], r["e_id"]) for r in rows.collect()} == {(1, 5, 6), (None, 7, 8), (3, 1, 2)}
    got = {r["doc_id"]: (r["n_edits"], r["n_chars_edited"]) for r in count_tokens(rows, Q.BYTE_RANKS, Q.BYTE_PATTERN, F.col("edits")).collect()}
    assert got == {1: (2, 11), None: (1, 5), 3: (0, 0)}


def test_registered_edits_equal_a_recount(spark, small):
    """The registered query against edits of Python strings and the library's count, over the whole table; then a second batch on
    the stored trees of the first."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    encode = counting.counter(Q.BYTE_RANKS, Q.BYTE_PATTERN).encoding.encode_ordinary
    todo = {r["doc_id"]: (r["text"] or "", r["e"]) for r in docs.select("doc_id", "text", counting.review_edits().alias("e")).collect()}

    def edited(text, edits):
        for x in edits:
            at = min(max(0, x["at"]), len(text))
            text = text[:at] + (x["insert"] or "") + text[min(len(text), at + x["remove"]) :]
        return text

    got = {r["doc_id"]: r for r in Q.op2_token_counts(spark, small).collect()}
    assert len(got) == len(todo)
    for k, (text, edits) in todo.items():
        after = edited(text, edits)
        assert (got[k]["n_tokens"], got[k]["n_chars"], got[k]["n_tokens_edited"], got[k]["n_chars_edited"]) == (len(encode(text)), len(text), len(encode(after)), len(after))

    args = (Q.BYTE_RANKS, Q.BYTE_PATTERN)
    first = counting.store_trees(counting.edit_trees(counting.build_trees(docs, *args, [F.col("doc_id")]), *args, counting.review_edits(text_col="_text"), keep=True).select("doc_id", "_text", "_chars", "_tokens"))
    again = F.array(F.struct(F.lit(10).cast("long").alias("at"), F.lit(5).cast("long").alias("remove"), F.lit("of the 2nd").alias("insert")))
    for r in counting.edit_trees(first, *args, again, keep=True).collect():
        before = edited(*todo[r["doc_id"]])
        after = edited(before, [{"at": 10, "remove": 5, "insert": "of the 2nd"}])
        assert (r["n_tokens"], r["n_tokens_edited"], r["_text"]) == (len(encode(before)), len(encode(after)), after)
        assert r["n_encoded"] < 60 and counting.unpacked(bytes(r["_chars"])).sum() == len(after)


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/", None), (4, "http://d/", ""), (None, "http://e/", "only"), (6, "http://f/", "x\r\n\r\ny"), (6, "http://f/", "x\r\n\r\ny")], "page_id long, url string, html string")
    got = [r for r in archive_pages(pages).collect()]
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    assert len(got) == 7 and by[1][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == 2 and by[3][0]["refers_to"] == 4
    assert by[2][0]["record_type"] == by[4][0]["record_type"] == by[None][0]["record_type"] == "response" and [r["record_type"] for r in by[6]] == ["response"] * 2
    assert by[1][0]["payload_bytes"] == 8 and archive_pages(pages.where("false")).count() == 0


def test_archives_of_equal_rows_in_several_partitions_and_files(spark):
    schema = "page_id long, url string, html string"
    apart = spark.createDataFrame(spark.sparkContext.parallelize([(6, "http://f/", "x"), (None, "http://g/", "y")] * 3, 3), schema)
    assert collections.Counter(r["page_id"] for r in archive_pages(apart).collect()) == {6: 3, None: 3}
    one = spark.createDataFrame([(6, "http://f/", "x")], schema)
    large = one.withColumn("html", F.expr(f"repeat('x', {17 << 20})"))
    assert archive_pages(large.union(large).coalesce(1)).count() == 2


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>text</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(pages).collect()} == {(1, "", 0), (None, "text", 4)}
    assert extract_pages(pages.where("false")).count() == 0


def test_packing_holds_its_constraints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = best_fit(docs, Q.BYTE_RANKS, Q.BYTE_PATTERN, capacity=2048, per_source=2).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["bin_id"]].append(r)
    for bin_ in by.values():
        assert sum(r["tokens"] for r in bin_) == bin_[0]["bin_tokens"] <= 2048
        assert max(collections.Counter(r["source"] for r in bin_).values()) <= 2
        assert max(collections.Counter(" ".join(r["text"].lower().split()) for r in bin_).values()) == 1
    count = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, Q.BYTE_RANKS, Q.BYTE_PATTERN, F.lit(None).cast(EDITS)).collect()}
    tokens = collections.Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["tokens"]
    assert tokens == {k: n + 1 for k, n in count.items()}


def test_packing_equals_brute_force():
    """Against a search through all bins: of those with room and no conflict the tightest, of these the oldest."""
    r = random.Random(9)
    for per_source in (1, 2):
        items = sorted(((r.randrange(1, 130), r.choice([None, "a", "b", "c"]), r.choice([None, *range(30)])) for _ in range(400)), key=lambda x: -x[0])
        bins, want = [], []
        for size, source, cluster in items:
            while size > 100:
                size -= 100
            fits = [b for b in bins if b["room"] >= size and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"][source] < per_source)]
            best = min(fits, key=lambda b: (b["room"], b["age"]), default=None)
            if best is None:
                best = {"room": 100, "age": len(bins), "clusters": set(), "sources": collections.Counter()}
                bins.append(best)
            best["room"] -= size
            best["clusters"].add(cluster)
            best["sources"][source] += 1
            want.append(best["age"])
        assert [pieces[-1][1] for pieces in pack(items, 100, per_source)] == want


def test_packing_deals_a_hot_id_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr("tempolane.llm.packing.HOT_ROWS", 5)
    docs = spark.createDataFrame([(None if k % 2 else 7, f"text {k % 3}", "s") for k in range(60)], SCHEMA)
    rows = best_fit(docs, Q.BYTE_RANKS, Q.BYTE_PATTERN, shard_docs=10).collect()
    assert len(rows) == 60 and len({r["bin_id"].split("-")[0] for r in rows}) > 3
    own = best_fit(docs.withColumn("group", F.lit(1)), Q.BYTE_RANKS, Q.BYTE_PATTERN, cluster_col="group").collect()
    assert len({r["bin_id"] for r in own}) == 60


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3 if k % 2 else 9, k) for k in range(60)], "key int, v int")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("v").alias("top"))
    want = sorted(map(tuple, rows.join(facts, "key").collect()))
    monkeypatch.setattr(shared, "HOT_SHARE", 0.2)
    assert sorted(map(tuple, shared.join_facts(rows, facts, "key", "size", 60).collect())) == want
    monkeypatch.setattr(near, "PAIRS_PER_TASK", 4)
    sets = spark.createDataFrame([(k, bytes([k])) for k in range(70)], "node long, shingles binary")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(50, 51)], "a long, b long")
    got = near.with_sets(near.with_sets(pairs, sets, "a", "x", 40), sets, "b", "y", 40).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(map(tuple, pairs.collect())) and all((bytes(r["x"]), bytes(r["y"])) == (bytes([r["a"]]), bytes([r["b"]])) for r in got)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    r = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for k in range(40):
        w = base[: r.randrange(70, 101)]
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts[k] = " ".join(w)
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: max(g) for g in near_groups(texts) for k in g}


def near_groups(texts):
    """Sets of keys of texts whose five-word shingle sets are chained by a similarity of 0.8 or more, by all pairs."""
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    where = collections.defaultdict(set)
    for k, s in sets.items():
        for x in s:
            where[x].add(k)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [k for k, s in sets.items() if not s]
    for k in empty:
        root[k] = empty[0]
    for k, s in sets.items():
        for other in set().union(*(where[x] for x in s)) - {k}:
            both = len(s & sets[other])
            if both >= 0.8 * (len(s) + len(sets[other]) - both):
                root[find(k)] = find(other)
    groups = collections.defaultdict(set)
    for k in sets:
        groups[find(k)].add(k)
    return groups.values()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_classes_equal_brute_force_on_a_whole_table(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    want = {k: max(g) for g in near_groups(texts) for k in g}
    linked = [k for k in texts if want[k] != k]
    assert linked and sum(got[k] == want[k] for k in linked) >= 0.99 * len(linked)
    assert all(got[k] == want[k] or k in linked or want[k] == k for k in texts)


def test_pipeline_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "exact dedup", "near duplicates", "best-fit packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    source = docs.columns
    rules, labels = (corpus_pipeline.read(spark, small, t) for t in ("documents", "labels"))
    kept = [{r["doc_id"] for r in quality_rules(rules).where("kept").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, small), "test-stage")
        assert docs.columns == source
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(kept[1]) == kept[0]
    first = rules.join(docs.sparkSession.createDataFrame([(k,) for k in kept[1]], "doc_id long"), "doc_id", "left_semi")
    assert set(kept[2]) == {r["doc_id"] for r in classify(first, labels).where("predicted = 1").collect()}
    by_text = collections.defaultdict(set)
    for k, t in kept[2].items():
        by_text[t].add(k)
    assert set(kept[3]) == {max(g) for g in by_text.values()}
    assert set(kept[4]) == {max(g) for g in near_groups(kept[3])}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == set(kept[4])


WORDS = " ".join(f"word{k} of" for k in range(60))
OTHER = " ".join(f"thing{k} and" for k in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids with good and bad texts, rows equal in every column, null columns, a clashing column."""
    bad = "# $ % " * 40
    rows = [(1, WORDS, "en", "a", 1), (1, bad, "en", "a", 1), (None, OTHER, None, None, None), (None, bad, "en", "a", 1), (1, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (3, None, "en", "a", 1), (4, "", None, "a", 1), (5, WORDS + " tail", None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("row", F.lit("x"))


def test_stages_decide_by_row(spark, small, odd):
    left = lambda df: sorted(((r["doc_id"], (r["text"] or "")[:7]) for r in df.collect()), key=repr)
    rules = corpus_pipeline.stage_rules(spark, odd, small)
    assert left(rules) == [(1, "word0 o"), (1, "word0 o"), (2, "word0 o"), (5, "word0 o"), (None, "thing0 ")] and rules.columns == odd.columns
    assert left(corpus_pipeline.stage_exact(spark, odd, small)) == [(1, "# $ % #"), (2, "word0 o"), (4, ""), (5, "word0 o"), (None, "thing0 ")]
    assert left(corpus_pipeline.stage_near(spark, odd, small)) == [(1, "# $ % #"), (4, ""), (5, "word0 o"), (None, "thing0 ")]
    assert corpus_pipeline.stage_classifier(spark, odd, small).columns == odd.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), small).count() == 0


def test_packing_stage_takes_odd_rows(spark, small, odd):
    rows = corpus_pipeline.stage_packing(spark, odd, small).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == {1: 3, None: 2, 2: 1, 3: 1, 4: 1, 5: 1}


def test_tables_of_other_queries_outlive_a_pipeline_run(spark, small):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    setting, before = spark.conf.get(name), Q.QUERIES["op7_exact_dedup"](spark, small)
    first = corpus_pipeline.run(spark, small)
    second = corpus_pipeline.run(spark, small)
    assert before.count() == 200 and first.count() == second.count() > 0 and spark.conf.get(name) == setting


def test_rows_with_maps_pass_through_the_pipeline(spark):
    """Maps are hashed by their entries, at any depth, and decide whether rows are equal."""
    rows = [(k, BASE + f" number {k} " + " ".join(f"x{k}y{j}" for j in range(60)), {"a": k % 2, "b": 1}) for k in (1, 2, 3)] + [(1, BASE + " number 1 " + " ".join(f"x1y{j}" for j in range(60)), {"b": 1, "a": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").withColumn("n", F.array(F.struct(F.col("m").alias("inner"))))
    keys = [r["_key"] for r in shared.keyed(docs).orderBy("doc_id").collect()]
    assert keys[0] == keys[1] and len({str(k) for k in keys}) == 3
    kept = corpus_pipeline.stage_exact(spark, docs, "/root/testdata/sf0.001")
    assert kept.count() == 3 and kept.columns == docs.columns and kept.where("m['b'] = 1").count() == 3
