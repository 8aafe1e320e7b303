"""Resampling, personal data and vector codes: plain versions of whole queries, odd rows, empty tables, long texts."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolane.llm import private, resampling, vectors
from tempolane.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- resampling


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def naive_resample(docs, target):
    def bucket(w):
        return zlib.crc32(w.encode()) % 10000

    s, t = np.zeros(10000), np.zeros(10000)
    for total, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for w in words_of(text):
                total[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for k, (i, text) in enumerate(docs):
        words = words_of(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in words)
        rows.append([i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[4]: n for n, r in enumerate(able[: 10 * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(r[4])) for r in rows), key=repr)


def got_rows(df):
    return sorted((tuple(r[:5]) for r in df.collect()), key=repr)


def test_resampling_equals_plain_python(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got_rows(Q.op11_importance_resampling(spark, SF)) == naive_resample(docs, target)


def test_resampling_of_odd_rows(spark):
    r = random.Random(5)
    text = " ".join(r.choice(["Ärger", "word", "x1", "FOO"]) for _ in range(60))
    rows = [(k, text if k % 3 else " ".join(r.choice("abcdefgh") for _ in range(30))) for k in range(40)]
    rows += [(None, text), (7, text), (7, text), (50, None), (51, ""), (52, "w" * 100_000 + " " + "é" * 50_000), (53, "few words"), (54, "A a-a_a " * 40_000)]
    clash = {c: F.lit("clash") for c in ("id", "row", "weight", "score", "rank", "place", "n_words", "_at")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    target = spark.createDataFrame([("foo ärger é",), (None,), ("w" * 100_000,)], "text string")
    assert got_rows(resampling.resample(docs, target)) == naive_resample(rows, [x[0] for x in target.collect()])
    assert resampling.resample(docs.where("false"), target).count() == 0
    assert got_rows(resampling.resample(docs, target.where("false"))) == naive_resample(rows, [])


def test_planes_and_spans():
    r = np.random.default_rng(3)
    owner, bucket = r.integers(0, 700, 30_000), np.minimum(r.geometric(0.01, 30_000), 9_999)
    gain = r.integers(-30_000, 30_000, 10_000)
    signed = resampling.planes(np.maximum(gain, 0)), resampling.planes(np.maximum(-gain, 0))
    want = np.zeros(700, np.int64)
    np.add.at(want, owner, gain[bucket])
    assert (resampling.weights(owner, bucket, 700, signed) == want).all()
    words = [r.bytes(int(n)) for n in r.integers(1, 90, 500)]
    ends = np.cumsum([len(w) for w in words])
    got = resampling.crc32_of_spans(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(w) for w in words]
    pairs = resampling.features(["A b a", "b A", "a"], longest_run=2)
    assert sorted(zip(pairs[0].tolist(), pairs[1].tolist(), strict=True)) == sorted([(k, zlib.crc32(w) % 10000) for k, ws in enumerate([[b"a", b"b", b"a", b"a b", b"b a"], [b"b", b"a", b"b a"], [b"a"]]) for w in ws])


def test_ranks_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = spark.range(5000).select(F.col("id"), (F.col("id") % 50).alias("score"))
        got = resampling.ranked(rows, [F.desc("score"), F.asc("id")], 7_000_000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == sorted(range(5000), key=lambda k: (-(k % 50), k))
    assert sorted(r["place"] for r in got) == list(range(1, 5001))


# -- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive_entities(text):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    def right(x):
        return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(x)))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and right(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_entities_equal_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        letters = r.choice(["a@. -", "ab@.c@1", "01.2.5", "123 -4", "+1() .-2", "a1@.+ -(é"])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert private.entities(text) == naive_entities(text), text


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 10**6, "@a.b" * 200_000, "+1" * 10**6, "a@" * 500_000, "1 " * 10**6, "+1 " * 10**6], ids=lambda t: t[:4])
def test_entities_of_long_texts_in_linear_time(text):
    began = time.time()
    private.entities(text)
    assert time.time() - began < 10


def naive_personal(rows):
    """spans of every row by plain loops; rows: (id, text)."""
    docs = []
    for _, text in rows:
        text, found = text or "", naive_entities(text or "")
        free = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        every = {x[2] for x in free}
        free = [x for x in free if not any(x[0] < b and x[1] > a for a, _, b in found)]
        near = []
        for a, kind, b in found:
            value = (kind, text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b]))
            around = [x for x in free if x[1] <= a][-private.WINDOW :] + [x for x in free if x[0] >= b][: private.WINDOW]
            near += [(value, tuple(x[2] for x in around), x) for x in around]
        values = {(kind, text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b])) for a, kind, b in found}
        docs.append((found, every, near, values))
    n, action = len(docs), {}
    for pair in {(v, x[2]) for d in docs for v, _, x in d[2]}:
        with_pair = [d for d in docs if any((v, x[2]) == pair for v, _, x in d[2])]
        different = {c for d in with_pair for v, c, x in d[2] if (v, x[2]) == pair}
        holders, holding = sum(pair[0] in d[3] for d in docs), sum(pair[1] in d[1] for d in docs)
        if len(different) >= 3 and len(different) >= 0.5 * len(with_pair) and holders < n:
            share = math.log2(len(with_pair) * n / (holders * holding)) / math.log2(n / holders)
            if share >= private.GENERALISE:
                action[pair] = 5 if share >= private.REMOVE else 4
    out = []
    for (i, _), (found, _, near, _) in zip(rows, docs, strict=True):
        extra = {}
        for v, _, x in near:
            if (v, x[2]) in action:
                extra[x[:2]] = max(extra.get(x[:2], 0), action[v, x[2]])
        every = sorted(found + [(a, k, b) for (a, b), k in extra.items()])
        named = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in every)
        base = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in found)
        out.append((i, *(sum(k == kind for _, k, _ in found) for kind in range(4)), hashlib.sha256(base.encode()).hexdigest(), named))
    return sorted(out, key=repr)


def people(seed=2):
    """Two persons whose names stand near their addresses in differing texts; copies, and texts of other people."""
    r = random.Random(seed)

    def noise(n):
        return " ".join(r.choice(["the", "of", "and", "to", "in", "it", "was", "for", "on", "as"]) for _ in range(n))

    texts = []
    for _ in range(8):
        texts.append(f"{noise(30)} Zarblatt, {noise(2)} (zar.b@mail.example.org) {noise(20)} Qumba {noise(30)}")
    for _ in range(6):
        texts.append(f"{noise(20)} call Ünderhill {noise(3)} +1 (743) 555-3824 or 10.0.0.1; {noise(40)}")
    texts += [f"{noise(12)} Ünderhill {noise(12)}"] * 2
    texts += [f"{noise(5)} hapaxword x.y@z.example 4111 1111 1111 1111 {noise(5)}"] * 9
    texts += [noise(60) for _ in range(40)]
    return [(k, t) for k, t in enumerate(texts)]


def test_disclosing_terms_equal_plain_loops(spark):
    rows = people() + [(None, None), (3, ""), (None, "a@b.c"), (5, people()[0][1]), (5, people()[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "h1", "key", "spans", "base", "pairs", "who", "added", "_h1")})
    got = sorted((tuple(r) for r in private.span_report(docs).collect()), key=repr)
    assert got == naive_personal(rows)
    by_id = {r[0]: r for r in got if r[0] is not None}
    text = rows[0][1]
    assert f"remove:{text.index('Zarblatt')}:{text.index('Zarblatt') + 8}" in by_id[0][6] and f"email:{text.index('zar.b')}:{text.index(')')}" in by_id[0][6]
    # The name of the second person occurs elsewhere too, so it tells less; words of one text's copies tell nothing.
    assert "generalise" in by_id[9][6] or "remove" in by_id[9][6]
    copied = next(r for r in got if r[0] == 17)
    assert (copied[1], copied[3]) == (1, 1) and "remove" not in copied[6] and "generalise" not in copied[6]
    assert all(r[6] == "" for r in got if r[0] is not None and r[0] >= 26)
    assert private.span_report(docs.where("false")).count() == 0


def test_a_full_bitmap_changes_nothing(spark):
    docs = spark.createDataFrame(people(), "doc_id long, text string")
    one, two = (sorted((r["doc_id"], str(r["spans"])) for r in private.personal_data(docs, bits=b).collect()) for b in (24, 6))
    assert one == two


def test_sanitised_texts(spark):
    docs = spark.createDataFrame([*people(), (90, None)], "doc_id long, text string").withColumn("more", F.create_map(F.lit("k"), F.lit(1)))
    out = {r["doc_id"]: r["text"] for r in private.sanitised(docs).collect()}
    assert "Zarblatt" not in out[0] and "[EMAIL]" in out[0] and "[PHONE]" in out[9] and "[IP]" in out[9]
    assert out[90] is None and out[40] == people()[40][1] and "hapaxword [EMAIL] [CARD]" in out[17]


def test_personal_data_of_the_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in Q.op12_personal_data(spark, SF).collect()), key=repr) == naive_personal(rows)


# -- vector codes


def naive_codes(rows, entries=64, rounds=2, parts=16):
    """(id, code, error, label_error, digest) by plain loops; rows: (id, vector, label)."""
    kept = [(i, [max(-vectors.LARGEST, min(vectors.LARGEST, math.floor(256 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [near(p, c[p])[1] for c in cut]
            members = [[c[p] for c, k in zip(cut, chosen, strict=True) if k == entry] for entry in range(len(books[p]))]
            books[p] = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else e for m, e in zip(members, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    final = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, final, errors, strict=True)), key=repr)


def codes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_codes_of_odd_rows(spark):
    r = random.Random(9)
    rows = [(k, [r.gauss(0, 1) for _ in range(32)], r.choice([1, 2, None])) for k in range(150)]
    rows += [(200 + k, rows[3][1], 2) for k in range(60)] + [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[7][1], None), (None, None, 1), (301, None, 1)]
    rows += [(302, [float("nan")] * 32, 1), (303, [float("inf")] + [0.0] * 31, 1), (304, [None] + [0.0] * 31, 1), (305, [0.5] * 7, 3), (306, [], 3), (307, [1e30] * 32, 4), (308, [0.0] * 33, 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("id", "row", "part", "member", "entry", "nearest", "same", "size")})
    assert codes(vectors.compress(table)) == naive_codes(rows)
    assert codes(vectors.compress(table.where("vec_id < 20"))) == naive_codes([x for x in rows if x[0] is not None and x[0] < 20])
    assert vectors.compress(table.where("false")).count() == 0 and vectors.compress(table.where("vec_id = 301")).count() == 0
    assert codes(vectors.compress(table, entries=9, rounds=4, owned=7)) == naive_codes(rows, 9, 4)
    assert codes(vectors.compress(table, rounds=0)) == naive_codes(rows, rounds=0)


def test_only_movers_are_shuffled(spark, monkeypatch):
    """After the first deal, what is dealt is what changed its entry."""
    sizes = []
    deal = vectors.dealt
    monkeypatch.setattr(vectors, "dealt", lambda m, salts: sizes.append(m.count()) or deal(m, salts))
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    vectors.compress(spark.read.parquet(f"{SF}/embeddings.parquet"), rounds=3).count()
    assert sizes[0] == 16 * n and len(sizes) == 3 and 0 < sizes[2] < sizes[1] < sizes[0]


def test_codes_equal_plain_python(spark):
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None, r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert codes(Q.op13_vector_codes(spark, SF)) == naive_codes(rows)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_vector_codes"])
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, Q.QUERIES[name](spark, SF).select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
