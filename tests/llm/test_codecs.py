"""Encoders, counters, filters, sketches and parsers without Spark."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from tempolane.llm import archives, crf, extract, hmm, packing, quotient, sketch
from tempolane.llm.counting import CountedText, counter
from tempolane.llm.near import shingles
from tempolane.llm.pieces import codec
from tempolane.llm.rules import base_counts
from tempolane.llm.words import WordHasher

PIECES = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("text", ["", " ", "  a  b", "a\tb\n\nc ▁x　y", "\U0001f600é\x00<0x41><s> </s>", "▁", " \n ▁▁ a", "a" * 500, "😀" * 40, " " * 70 + "x", "word, word. word! (x) #$% l'été"])
def test_agenda_equals_library(text):
    c = codec(PIECES)
    ids = c.library.encode(text, add_bos=True, add_eos=True)
    assert c.encode(text) == ids
    assert c.decode(ids) == c.library.decode(ids)
    assert c.encode_batch([text])[0][1].decode() == c.library.decode(ids)


@pytest.mark.parametrize("text", ["m².", "10 m².", "km². a", "a².b", "½.", "x³,y", "é².", "ª.º,", "a².\n²."])
def test_cuts_hold_for_characters_that_only_look_like_letters(text):
    c = codec(PIECES)
    assert c.encode(text) == c.library.encode(text, add_bos=True, add_eos=True)


def test_every_piece_before_every_mark_equals_library():
    c = codec(PIECES)
    marks = [*"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~", "\n", " "]
    texts = [p.replace("▁", " ") + m + "b" for p in c.id for m in (*marks[len(p) % 3 :: 3], "")]
    for k in range(0, len(texts), 20000):
        part = texts[k : k + 20000]
        for got, want in zip(c.encode_batch(part), c.library.encode(part), strict=True):
            assert got[0] == b"".join(i.to_bytes(4, "little") for i in want)


def test_every_last_character_before_every_mark_equals_library():
    c = codec(PIECES)
    texts = [f"a{x}{m}" for x in sorted({p[-1] for p in c.id}) for m in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"]
    for got, want in zip(c.encode_batch(texts), c.library.encode(texts), strict=True):
        assert got[0] == b"".join(i.to_bytes(4, "little") for i in want)


def test_edits_equal_recount():
    by, r = counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "9", "!", "é", " \t", "l", "　"]
    make = lambda n: "".join(r.choice(parts) for _ in range(n))
    for _ in range(400):
        text = make(r.randint(0, 60))
        tree = CountedText(text, by)
        for _ in range(5):
            at, remove, insert = r.randint(-2, len(text) + 2), r.choice([0, 1, 3, 9]), make(r.choice([0, 1, 4]))
            tree.edit(at, remove, insert)
            at = min(max(0, at), len(text))
            text = text[:at] + insert + text[at + remove :]
            assert tree.text() == text
            assert tree.tokens == len(by.encoding.encode_ordinary(text))


def test_edits_at_one_place_stay_cheap_and_trees_survive_storage():
    """Thousands of insertions at one place, the tree packed and unpacked between batches of them."""
    from tempolane.llm.counting import packed, unpacked

    by = counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r, text = random.Random(6), "some words, then more\n" * 300
    tree = CountedText(text, by)
    for turn in range(1500):
        insert, at = r.choice(["a", " bc", "\n", "12", "é ", ", x y z"]), 3000 + r.randrange(4)
        tree.edit(at, 0, insert)
        text = text[:at] + insert + text[at:]
        if turn % 250 == 0:
            whole, *sizes = tree.parts()
            encoded = tree.encoded
            tree = CountedText(whole, by, *(unpacked(packed(x)) for x in sizes))
            tree.encoded = encoded
    assert tree.text() == text and tree.tokens == len(by.encoding.encode_ordinary(text)) and tree.chars == len(text)
    assert tree.encoded < 1500 * 250
    for values in ([], [0], [255], [256, 1], [70000]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values


def test_edit_touches_a_region_only():
    by = counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tree = CountedText("some words " * 5000, by)
    tree.edit(20000, 3, "x")
    assert tree.encoded < 30


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times, mark = {}, [0] * len(words)
    for k in range(len(words) - 2):
        times.setdefault(tuple(words[k : k + 3]), []).append(k)
    for at in times.values():
        if len(at) > 1:
            for k in at:
                mark[k] = mark[k + 1] = mark[k + 2] = 1
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(mark)]


def test_base_counts_equal_brute_force():
    r = random.Random(2)
    texts = ["", "a", "\x1c b", "a b c a b c"] + ["".join(r.choice(["a ", "b ", "c\n", "é", "#", "\t", "\x0b", "\n"]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    got = base_counts(texts, WordHasher())
    for k, t in enumerate(texts):
        assert [int(g[k]) for g in got] == brute_base(t)


def test_words_longer_than_the_tables():
    h = WordHasher()
    data = np.frombuffer(b"x" * 5000 + b" y", np.uint8)
    s, e = h.spans(data)
    assert list(e - s) == [5000, 1]
    assert len(set(h.hashes(data, s, e).tolist())) == 2


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 500, dtype=np.uint64)
    rows = rng.choice(pool, 3000)
    want = dict(zip(*np.unique(rows, return_counts=True), strict=True))
    for parts in (1, 2, 7):
        filters = [quotient.build(*quotient.tally(x)) for x in np.array_split(rows, parts)]
        found, counts = quotient.entries(quotient.merge(filters))
        assert dict(zip(found, counts, strict=True)) == want
    crowded = np.arange(300, dtype=np.uint64)  # one quotient holds them all
    found, counts = quotient.entries(quotient.build(*quotient.tally(np.concatenate([crowded, crowded]))))
    assert (found == crowded).all() and (counts == 2).all()
    assert len(quotient.entries(quotient.merge([]))[0]) == 0


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
    sets = [np.sort(np.concatenate([shared, x])) for x in (a, b)]
    owner = np.repeat([0, 1], [len(x) for x in sets])
    got = sketch.sketches(owner, np.concatenate(sets), np.ones(len(owner)), 2, 4096)
    assert abs((got[0] == got[1]).mean() - 160 / 200) < 0.03
    weights = np.array([3.0, 1.0, 1.0, 1.0, 3.0])  # {x: 3/4, y: 1/4} and {x: 1/5, y: 1/5, z: 3/5}
    got = sketch.sketches(np.array([0, 0, 1, 1, 1]), np.array([7, 8, 7, 8, 9], np.uint64), weights, 2, 20000)
    want = sum(1 / sum(max(p[d] / p[k], q[d] / q[k]) for d in range(3)) for p, q in [((0.75, 0.25, 0), (0.2, 0.2, 0.6))] for k in (0, 1))
    assert abs((got[0] == got[1]).mean() - want) < 0.02
    assert (sketch.sketches(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 2, 8) == 0).all()


def test_shingles_of_short_and_empty_texts():
    owner, shingle, times = shingles(["", "a b", "a b", "a b c d e a b c d e", "b a"], WordHasher())
    assert owner.tolist() == [1, 2, 3, 3, 3, 3, 3, 4]
    assert shingle[0] == shingle[1] != shingle[-1]
    assert times.sum() == 1 + 1 + 6 + 1


def test_hmm_recursions_equal_enumeration():
    rng = np.random.default_rng(0)
    start, move, emit = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 3, 2).T
    symbols, starts = np.array([0, 2, 1, 1, 0]), np.array([0, 3, 3, 5])
    layout = hmm.Layout(symbols, starts)
    got = hmm.forward(layout, start, move, emit)
    import itertools

    for k in range(3):
        seq = symbols[starts[k] : starts[k + 1]]
        total = sum(np.prod([(start[p[i]] if i == 0 else move[p[i - 1], p[i]]) * emit[s, p[i]] for i, s in enumerate(seq)]) for p in itertools.product(range(2), repeat=len(seq))) if len(seq) else 1.0
        assert abs(got[k] - np.log10(total)) < 1e-9
    before = hmm.expect(layout, start, move, emit)
    assert abs(before[2].sum() - 5) < 1e-9 and abs(before[1].sum() - 3) < 1e-9
    after = hmm.normalise(*before[:3], prior=1e-9)
    assert hmm.expect(layout, *after)[3] >= before[3]


def test_crf_marginals_equal_enumeration():
    import itertools

    odds, table = np.array([0.5, -1.0, 2.0]), np.array([[0.3, -0.2], [0.1, 0.4]])
    got = crf.marginals(odds, np.array([0, 3]), table)[0]
    score = {p: np.exp(sum(o * y for o, y in zip(odds, p, strict=True)) + sum(table[a, b] for a, b in zip(p, p[1:], strict=False))) for p in itertools.product((0, 1), repeat=3)}
    for k in range(3):
        assert abs(got[k] - sum(v for p, v in score.items() if p[k]) / sum(score.values())) < 1e-9


def test_arc_versions_convert():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\nX-Page-Id: 7\r\n\r\nhello"
    for version in (1, 2):
        data = archives.arc_header(version, "x.arc.gz", "20000101000000") + archives.arc_record(version, "http://a/", "20000102030405", "text/html", block, 9, "x.arc.gz")
        (record,) = archives.parse_arc(data)
        assert record.block == block and record.code == ("200" if version == 2 else "")
        warc = archives.to_warc(record, "7", None) + archives.to_warc(record, "7", "9")
        (one, body), (two, head) = archives.parse_warc(warc)
        assert body == block and one["warc-type"] == "response" and one["warc-date"] == "2000-01-02T03:04:05Z"
        assert one["warc-payload-digest"] == two["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
        assert two["warc-type"] == "revisit" and head.endswith(b"\r\n\r\n") and two["x-refers-to-page-id"] == "9"
    members = b"".join(gzip.compress(x) for x in (b"a", b"", b"b" * 100000))
    assert archives.gunzip(members) == b"a" + b"b" * 100000


@pytest.mark.parametrize("data", [b"no header", b"filedesc://x 0.0.0.0 2000 text/plain 999\n1 0 x\n", b"http://a/ 0.0.0.0 2000 text/html 3\nabc\n"])
def test_malformed_arc_is_refused(data):
    with pytest.raises(ValueError):
        list(archives.parse_arc(data))


def test_main_text_leaves_the_rest_out():
    body = "".join(f"<p>Paragraph {k}, with commas, and <a href=x>a link</a> &amp; more text to read{'.' * k}</p>" for k in range(6))
    page = f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav><div class='sidebar'><p>{'related, ' * 40}</p></div><div id=content><h1>Head\n line</h1>{body}<aside>aside</aside><form><input>search</form></div><div class='comments'><p>{'nice, ' * 60}</p></div><div class='cookie-notice'>cookies</div><footer>foot</footer></body></html>"
    want = "Head line " + " ".join(f"Paragraph {k}, with commas, and a link & more text to read{'.' * k}" for k in range(6))
    assert extract.main_text(page) == want
    assert extract.main_text("") == "" and extract.main_text("<p") == "<p"
    assert extract.main_text("<article><p>un<b>closed<br>text") == "unclosed text"


def test_best_fit_takes_the_tightest_compatible_bin():
    items = [(6, "a", 1), (5, "b", 2), (4, "a", 3), (4, "c", 1), (3, "a", 4)]
    bins = [x[-1][1] for x in packing.pack(items, 10, 1)]
    # 4 of a: bin 0 has room 4 but source a; bin 1 has room 5. 4 of c: bin 0 holds cluster 1; a new bin.
    assert bins == [0, 1, 1, 2, 2]
    assert packing.pack([(25, None, None)], 10, 1) == [[(0, -1, 10), (1, -2, 10), (2, 0, 5)]]
    assert [x[-1][1] for x in packing.pack([(10, "s", 5)] * 3, 10, 2)] == [0, 1, 2]
