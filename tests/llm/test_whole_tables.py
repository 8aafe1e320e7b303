"""Operators over whole tables against plain Python."""

import base64
import collections
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tempolane.llm import queries as Q
from tempolane.llm.extract import left_out_by, main_text
from tempolane.llm.rules import LINE_DOCS, REMAINING_SHARE

SF = "/root/testdata/sf0.01"


def lines_of(text):
    out = []
    for line in text.lower().split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if words:
            out.append((" ".join(words), len(words)))
    return out


def naive_rules(rows):
    """removed words and kept of every document, from whole lines instead of hashes; rows: (id, text, host)."""
    docs = [(k, h, lines_of(t or "")) for k, t, h in rows]

    def above(known):
        seen = collections.Counter()
        for host, page, line in set(known):
            seen[host, line] += 1
        return {x for x, n in seen.items() if n > LINE_DOCS}

    frequent = above((h, frozenset(x for x, _ in ls), x) for _, h, ls in docs for x, _ in ls)
    out = {}
    for (k, text, _), (_, h, ls) in zip(rows, docs, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = collections.defaultdict(list)
        for j in range(len(words) - 2):
            windows[tuple(words[j : j + 3])].append(j)
        repeated = {j + i for at in windows.values() if len(at) > 1 for j in at for i in range(3)}
        removed = sum(n for x, n in ls if (h, x) in frequent)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        out[k] = (len(words), removed, failed, not failed and len(words) - removed >= REMAINING_SHARE * len(words))
    return out


def test_quality_rules_equal_plain_python(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = naive_rules(rows)
    got = {r["doc_id"]: (r["n_words"], r["removed_words"], r["base_failed"], r["kept"]) for r in Q.op3_quality_rules(spark, SF).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_quality_rules_reject_what_plain_python_rejects(spark, tmp_path):
    """The table as one host, so that shared lines and near copies are frequent: some documents are rejected for them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("one"))
    template = "\n".join(f"notice {k} " + " ".join(f"t{k}x{j}" for j in range(15)) for k in range(9))
    pages = spark.createDataFrame([(10**6 + k, f"{template}\n" + " ".join(f"p{k}x{j}" for j in range(6))) for k in range(40)], "doc_id long, text string")
    docs.select("doc_id", "text", "source").unionByName(pages.withColumn("source", F.lit("one"))).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    want = naive_rules(rows)
    got = {r["doc_id"]: (r["n_words"], r["removed_words"], r["base_failed"], r["kept"]) for r in Q.op3_quality_rules(spark, str(tmp_path)).collect()}
    assert got == want and sum(not failed and not kept for _, _, failed, kept in want.values()) >= 40


def test_archives_equal_plain_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    last = {}
    for r in pages:
        body = (r["html"] or "").encode()
        last[body] = max(last.get(body, -1), r["page_id"])
    want = {}
    for r in pages:
        body = (r["html"] or "").encode()
        own = last[body] == r["page_id"]
        want[r["page_id"]] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else last[body])
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in Q.op5_warc(spark, SF).collect()}
    assert got == want


def test_extraction_equals_the_articles(spark):
    """Pages of the tables have one article each: its blocks' text is what must come out, to the letter."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as H

    for r in Q.op8_html_extraction(spark, SF).collect():
        article = re.search(r"<article[^>]*>(.*?)</article>", pages[r["page_id"]], re.S)
        assert article
        plain = re.sub(r"<!--.*?-->", "", re.sub(r"<(script|style)\b.*?</\1>", "", article[1], flags=re.S), flags=re.S)
        # Inline tags part no words, all others do.
        plain = re.sub(r"<[^>]+>", " ", re.sub(r"</?(?:a|b|i|em|strong|span|code|small|sub|sup|u)\b[^>]*>", "", plain))
        assert r["text"] == " ".join(H.unescape(plain).split()) and r["n_chars"] == len(r["text"])


BROKEN = {
    "starts": "<a " * 333_000, "slashes": "<svg/" * 200_000, "divs": "<div>" * 200_000, "ends": "<div>" * 100_000 + "</p>" * 100_000, "quotes": '<a ">"x' * 150_000, "walls": "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000,
    "bangs": "<!" * 500_000, "inline": "<b>" * 50_000 + "<p>some words, for the page and more of it" * 10_000, "number": "<p>&#" + "1" * 1_000_000, "open": "<a '" * 250_000 + ">", "paragraphs": "<p>" * 300_000, "raw": "<script>" * 120_000, "amp": "&" * 1_000_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    began = time.time()
    main_text(BROKEN[name])
    assert time.time() - began < 8


def test_names_leave_out_as_whole_words_only():
    assert all(map(left_out_by, ["ad", "x ad-slot", "site-footer", "comments-area", "cookie-notice", "left_sidebar", "related", "Social"]))
    assert not any(map(left_out_by, ["story related-study", "reading-list", "addendum", "header-image-of-story", "social-science", "adsorption", "shared-memory", "notice-of-meeting"]))
    page = '<body><div class="story related-study"><p>The only long text of the page, which goes on, with commas, for a good while.</p></div><p>T Short.</p></body>'
    assert main_text(page).startswith("The only long text")
    assert "kept" in main_text("<article><p>Some long text of the page, with commas, and so on and on.</p><p hidden>kept</p><p style='display:none'>kept</p></article>")


@pytest.mark.parametrize("name", ["op5_warc", "op8_html_extraction"])
def test_very_long_pages(spark, tmp_path, name):
    text = " ".join(f"word{k}, and" for k in range(200_000))
    rows = [(1, "http://a/", f"<nav><a href='x'>menu</a></nav><article><p>{text}</p></article>", "clash"), (2, None, None, "clash")]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in Q.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == 2 and (got[1]["text"] == text if name == "op8_html_extraction" else got[1]["payload_bytes"] == len(rows[0][2]))
