"""Multi-table parsers on small pages: evidence, refusals, places on a page, one pass for all tables."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tempolane.sources import pages as G
from tempolane.sources.documents import ParseError

LIVE = {"selKaisai": "20260616", "selKjyoCd": "56", "selRaceNo": 1, "flgRaceCancel": False, "flgSectionCancel": False, "C0201race": [{"raceNo": 1, "flgRaceEnd": True, "rcvKekka": "1", "rcvRefund": "1"}]}
ROW = {"tyaku": "1", "syaban": "3", "sensyuRegistNo": "000003", "kojinStateItemSubData": []}


def scripts(**values):
    return "<html><script>" + "".join(f'jsonData["{k}"] = {json.dumps(v, ensure_ascii=False)};' for k, v in values.items()) + "</script></html>"


def live(context=None, **data):
    return scripts(PC0201={"C0201data": LIVE | (context or {})}, PJ0326={"resultCd": 0, "tyakujyunDispFlg": True, "haraiGakuDispFlg": True, "tyakujyunItemSubData": [ROW], "haraiGakuSubData": {}} | data)


@pytest.mark.parametrize(("context", "data", "status"), [
    ({}, {}, "CONFIRMED"),
    ({"flgRaceCancel": "1", "statusText": "確定"}, {}, "CANCELLED"),
    ({"flgSectionCancel": 1}, {}, "CANCELLED"),
    ({"inner": {"raceState": "審議中"}}, {"message": "訂正"}, "CORRECTED"),
    ({"raceName": "訂正"}, {"list": [{"condition": "暫定"}]}, "PROVISIONAL"),
    ({"C0201race": [{"raceNo": 9}, {"raceNo": 1, "flgRaceEnd": False, "rcvKekka": "0"}]}, {"tyakujyunDispFlg": False}, "UNAVAILABLE"),
    ({"flgRaceCancel": None}, {}, None),
    ({}, {"resultCd": 1}, None),
])
def test_status_by_flags_words_and_receipts(context, data, status):
    out = G.live_result(live(context, **data))
    top = out["context"][0]
    assert top["status"] == status and bool(out["results"]) == (status in G.WITH_RESULTS)
    assert top["page_state"] == ("RESULTS_AVAILABLE" if status in G.WITH_RESULTS else "CANCELLED" if status == "CANCELLED" else "UNAVAILABLE")


def test_live_rows_and_payouts():
    rows = [ROW, ROW | {"syaban": "4"}, ROW | {"syaban": "5", "tyaku": "", "kojinStateItemSubData": [{"kojinState": "落車棄権"}]}]
    pay = {"RT3HaraiGakuDispItemSubData": [{"kumiBan": "1-2-5", "haraiGaku": "１, 80", "ninki": "(4)"}, {"kumiDispFlg": 0, "haraiGaku": "【未発売】"}, {"kumiBan": "1-2-3", "haraiGaku": "90"}]}
    out = G.live_result(live(tyakujyunItemSubData=rows, haraiGakuSubData=pay))
    assert [(r["bike"], r["rank"], r["status"]) for r in out["results"]] == [(3, 1, "TIED"), (4, 1, "TIED"), (5, None, "CRASHED")]
    assert [(p["amount"], p["popularity"], p["sequence"]) for p in out["payouts"]] == [(180, 4, 1), (90, None, 3)]
    for bad in ({"tyakujyunItemSubData": []}, {"tyakujyunItemSubData": [ROW | {"tyaku": "", "kojinStateItemSubData": [{"kojinState": "?"}]}]}, {"haraiGakuSubData": {"RT3HaraiGakuDispItemSubData": [{"kumiBan": "1", "haraiGaku": "未発売"}]}}, {"tyakujyunItemSubData": [ROW | {"sensyuRegistNo": 3}]}):
        with pytest.raises(ParseError):
            G.live_result(live(**bad))


def meeting(**more):
    data = {"selKaisai": "20260101", "selKjyoCd": "56", "selRaceNo": 1, "C0201kaisai": [{"txtEventDate": "12/31", "encParaK": "a"}, {"txtEventDate": "01/01", "encParaK": "b"}], "C0201race": [{"encParaR": "r", "flgRaceEnd": 1, "rcvKekka": 1}]}
    return json.dumps({"resultCd": 0, "C0201data": {k: v for k, v in (data | more).items() if v != "drop"}})


def test_days_take_the_near_year():
    out = G.day_metadata(meeting())
    assert [(d["race_date"], d["selected"]) for d in out["days"]] == [("2025-12-31", False), ("2026-01-01", True)] and out["races"][0]["ended"]
    assert G.near_date("06/30", date(2026, 1, 1)) == date(2026, 6, 30)  # 180 days
    assert G.near_date("07/01", date(2026, 1, 1)) == date(2025, 7, 1)  # 181 days
    assert G.near_date("01/01", date(2025, 12, 31)) == date(2026, 1, 1)
    for bad in ("2/30", "02/30", None, "13/01"):
        with pytest.raises(ParseError):
            G.near_date(bad, date(2026, 1, 1))


OFF = {"flgRaceCancel": True, "flgSectionCancel": False, "cntRace": 0}


@pytest.mark.parametrize(("more", "state"), [
    (OFF | {"hhMessage": "中止となりました。", "selRaceNo": 0, "C0201race": "drop"}, "CANCELLED"),
    (OFF | {"hhMessage": "中止となりました", "selRaceNo": 0, "C0201race": None}, "CANCELLED"),
    (OFF | {"hhMessage": "中止となりました。"}, "CANCELLED"),
    (OFF | {"hhMessage": "順延となりました。"}, "POSTPONED"),
    ({"hhMessage": "1レースは中止となりました。"}, "HELD"),
    (OFF | {"hhMessage": "中止となりました。", "C0201race": "drop"}, None),
    (OFF | {"hhMessage": "中止かも"}, None),
    (OFF | {"hhMessage": "順延となりました。", "selRaceNo": 0, "C0201race": []}, None),
    (OFF | {"hhMessage": "中止となりました。", "cntRace": 2}, None),
    (OFF | {"hhMessage": "中止となりました。", "C0201race": [{"encParaR": "r", "flgRaceEnd": 0, "rcvKekka": 1}]}, None),
    ({"C0201kaisai": [{"txtEventDate": "01/01", "encParaK": "a"}, {"txtEventDate": "01/01", "encParaK": "b"}]}, None),
    ({"C0201race": []}, None),
])
def test_meetings_that_are_not_held_need_their_evidence(more, state):
    if state is None:
        with pytest.raises(ParseError):
            G.day_metadata(meeting(**more))
    else:
        out = G.day_metadata(meeting(**more))
        assert out["context"][0]["state"] == state and len(out["days"]) == 2 and bool(out["races"]) == (state != "CANCELLED")


@pytest.mark.parametrize(("root", "state"), [
    ({"resultCd": 0, "syusouDispFlag": 0, "kaisaiMsg": "中止となりました。", "reqprm": {"bkcd": "56", "kday": "20260616"}}, "CANCELLED"),
    ({"resultCd": "0", "syusouDispFlag": False, "kaisaiMsg": "打切となりました", "rInfo": None, "reqprm": {"bkcd": 48, "kday": "20210829"}}, "TERMINATED"),
    ({"resultCd": 0, "syusouDispFlag": 0, "kaisaiMsg": "明日に順延"}, "POSTPONED"),
    ({"resultCd": 0, "syusouDispFlag": 1, "kaisaiMsg": "中止となりました。", "reqprm": {"bkcd": "56", "kday": "20260616"}}, None),
    ({"resultCd": 0, "syusouDispFlag": 0, "kaisaiMsg": "中止となりました。", "keirinCd": "56", "reqprm": {"bkcd": "56", "kday": "20260616"}}, None),
    ({"resultCd": 0, "syusouDispFlag": 0, "kaisaiMsg": "中止となりました。", "reqprm": {"bkcd": "56", "kday": "20260631"}}, None),
    ({"resultCd": 1}, None),
    ([], None),
])
def test_days_that_are_not_held(root, state):
    if state is None:
        with pytest.raises(ParseError):
            G.entry_list(json.dumps(root))
    else:
        assert G.entry_list(json.dumps(root))["day"][0]["state"] == state


def test_result_pages_speak_for_themselves():
    table = "<table><tbody id='pitbodyBs'><tr><td>1</td><td></td><td>1</td><td>A</td></tr></tbody></table>"
    assert G.result_page("<p>結果未確定</p>" + table)["page"][0]["state"] == "UNDER_REVIEW" and not G.result_page("<p>開催中止</p>" + table)["results"]
    out = G.result_page(table + "<table><tbody id='pitbodyHarai'><tr><td>払戻なし</td></tr></tbody></table>")
    assert out["page"][0]["no_payouts"] and len(out["results"]) == 1 and out["payouts"] == []
    for bad in ("<p>中止</p>", "", table, "<table><tbody id='pitbodyBs'></tbody></table>払戻なし"):
        with pytest.raises(ParseError):
            G.result_page(bad)


def players(numbers, words="", link=None):
    cell = "".join(f"<table class='btn25pv2'><tr><td onclick=\"sensyuLink('{link or n}')\">x</td><td><span id='a:UNQ_orlabel_8'>名　前</span><span id='a:UNQ_orlabel_9'>{n}</span><span id='a:UNQ_orlabel_10'>S級S班</span></td></tr></table>" for n in numbers)
    return f"<html><title>選手検索結果</title>{cell}{words}</html>"


def test_list_pages_know_where_they_stand():
    form = "<input type='hidden' name='dppg' value='1'>"
    out = G.player_list(players([7, 8], "ページ 2/5"))
    assert (out["page"][0]["page"], out["page"][0]["last_page"]) == (2, 5) and out["players"][0]["name"] == "名 前"
    assert G.player_list(players([7, 8], form + "2件見つかりました"))["page"][0]["last_page"] == 1
    more = ["<a href='?dppg=2'>2</a>", "<button>次へ</button>", "<a onclick='pageChange(3)'>x</a>"]
    for bad in [players([7], form), players([7], form + "9件見つかりました"), players([7]), players([], "ページ 1/1"), players([7], "ページ 1/1", link=8), *(players([7], form + "1件見つかりました" + m) for m in more)]:
        with pytest.raises(ParseError):
            G.player_list(bad)
    assert G.player_list(players([7], form + "1件見つかりました<a disabled href='?dppg=2'>次へ</a>"))["page"][0]["last_page"] == 1


def test_tables_are_found_after_their_headings():
    root = G.D.tree("<div><p>級班の 履歴情報 です</p><div><table><tr><td>no</td></tr></table></div><table><tr><td>yes</td></tr></table></div>")
    assert G.own_rows(G.table_after(root, G.parents(root), "p", "級班の 履歴情報")) == [["yes"]] and G.table_after(root, G.parents(root), "p", "else") is None
    nested = G.D.tree("<table><thead><tr><th>a</th></tr></thead><tr><td>b<table><tr><td>c</td></tr></table></td></tr></table>").all("table")[0]
    assert G.own_rows(nested) == [["a"], ["bc"]]


def retired(said="<p>本選手は、2025年01月31日に引退しました。</p>", heading="プロフィール", number="012345", extra=""):
    return f"<div><div class='midasi1_fsz'>{heading}</div><p>2025/07/01 02:34 更新</p><table><tr><td><table><tr><td>氏名</td><td>府県</td><td>年齢</td><td>期別</td><td>級班</td><td>登録番号</td></tr><tr><td></td></tr><tr><td>合成　太郎</td><td>県</td><td>５３歳</td><td>71期</td><td>A級3班</td><td>{number}</td></tr></table></td></tr></table>{said}{extra}<div class='midasi1_fsz'>通算</div><p>2020/01/01 00:00 更新</p></div>"


def test_retired_players():
    row = G.retired_player(retired())["profile"][0]
    assert row == {"player": "012345", "name": "合成 太郎", "prefecture": "県", "age": 53, "period": "71", "grade": "A級3班", "retired_on": "2025-01-31", "updated": "2025-07-01 02:34"}
    other = "<p>本選手は、2024年01月31日に引退しました。</p>"
    for bad in (retired(""), retired(extra=other), retired(heading="別"), retired(number="12"), retired("<p>本選手は、2025年02月31日に引退しました。</p>"), retired().replace("<p>2025/07/01 02:34 更新</p>", "<p>2025/07/01 02:34 更新</p><b>2025/07/02 02:34 更新</b>")):
        with pytest.raises(ParseError):
            G.retired_player(bad)
    assert G.retired_player(retired(extra=other.replace("2024", "2025")))["profile"][0]["retired_on"] == "2025-01-31"


def test_one_pass_gives_all_tables_or_the_quarantine(spark):
    bodies = [("good", live()), ("two", live()), ("bad", live(haraiGakuSubData=None)), ("none", None), ("odd", "<html>")]
    docs = spark.createDataFrame(bodies, "url string, text string").select("url", F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("text", "UTF-8").alias("body"))
    out = G.parse_tables(docs, "live_result")
    assert {r["url"] for r in out.table("context").collect()} == {r["url"] for r in out.table("results").collect()} == {"good", "two"}
    assert out.table("payouts").count() == 0 and {r["url"] for r in out.quarantine().collect()} == {"bad", "none", "odd"}
    graded = G.parse_tables(spark.createDataFrame([("r", "text/html", bytearray(retired().encode()))], "url string, content_type string, body binary"), "retired_player").table("profile").first()
    assert graded["grade"] == "A3"


def test_plain_pages_are_read_without_the_library():
    """Plain markup goes the short way, and gives the library's tree; anything else is left to the library."""
    import random

    from tempolane.sources import documents as D

    def shape(node):
        out = []
        for x in node.inside:
            if isinstance(x, D.Node):
                out.append((x.tag, sorted(x.attrs.items(), key=str), shape(x)))
            elif out and isinstance(out[-1], str):
                out[-1] += x
            elif x:
                out.append(x)
        return out

    def library(html):
        t = D._Tree()
        t.feed(html)
        t.close()
        return t.open[0]

    parts = ["<p>", "</p>", "<td>", "</td>", "<tr class='a b'>", "<br>", "<br/>", "<!-- x -->", "<script>", "</script>", "<title>", "</title>", "&amp;", "& ", "&lt;x", "日本", "<", " > ", "\"", "<a href=\"?x=1&y=2\">", "<INPUT Value=\"Q\" disabled>", "<div id=\"a\"id=\"b\">", "<div id=\"a>b\">", "</p x>", "<o:p>", "<noscript>"]
    draw, plain = random.Random(11), 0
    for _ in range(20000):
        html = "".join(draw.choice(parts) for _ in range(draw.randint(1, 8)))
        found = D.plain_tree(html)
        plain += found is not None
        assert found is None or shape(found) == shape(library(html)), html
    assert plain > 1000
    page = "<html><script>x = {\"a\": 1};</script><p class='b'>1 &amp; 2</p></html>"
    assert D.plain_tree(page) is not None and D.tree(page) is D.tree(page)
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert len(D.tree(deep).all("div")) == 5000 and D.tree(deep).text() == "x"


def test_payout_pages_are_parsed_in_many_tasks(spark, small):
    """the races' numbers are few bytes; their pages are parsed in as many tasks as other shuffles have, not in one."""
    from tempolane import queries as Q

    parsed = Q.QUERIES["doc_payouts"](spark, small)
    assert parsed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
