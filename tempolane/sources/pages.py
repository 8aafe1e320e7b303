"""Pages that hold several tables: one parse gives all of them, typed, or sends the page to quarantine.

A parser takes a page's text and returns its tables by name. ``parse_tables`` runs it once over all documents and writes what came
out; every table is then read from that, so that the tables of a page always belong together and no page is parsed twice.

Marked-up pages are read by what stands on them: a table is the one after a heading, or the one whose header row has certain
words, and a value is found by its column's word. Embedded data is read by key, with every type and range checked.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.functions import text as T
from tempolane.sources import documents as D
from tempolane.sources.documents import Node, ParseError, need
from tempolane.storage import materialise

# Keys of bets, words of states and of days that are not held, words of pages.
LIVE_BETS = {"WH2HaraiGakuDispItemSubData": "FRAME_QUINELLA", "WT2HaraiGakuDispItemSubData": "FRAME_EXACTA", "SH2HaraiGakuDispItemSubData": "QUINELLA", "ST2HaraiGakuDispItemSubData": "EXACTA", "RH3HaraiGakuDispItemSubData": "TRIO", "RT3HaraiGakuDispItemSubData": "TRIFECTA", "WHaraiGakuDispItemSubData": "QUINELLA_PLACE"}
NOT_PAID = ("【未発売】", "未発売", "【全返還】", "全返還")
STATUS_WORDS = {"訂正": "CORRECTED", "審議": "UNDER_REVIEW", "暫定": "PROVISIONAL", "確定": "CONFIRMED", "中止": "CANCELLED"}
DAY_WORDS = {"中止となりました": "CANCELLED", "打切となりました": "TERMINATED", "順延となりました": "POSTPONED"}
PAGE_WORDS = {"開催中止": "CANCELLED", "結果未確定": "UNDER_REVIEW", "結果未掲載": "UNAVAILABLE"}
GENDERS = {"男": "male", "男子": "male", "女": "female", "女子": "female"}
RETIRED_COLUMNS = ("氏名", "府県", "年齢", "期別", "級班", "登録番号")
DECIMAL = re.compile(r"[0-9]+(?:\.[0-9]+)?")
WITH_RESULTS = ("PROVISIONAL", "CONFIRMED", "CORRECTED")

# --- values -------------------------------------------------------------------------------------------------------------


def on(value: object) -> bool:
    return value is True or value == "1" or type(value) is int and value == 1


def off(value: object) -> bool:
    return value is False or value == "0" or type(value) is int and value == 0


def zero(value: object) -> bool:
    return value == "0" or type(value) is int and value == 0


def text(value: object) -> str | None:
    """Entities decoded, white space squeezed; NULL for nothing or a lone dash."""
    if type(value) is str:
        return short_words(value) if len(value) <= SHORT else words_of(value)
    return D.clean(str(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def words_of(value: str) -> str | None:
    return D.clean(entities.unescape(value).replace("\xa0", " ").replace("　", " "))


#: Texts up to so many characters are remembered: names of grades, places and states come again on every page.
SHORT = 32
short_words = lru_cache(maxsize=1 << 14)(words_of)


def figures(value: object, what: str, length: int | None = None) -> str:
    """A text of plain digits."""
    found = value if type(value) is str else str(value) if type(value) is int else ""
    if not (found.isascii() and found.isdigit() and (length is None or len(found) == length)):
        raise ParseError(f"{what} is missing or invalid")
    return found


def whole(value: object, low: int, high: int, what: str) -> int:
    found = figures(value, what)
    if not (len(found) < 10 and low <= int(found) <= high):
        raise ParseError(f"{what} is out of range")
    return int(found)


def blank_or(check: Callable, value: object, *more):
    """NULL for a blank or a dash, else what ``check`` makes of the value."""
    return None if value is None or value in ("", "－") else check(value, *more)


def decimal(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (str, int, float)) or not DECIMAL.fullmatch(str(value)):
        raise ParseError(f"{what} is invalid")
    return float(value)


def clock(value: object, what: str) -> str:
    need(isinstance(value, str) and re.fullmatch("(?:[01][0-9]|2[0-3]):[0-5][0-9]", value), f"{what} is invalid")
    return value


def loose_number(value: str | None) -> float | None:
    """The number in a cell with marks around it."""
    found = re.sub(r"[^0-9.\-]", "", (value or "").translate(D._NARROW))
    return float(found) if found else None


def rows_of(value: object, what: str) -> list[dict]:
    need(isinstance(value, list) and value and all(isinstance(x, dict) for x in value), f"{what} are missing or invalid")
    return value


def day_of(value: object, what: str) -> date:
    found = figures(value, what, 8)
    try:
        return date(int(found[:4]), int(found[4:6]), int(found[6:]))
    except ValueError as e:
        raise ParseError(f"{what} is no date") from e


def slashed(value: str | None) -> str | None:
    """A cell's yyyy/mm/dd as a date."""
    if value is None:
        return None
    try:
        return datetime.strptime(value.replace("-", "/"), "%Y/%m/%d").date().isoformat()
    except ValueError as e:
        raise ParseError(f"no date: {value}") from e


def updated_at(words: str) -> str | None:
    """The page's time of update as yyyy-mm-dd hh:mm."""
    found = re.search(r"([0-9]{4})/([0-9]{2})/([0-9]{2})\s+([0-9]{2}:[0-9]{2})\s*更新", words)
    return f"{found[1]}-{found[2]}-{found[3]} {found[4]}" if found else None


def squeezed(node: Node) -> str:
    return text(node.text()) or ""


# --- places on a page ---------------------------------------------------------------------------------------------------


def parents(root: Node) -> dict[int, Node]:
    """Each element's parent, by the element's identity."""
    return {id(x): up for up in [root, *root.walk()] for x in up.inside if isinstance(x, Node)}


def above(node: Node, up: dict[int, Node], tag: str, class_: str | None = None) -> Node:
    """The nearest element around ``node`` with a tag and, if asked for, a class."""
    at = up.get(id(node))
    while at is not None and not (at.tag == tag and (class_ is None or class_ in (at.attrs.get("class") or "").split())):
        at = up.get(id(at))
    need(at, f"no {tag} around {node.tag}")
    return at


def table_after(root: Node, up: dict[int, Node], tag: str, words: str) -> Node | None:
    """The first table among the elements that follow a heading with these words."""
    for heading in root.all(tag):
        if words in squeezed(heading):
            beside = [x for x in up[id(heading)].inside if isinstance(x, Node)]
            later = beside[next(k for k, x in enumerate(beside) if x is heading) + 1 :]
            return next((x for x in later if x.tag == "table"), None)
    return None


def own_rows(table: Node) -> list[list[str | None]]:
    """Cells of a table's own rows, without those of tables inside it."""
    parts = [x for x in table.inside if isinstance(x, Node)]
    rows = [r for p in parts for r in ([p] if p.tag == "tr" else [x for x in p.inside if isinstance(x, Node) and x.tag == "tr"] if p.tag in ("thead", "tbody", "tfoot") else [])]
    return [[text(c.text()) for c in r.inside if isinstance(c, Node) and c.tag in ("td", "th")] for r in rows]


# --- parsers ------------------------------------------------------------------------------------------------------------


def state_words(value: dict) -> Iterator[str]:
    """All texts under keys that speak of a status, at any depth."""
    for key, child in value.items():
        if isinstance(child, dict):
            yield from state_words(child)
        elif isinstance(child, list):
            for x in child:
                if isinstance(x, dict):
                    yield from state_words(x)
        elif isinstance(child, str) and re.search("status|state|message|condition", key, re.I):
            yield child


def decided(context: dict, result: dict) -> tuple[str | None, str]:
    """Status of a result and its evidence: cancellation flags, then words, then what was received and shown."""
    for flag in ("flgRaceCancel", "flgSectionCancel"):
        if on(context.get(flag)):
            return "CANCELLED", f"{flag} is set"
    words = " ".join([*state_words(context), *state_words(result)])
    for word, status in STATUS_WORDS.items():
        if word in words:
            return status, f"marker {word}"
    races, asked = context.get("C0201race"), str(context.get("selRaceNo"))
    own = None
    if isinstance(races, list) and asked.isdigit():
        own = next((r for r in races if isinstance(r, dict) and str(r.get("raceNo")) == asked), None)
        if own is None and 0 < int(asked) <= len(races) and isinstance(races[int(asked) - 1], dict):
            own = races[int(asked) - 1]
    if own is not None and off(context.get("flgRaceCancel")) and off(context.get("flgSectionCancel")):
        received, ended, shown = str(own.get("rcvKekka")) == "1", on(own.get("flgRaceEnd")), on(result.get("tyakujyunDispFlg"))
        if ended and received and str(own.get("rcvRefund")) == "1" and shown and on(result.get("haraiGakuDispFlg")) and zero(result.get("resultCd")):
            return "CONFIRMED", "race ended, result and refund received and shown"
        if not ended and not received and not shown:
            return "UNAVAILABLE", "race not ended and no result received"
    return None, "no evidence"


def live_result(page: str) -> dict[str, list[dict]]:
    """Context with status and evidence, results and payouts of a live page."""
    outer, data = D.embedded(page, "PC0201"), D.embedded(page, "PJ0326")
    context = outer.get("C0201data") if isinstance(outer, dict) else None
    need(isinstance(context, dict) and isinstance(data, dict), "context is missing")
    status, evidence = decided(context, data)
    shown, paid, wanted = on(data.get("tyakujyunDispFlg")), on(data.get("haraiGakuDispFlg")), status in WITH_RESULTS
    results = live_rows(data.get("tyakujyunItemSubData")) if wanted else []
    payouts = live_payouts(data.get("haraiGakuSubData")) if wanted and paid else []
    state = "RESULTS_AVAILABLE" if wanted else status if status in ("UNDER_REVIEW", "CANCELLED") else "UNAVAILABLE"
    top = {"race_date": day_of(context.get("selKaisai"), "selKaisai").isoformat(), "track": figures(context.get("selKjyoCd"), "selKjyoCd"), "race_no": whole(context.get("selRaceNo"), 1, 99, "selRaceNo"), "updated": text(data.get("lastUpdateTime")), "weather": text(data.get("tenki")), "wind": text(data.get("husoku"))}
    flags = {"results_shown": shown, "payouts_shown": paid, "no_payouts": shown and not paid, "results_complete": wanted and shown, "payouts_complete": wanted and (paid or not shown)}
    return {"context": [top | {"status": status, "evidence": evidence, "page_state": state} | flags], "results": results, "payouts": payouts}


def live_rows(value: object) -> list[dict]:
    rows = rows_of(value, "result rows")
    ranks = [blank_or(whole, r.get("tyaku"), 1, 99, "tyaku") for r in rows]
    out = []
    for r, rank in zip(rows, ranks, strict=True):
        states = r.get("kojinStateItemSubData") or []
        need(isinstance(states, list) and all(isinstance(s, dict) for s in states), "individual states are invalid")
        named = [x for x in (text(s.get("kojinState")) for s in states) if x]
        status = next((s for w, s in T.ENTRY_STATES.items() if w in " ".join(named)), None) if rank is None else "TIED" if ranks.count(rank) > 1 else "FINISHED"
        need(status, f"blank rank with an unknown state: {' '.join(named)}")
        need(isinstance(r.get("sensyuRegistNo"), str), "player number is invalid")
        words = {n: text(r.get(k)) for n, k in (("name", "sensyuName"), ("technique", "kimarite"), ("prefecture", "huken"), ("period", "sotugyouki"), ("grade", "kyuhan"), ("margin", "tyakusa"), ("finish_time", "agari"), ("back_home", "BH"), ("line_rank", "inLineJyuni"))}
        out.append({"bike": whole(r.get("syaban"), 1, 9, "syaban"), "rank": rank, "status": status, "player": figures(r["sensyuRegistNo"], "player number"), "age": blank_or(whole, r.get("age"), 1, 120, "age"), "states": named} | words)
    return out


def live_payouts(value: object) -> list[dict]:
    need(isinstance(value, dict), "payouts are missing")
    out = []
    for key, kind in LIVE_BETS.items():
        rows = value.get(key) or []
        need(isinstance(rows, list) and all(isinstance(r, dict) for r in rows), f"payouts {key} are invalid")
        for k, r in enumerate(rows):
            if off(r.get("kumiDispFlg")) and text(r.get("haraiGaku")) in NOT_PAID:
                continue
            combination, amount, popularity = text(r.get("kumiBan")), D.money(text(r.get("haraiGaku"))), text(r.get("ninki"))
            need(combination and amount is not None and (popularity is None or D.money(popularity) is not None), f"payout {key} is incomplete")
            out.append({"bet_type": kind, "combination": combination, "amount": amount, "popularity": D.money(popularity), "sequence": k + 1})
    return out


def near_date(month_day: object, chosen: date) -> date:
    """MM/DD in the chosen date's year, or in the next year to it where that is over 180 days away."""
    need(isinstance(month_day, str) and re.fullmatch("[0-9]{2}/[0-9]{2}", month_day), f"no day: {month_day}")
    month, day = map(int, month_day.split("/"))
    try:
        found = date(chosen.year, month, day)
        if abs(found - chosen) > timedelta(days=180):
            found = date(chosen.year + (-1 if found > chosen else 1), month, day)
    except ValueError as e:
        raise ParseError(f"no day: {month_day}") from e
    return found


def day_metadata(page: str) -> dict[str, list[dict]]:
    """A meeting's days and its selected day's races, or the evidence that the meeting is cancelled or postponed."""
    try:
        root = json.loads(page)
    except json.JSONDecodeError:
        root = D.embedded(page, "PC0201")
    need(isinstance(root, dict) and isinstance(root.get("C0201data"), dict), "no day metadata")
    data = root["C0201data"]
    chosen, track = day_of(data.get("selKaisai"), "selKaisai"), figures(data.get("selKjyoCd"), "selKjyoCd")
    number, races = data.get("selRaceNo"), data.get("C0201race")
    need(type(number) is int and number >= 0 or isinstance(number, str) and number.isdigit(), "selRaceNo is invalid")
    message = text(data.get("hhMessage"))
    state = "HELD"
    info = "missing" if "C0201race" not in data else "null" if races is None else "empty" if races == [] else "populated"
    if on(data.get("flgRaceCancel")):
        state = DAY_WORDS.get((message or "").removesuffix("。"))
        need(state in ("CANCELLED", "POSTPONED") and zero(root.get("resultCd")) and off(data.get("flgSectionCancel")) and zero(data.get("cntRace")), "cancellation is not borne out")
        need(info != "populated" or isinstance(races, list) and int(number) == len(races), "cancellation is not borne out by its races")
        need(info == "populated" or state == "CANCELLED" and zero(number), "cancellation is not borne out by its races")
        if state == "CANCELLED" and info == "populated":
            need(all(isinstance(r, dict) and on(r.get("flgRaceEnd")) and str(r.get("rcvKekka")) == "1" for r in races), "cancelled races are not all over")
    days, seen = [], set()
    for k, d in enumerate(rows_of(data.get("C0201kaisai"), "days")):
        found = near_date(d.get("txtEventDate"), chosen)
        need(found not in seen or state == "CANCELLED" and info != "populated", f"day {found} appears twice")
        need(text(d.get("encParaK")), "a day has no parameter")
        seen.add(found)
        days.append({"race_date": found.isoformat(), "day_number": k + 1, "label": text(d.get("txtDaily")), "parameter": d["encParaK"], "selected": found == chosen})
    listed = []
    if info == "populated" or state == "HELD":
        for k, r in enumerate(rows_of(races, "races")):
            need(text(r.get("encParaR")), "a race has no parameter")
            listed.append({"race_no": k + 1, "parameter": r["encParaR"], "ended": on(r.get("flgRaceEnd")), "result_available": str(r.get("rcvKekka")) == "1"})
    top = {"selected_date": chosen.isoformat(), "track": track, "race_no": int(number), "meeting": text(data.get("raceName")), "track_name": text(data.get("joName")), "meeting_grade": text(data.get("imgGradeAlt")), "state": state, "message": message, "race_info": info}
    return {"context": [top], "days": days, "races": listed if state != "CANCELLED" else []}


def race_detail(page: str) -> dict[str, list[dict]]:
    """A race's own facts, and its entries, whose two lists must agree by bike and player."""
    outer, data = D.embedded(page, "PC0201"), D.embedded(page, "PJ0315")
    context = outer.get("C0201data") if isinstance(outer, dict) else None
    need(isinstance(context, dict) and isinstance(context.get("C0201racedtl"), dict) and isinstance(data, dict), "race details are missing")
    detail, rows = context["C0201racedtl"], rows_of(data.get("sensyuTypeInfo"), "entrants")
    listed = rows_of(detail.get("C0201sensyu"), "listed entrants")
    players = {whole(x.get("carNum"), 1, 9, "carNum"): figures(x.get("numPlayer"), "numPlayer") for x in listed}
    need(len(players) == len(listed) == len(rows), "the two lists of entrants differ")
    entries = []
    for r in rows:
        bike, player = whole(r.get("syaban"), 1, 9, "syaban"), figures(r.get("sensyuRegistNo"), "sensyuRegistNo")
        need(isinstance(r["sensyuRegistNo"], str) and players.get(bike) == player, f"players of bike {bike} differ")
        words = {n: text(r.get(k)) for n, k in (("name", "sensyuName"), ("prefecture", "huKen"), ("previous_grade", "prevKyuhan"), ("grade", "kyuhan"), ("style", "kyakusitu"), ("period", "sotugyouki"))}
        counts = {n: blank_or(whole, r.get(k), 0, 9999, k) for n, k in (("escapes", "nigeCnt"), ("sprints", "makuriCnt"), ("overtakes", "sasiCnt"), ("marks", "markCnt"), ("backs", "backCnt"), ("homes", "homeTori"), ("starts", "stTori"))}
        rates = {n: blank_or(decimal, r.get(k), k) for n, k in (("score", "heikinTokuten"), ("win_rate", "syouritu"), ("quinella_rate", "rentairitu2"), ("trio_rate", "rentairitu3"))}
        entries.append({"bike": bike, "frame": blank_or(whole, r.get("wakuban"), 1, 9, "wakuban"), "player": player, "age": blank_or(whole, r.get("age"), 1, 120, "age")} | words | counts | rates)
    need(len({e["bike"] for e in entries}) == len(entries), "a bike appears twice")
    top = {"race_date": day_of(context.get("selKaisai"), "selKaisai").isoformat(), "track": figures(context.get("selKjyoCd"), "selKjyoCd"), "race_no": whole(context.get("selRaceNo"), 1, 99, "selRaceNo"), "race_type": text(detail.get("syumoku")), "race_name": text(detail.get("nameKyosou"))}
    numbers = {"distance": blank_or(whole, detail.get("kyori"), 1, 10000, "kyori"), "laps": blank_or(whole, detail.get("syukai"), 1, 100, "syukai"), "start_time": blank_or(clock, detail.get("aftStartTime"), "aftStartTime"), "close_time": blank_or(clock, detail.get("aftBetTime"), "aftBetTime")}
    return {"context": [top | numbers], "entries": entries}


def entry_list(page: str) -> dict[str, list[dict]]:
    """The races and entries of a track's day, or the day's state where it is cancelled, terminated or postponed."""
    try:
        root = json.loads(page)
    except json.JSONDecodeError as e:
        raise ParseError("invalid JSON") from e
    need(isinstance(root, dict) and zero(root.get("resultCd")), "result code is not 0")
    asked, hidden, message = root.get("reqprm"), off(root.get("syusouDispFlag")), text(root.get("kaisaiMsg"))
    if hidden and message and "順延" in message:
        return {"day": [{"track": None, "race_date": None, "state": "POSTPONED", "message": message, "updated": None}], "races": [], "entries": []}
    state = DAY_WORDS.get((message or "").removesuffix("。"))
    if hidden and state in ("CANCELLED", "TERMINATED") and isinstance(asked, dict) and "keirinCd" not in root and "kaisaihi" not in root and not root.get("rInfo"):
        day = {"track": figures(asked.get("bkcd"), "bkcd"), "race_date": day_of(asked.get("kday"), "kday").isoformat(), "state": state, "message": message, "updated": None}
        return {"day": [day], "races": [], "entries": []}
    track, day = figures(root.get("keirinCd"), "keirinCd"), figures(root.get("kaisaihi"), "kaisaihi", 8)
    need(isinstance(asked, dict) and str(asked.get("bkcd")) == track and str(asked.get("kday")) == day, "request and response name different days")
    races, entries = [], []
    for race in rows_of(root.get("rInfo"), "races"):
        no, kind = whole(race.get("raceNo"), 1, 99, "raceNo"), text(race.get("syumoku"))
        own = rows_of(race.get("sInfo"), f"entries of race {no}")
        for e in own:
            need(isinstance(e.get("senNo"), str), f"race {no} has a player without number")
            entries.append({"race_no": no, "bike": whole(e.get("syaban"), 1, 9, "syaban"), "player": figures(e["senNo"], "senNo")} | {n: text(e.get(k)) for n, k in (("name", "senName"), ("prefecture", "huken"), ("style", "kyaku"))})
        need(len({str(e["syaban"]) for e in own}) == len(own), f"race {no} has a bike twice")
        plain = (kind or "").translate(D._NARROW)
        category = "GIRLS" if "ガールズ" in plain or "L級" in plain else "MEN" if "S級" in plain or "A級" in plain else "UNKNOWN"
        need(category != "MEN" or 5 <= len(own) <= 9, f"race {no} has {len(own)} entries")
        races.append({"race_no": no, "race_type": kind, "category": category, "close_time": blank_or(clock, race.get("denTime"), "denTime"), "start_time": blank_or(clock, race.get("stTime"), "stTime"), "result_available": str(race.get("resultFlg")) == "1", "entrants": len(own)})
    return {"day": [{"track": track, "race_date": day_of(day, "kaisaihi").isoformat(), "state": "HELD", "message": message, "updated": text(root.get("lastUpdateTime"))}], "races": races, "entries": entries}


def result_page(page: str) -> dict[str, list[dict]]:
    """State of a result page by its own words, with its results and payouts; a page without either is refused."""
    root = D.tree(page)
    words, marks = text(root.text()) or "", {n: bool(root.all(id=k)) for n, k in (("results_shown", "pitbodyBs"), ("payouts_shown", "pitbodyHarai"))}
    state = next((s for w, s in PAGE_WORDS.items() if w in words), None)
    results = [] if state else D.results(page)
    none = "払戻なし" in words
    need(state or marks["payouts_shown"] or none, "neither payouts nor word of them")
    payouts = [] if state or none else D.payouts(page)
    return {"page": [{"state": state or "RESULTS_AVAILABLE", **marks, "no_payouts": none, "source_sha256": hashlib.sha256(page.encode()).hexdigest()}], "results": results, "payouts": payouts}


def player_list(page: str) -> dict[str, list[dict]]:
    """Players of a search page, and where the page stands among the pages of its search."""
    root = D.tree(page)
    words, up = text(root.text()) or "", parents(root)
    need("選手検索結果" in words, "no page of search results")
    players = []
    for cell in root.all("td"):
        link = re.search(r"sensyuLink\('([0-9]+)'\)", cell.attrs.get("onclick") or "")
        if not link:
            need("sensyuLink(" not in (cell.attrs.get("onclick") or ""), "a player's link has no number")
            continue
        spans = above(cell, up, "table", "btn25pv2").all("span")
        own: dict[str, str | None] = {}
        for s in spans:
            name = re.search("UNQ_orlabel_([0-9]+)$", s.attrs.get("id") or "")
            if name:
                need(name[1] not in own, f"field {name[1]} of player {link[1]} appears twice")
                own[name[1]] = text(s.text())
        need(own.get("8") and own.get("10") and own.get("9") == link[1], f"player {link[1]} lacks name, grade or number")
        age = re.sub("[^0-9]", "", (own.get("14") or "").translate(D._NARROW))
        players.append({"player": link[1], "age": int(age) if age else None, "detail": f"/pc/racerprofile?snum={link[1]}"} | {n: own.get(k) for n, k in (("name_kana", "6"), ("name", "8"), ("grade", "10"), ("district", "11"), ("prefecture", "12"), ("period", "13"), ("home_bank", "15"), ("style", "16"))})
    need(players, "no players")
    total, shown = re.search("([0-9]+)件見つかりました", words), re.search(r"ページ\s*([0-9]+)/([0-9]+)", words)
    total, forms = int(total[1]) if total else None, {x.attrs.get("value") or "" for x in root.all("input") if x.attrs.get("name") == "dppg" and x.attrs.get("type") == "hidden"}
    forms = {x for x in forms if re.fullmatch("[1-9][0-9]*", x)}
    need(shown or len(forms) == 1, "the page's own number is not known")
    now = int(shown[1] if shown else forms.pop())
    last = int(shown[2]) if shown else 1
    need(shown or now == 1 and total == len(players) and not leads_on(root, now), "the last page's number is not known")
    return {"page": [{"page": now, "last_page": last, "total": total, "updated": updated_at(words)}], "players": players}


def leads_on(root: Node, now: int) -> bool:
    """Whether a control leads to a later page."""
    for x in [y for tag in ("a", "button", "input") for y in root.all(tag)]:
        if "disabled" in x.attrs or x.attrs.get("aria-disabled") == "true":
            continue
        label = " ".join(filter(None, [squeezed(x), *(x.attrs.get(k) for k in ("value", "aria-label", "title"))]))
        target = re.search(r"(?:[?&]dppg=|pageChange\(\s*['\"]?)([0-9]+)", " ".join(filter(None, (x.attrs.get(k) for k in ("href", "onclick", "formaction")))), re.I)
        value = x.attrs.get("value") or ""
        if any(w in label for w in ("次へ", "次ページ", "次のページ")) or label.upper() == "NEXT" or target and int(target[1]) > now or x.attrs.get("name") == "dppg" and value.isdigit() and int(value) > now:
            return True
    return False


def player_detail(page: str) -> dict[str, list[dict]]:
    """Profile, dated grades and recent figures of a player."""
    root = D.tree(page)
    up, mark = parents(root), [x for x in root.walk() if x.attrs.get("id") == "playerNo"]
    need(mark, "the registration number's place was not found")
    rows = [[text(c.text()) for c in r.all("td")] for r in above(mark[0], up, "table").all("tr")]
    need(len(rows) >= 4, "the profile table has another form")
    at = lambda r, k: r[k] if k < len(r) else None
    one, two = rows[1], rows[3]
    need(at(one, 6) and at(one, 0), "name or number is missing")
    profile = {"player": one[6], "name": one[0], "name_kana": at(one, 1), "prefecture": at(one, 2), "born_on": slashed(at(one, 3)), "gender": GENDERS.get(at(one, 5)), "period": at(two, 0), "grade": at(two, 1), "grade_since": slashed(at(two, 2)), "next_grade": at(two, 3), "style": at(two, 4), "score": loose_number(at(two, 5)), "updated": updated_at(text(root.text()) or "")}
    history, recent = table_after(root, up, "p", "級班の履歴情報"), table_after(root, up, "p", "直近4ヶ月成績")
    grades = [{"grade": at(c, 0), "since": slashed(at(c, 1))} for b in (history.all("tbody") if history else []) for c in ([text(x.text()) for x in r.all("td")] for r in b.all("tr")) if at(c, 0) or at(c, 1)]
    figures_ = [[text(c.text()) for c in r.all("td")] for r in recent.all("tr")][1:2] if recent else []
    count = lambda v: D.money(v)
    stats = [{"score": loose_number(at(v, 12)), "win_rate": loose_number(at(v, 7)), "quinella_rate": loose_number(at(v, 8)), "trio_rate": loose_number(at(v, 9)), "starts": count(at(v, 6)), "homes": count(at(v, 10)), "backs": count(at(v, 11))} for v in figures_]
    return {"profile": [profile], "grades": grades, "stats": stats}


def retired_player(page: str) -> dict[str, list[dict]]:
    """Profile of a retired player, whose page has one profile table, one date of retirement and one time of update."""
    root = D.tree(page)
    said = {m[1] for x in root.walk() if (m := re.fullmatch("本選手は、([0-9]{4}年[0-9]{2}月[0-9]{2}日)に引退しました。", squeezed(x)))}
    need(len(said) == 1, f"{len(said)} retirement dates")
    try:
        retired = datetime.strptime(said.pop(), "%Y年%m月%d日").date().isoformat()
    except ValueError as e:
        raise ParseError("the retirement date is no date") from e
    found = [(t, rows, k) for t in root.all("table") for rows in [own_rows(t)] for k in [next((k for k, r in enumerate(rows) if set(RETIRED_COLUMNS) <= set(r)), None)] if k is not None]
    need(len(found) == 1, f"{len(found)} profile tables")
    table, rows, k = found[0]
    need(all(rows[k].count(c) == 1 for c in RETIRED_COLUMNS), "a column of the profile appears twice")
    values = next((r for r in rows[k + 1 :] if any(r)), None)
    need(values, "the profile has no values")
    own = dict(zip(rows[k], values + [None] * len(rows[k]), strict=False))
    need(own["氏名"] and re.fullmatch("[0-9]{6}", own["登録番号"] or ""), "name or number is missing")
    marked = lambda v, mark, what: None if v is None else figures((m := re.fullmatch(f"([0-9]+){mark}", v.translate(D._NARROW))) and m[1], what)
    age = marked(own["年齢"], "歳", "age")
    return {"profile": [{"player": own["登録番号"], "name": own["氏名"], "prefecture": own["府県"], "age": int(age) if age else None, "period": marked(own["期別"], "期", "period"), "grade": own["級班"], "retired_on": retired, "updated": section_update(root, table)}]}


def section_update(root: Node, table: Node) -> str | None:
    """The one time of update between the profile's heading and its table."""
    up, branch = parents(root), table
    while id(branch) in up:
        beside = [x for x in up[id(branch)].inside if isinstance(x, Node)]
        before = beside[: next(k for k, x in enumerate(beside) if x is branch)]
        heads = [k for k, x in enumerate(before) if "midasi1_fsz" in (x.attrs.get("class") or "").split()]
        if heads:
            need(squeezed(before[heads[-1]]) == "プロフィール", "the profile has another heading")
            inside = [y for x in before[heads[-1] :] for y in [x, *x.walk()]]
            times = {updated_at(squeezed(y)) for y in inside if re.fullmatch(r"[0-9/]{10}\s+[0-9:]{5}\s*更新", squeezed(y))}
            need(len(times) <= 1, "several times of update")
            return times.pop() if times else None
        branch = up[id(branch)]
    raise ParseError("the profile has no heading")


PERSON = "name string, prefecture string, grade string, style string, period string, age int"
#: kind -> (parser, columns of each of its tables)
PAGES: dict[str, tuple[Callable[[str], dict[str, list[dict]]], dict[str, str]]] = {
    "live_result": (live_result, {
        "context": "race_date string, track string, race_no int, updated string, weather string, wind string, status string, evidence string, page_state string, results_shown boolean, payouts_shown boolean, no_payouts boolean, results_complete boolean, payouts_complete boolean",
        "results": "bike int, rank int, status string, player string, age int, states array<string>, name string, technique string, prefecture string, period string, grade string, margin string, finish_time string, back_home string, line_rank string",
        "payouts": "bet_type string, combination string, amount long, popularity int, sequence int",
    }),
    "day_metadata": (day_metadata, {
        "context": "selected_date string, track string, race_no int, meeting string, track_name string, meeting_grade string, state string, message string, race_info string",
        "days": "race_date string, day_number int, label string, parameter string, selected boolean",
        "races": "race_no int, parameter string, ended boolean, result_available boolean",
    }),
    "race_detail": (race_detail, {
        "context": "race_date string, track string, race_no int, race_type string, race_name string, distance int, laps int, start_time string, close_time string",
        "entries": f"bike int, frame int, player string, previous_grade string, {PERSON}, escapes int, sprints int, overtakes int, marks int, backs int, homes int, starts int, score double, win_rate double, quinella_rate double, trio_rate double",
    }),
    "entry_list": (entry_list, {
        "day": "track string, race_date string, state string, message string, updated string",
        "races": "race_no int, race_type string, category string, close_time string, start_time string, result_available boolean, entrants int",
        "entries": "race_no int, bike int, player string, name string, prefecture string, style string",
    }),
    "result_page": (result_page, {
        "page": "state string, results_shown boolean, payouts_shown boolean, no_payouts boolean, source_sha256 string",
        "results": D.PARSERS["results"][1],
        "payouts": D.PARSERS["payouts"][1],
    }),
    "player_list": (player_list, {"page": "page int, last_page int, total int, updated string", "players": f"player string, name_kana string, {PERSON}, district string, home_bank string, detail string"}),
    "player_detail": (player_detail, {
        "profile": "player string, name string, name_kana string, prefecture string, born_on string, gender string, period string, grade string, grade_since string, next_grade string, style string, score double, updated string",
        "grades": "grade string, since string",
        "stats": "score double, win_rate double, quinella_rate double, trio_rate double, starts int, homes int, backs int",
    }),
    "retired_player": (retired_player, {"profile": "player string, name string, prefecture string, age int, period string, grade string, retired_on string, updated string"}),
}
GRADE_COLUMNS = ("grade", "previous_grade", "next_grade")


@dataclass
class Parsed:
    """What came out of one pass over the documents: tables by name, each row with its page's url, and the quarantine."""

    found: DataFrame
    columns: dict[str, str]

    def table(self, name: str) -> DataFrame:
        fields = ", ".join(f"`{n}`: {t}" for n, t in (x.strip().split(" ", 1) for x in self.columns[name].split(",")))
        rows = F.from_json("payload", f"struct<`{name}`: array<struct<{fields}>>>")[name]
        out = self.found.where("error_type IS NULL").select("url", F.explode(rows).alias("r")).select("url", "r.*")
        return out.withColumns({c: T.grade(F.col(c)) for c in GRADE_COLUMNS if c in out.columns})

    def quarantine(self) -> DataFrame:
        return self.found.where("error_type IS NOT NULL").select("url", "error_type", "error_message")


def parse_tables(documents: DataFrame, kind: str) -> Parsed:
    """Parse all documents (url, content_type, body) of a kind once and write what came out."""
    parser, columns = PAGES[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, content_type, body in zip(frame["url"], frame["content_type"], frame["body"], strict=True):
                try:
                    need(body is not None, "no body")
                    out.append((url, json.dumps(parser(D.decode(bytes(body), content_type)), ensure_ascii=False), None, None))
                except ParseError as e:
                    out.append((url, None, "PARSE", str(e)))
                except Exception as e:  # a structure no parser foresaw: the page is kept for a look, the job goes on
                    out.append((url, None, type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=["url", "payload", "error_type", "error_message"])

    found = documents.select("url", "content_type", "body").mapInPandas(run, "url string, payload string, error_type string, error_message string")
    return Parsed(materialise(found, f"parsed-{kind}"), columns)
