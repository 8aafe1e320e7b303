"""Raw documents to tables: every page parses as a whole or goes to quarantine with its error.

``parse`` decodes and parses pages in Arrow batches; a parser is a small function from a page's text to its rows. What a page
yields comes back as one JSON array and is typed and exploded by Spark. Nothing is returned for a page whose structure is not
the expected one: the quarantine has its address, hash and error. Pages that hold several tables are in ``pages``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.functions.text import BET_TYPES, ENTRY_STATES, PLAIN, WIDE

_NARROW = str.maketrans(WIDE, PLAIN)
_SPACES, _NO_DIGITS = re.compile(r"[ \r\n\t ]+"), re.compile("[^0-9]")
_VOID = {"br", "img", "input", "meta", "link", "hr"}
# Names under which one Japanese encoding goes; words of pages.
CHARSETS = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "ms932": "cp932", "utf8": "utf-8"}
SHORT_STATES = {"失": "DISQUALIFIED", "欠": "DID_NOT_START", "棄": "DID_NOT_FINISH", "未着": "DID_NOT_FINISH", "落": "CRASHED"} | ENTRY_STATES
GRADE_ICONS = ("g1", "g2", "g3", "f1", "f2")


class ParseError(ValueError):
    """The page is not what its kind should be."""


def need(good: object, message: str) -> None:
    if not good:
        raise ParseError(message)


# --- text ---------------------------------------------------------------------------------------------------------------


def decode(body: bytes, content_type: str | None) -> str:
    """Text by the declared charset, else by the page's meta element, else by the first encoding that fits."""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I) or re.search(rb"charset=[\"']?([\w-]+)", body[:2048], re.I)
    name = (named[1] if isinstance(named[1], str) else named[1].decode()).lower() if named else None
    for charset in [CHARSETS.get(name, name)] if name else ["utf-8", "cp932", "euc_jp"]:
        try:
            return body.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    raise ParseError(f"body is no valid {name or 'text'}")


def clean(value: object) -> str | None:
    if not isinstance(value, str):
        return None
    text = _SPACES.sub(" ", value).strip(" ")
    return None if text in ("", "-", "－") else text


def narrow(value: str) -> str:
    """Wide forms as plain ones; a text of plain ones stays as it is."""
    return value if value.isascii() else value.translate(_NARROW)


def number(value: object, low: int, high: int, what: str) -> int:
    text = narrow(str(value)) if value is not None and not isinstance(value, bool) else ""
    if not (text.isascii() and text.isdigit() and len(text) <= 9 and low <= int(text) <= high):
        raise ParseError(f"{what} is invalid: {value}")
    return int(text)


def money(value: str | None) -> int | None:
    found = _NO_DIGITS.sub("", narrow(value or ""))
    return int(found) if found else None


class Node:
    """Element with attributes, children and text."""

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.inside = tag, attrs, []
        self.flat: list[Node] | None = None

    def walk(self) -> list[Node]:
        """All elements inside, in order of their start; found once, as a tree is not changed after it was read."""
        if self.flat is None:
            self.flat, ahead = [], self.inside[::-1]
            while ahead:
                x = ahead.pop()
                if isinstance(x, Node):
                    self.flat.append(x)
                    ahead.extend(x.inside[::-1])
        return self.flat

    def all(self, tag: str | None = None, **attrs: str) -> list[Node]:
        found = [x for x in self.walk() if tag is None or x.tag == tag]
        for k, v in attrs.items():
            name = k.rstrip("_")
            found = [x for x in found if x.attrs and v in (x.attrs.get(name) or "").split()]
        return found

    def text(self) -> str:
        if len(self.inside) == 1 and isinstance(self.inside[0], str):
            return self.inside[0]
        out, ahead = [], self.inside[::-1]
        while ahead:
            x = ahead.pop()
            if isinstance(x, Node):
                ahead.extend(reversed(x.inside))
            else:
                out.append(x)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].inside.append(data)


#: A plain tag: a name, and attributes in quotes without marks, after plain white space.
_TAG = re.compile("(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z_][-a-zA-Z0-9_]*(?:=(?:\"[^\"&]*\"|'[^'&]*'))?)*)[ \t\r\n]*")
_ATTRIBUTE = re.compile("([a-zA-Z_][-a-zA-Z0-9_]*)(?:=(?:\"([^\"]*)\"|'([^']*)'))?")
#: Elements whose text is taken as it stands, those whose text may only end with them, and those that are left to the library.
_RAW, _TEXT, _OTHER = {"script", "style"}, {"script", "style", "title", "textarea"}, {"xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


@lru_cache(maxsize=4096)
def plain_tag(head: str) -> tuple[bool, str, dict[str, str | None]] | None:
    """Whether it ends an element, name and attributes of what stands between < and >; None where that is not plain."""
    found = _TAG.fullmatch(head)
    if not found or found[1] and (found[3] or head != f"/{found[2]}") or found[2].lower() in _OTHER:
        return None
    attrs: dict[str, str | None] = {}
    for a in _ATTRIBUTE.finditer(found[3]):
        attrs[a[1].lower()] = a[2] if a[2] is not None else a[3]
    return bool(found[1]), found[2].lower(), attrs


def plain_tree(html: str) -> Node | None:
    """The tree of a page of plain tags and text; None where there is any other markup, which the library takes."""
    first, *parts = html.split("<")
    root = Node("", {})
    stack, inside, held = [root], root.inside, None
    if first:
        inside.append(unescape(first))
    for part in parts:
        head, closed, words = part.partition(">")
        found = plain_tag(head) if closed else None
        if found is None:
            return None
        ends, tag, attrs = found
        if held and not (ends and tag == held):
            return None
        held = None
        if not ends:
            node = Node(tag, attrs)
            inside.append(node)
            if tag not in _VOID:
                stack.append(node)
            held = tag if tag in _TEXT else None
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        inside = stack[-1].inside
        if words:
            inside.append(words if tag in _RAW and not ends else unescape(words) if "&" in words else words)
    return None if held else root


@lru_cache(maxsize=1)
def tree(html: str) -> Node:
    """The page's elements. The last page's tree is kept, as several readers of a page ask for it; none changes it."""
    found = plain_tree(html)
    if found is not None:
        return found
    t = _Tree()
    t.feed(html)
    t.close()
    return t.open[0]


def embedded(html: str, key: str) -> dict | list:
    """The JSON value that a script assigns to jsonData[key]."""
    for script in tree(html).all("script"):
        words = script.text()
        at = re.search(r"jsonData\[([\"'])" + re.escape(key) + r"\1\]\s*=\s*", words)
        if at:
            rest = words[at.end() :]
            need(rest[:1] in ("{", "["), f"{key} is no object or array")
            try:
                return json.JSONDecoder().raw_decode(rest)[0]
            except json.JSONDecodeError as e:
                raise ParseError(f"{key} is incomplete or invalid") from e
    raise ParseError(f"{key} was not found")


def table_rows(root: Node, marker: str) -> list[list[str | None]]:
    """Cells of the data rows of the table body with an id; header and empty rows are left out, mixed ones refused."""
    bodies = root.all(id=marker)
    need(bodies, f"{marker} was not found")
    out = []
    for k, row in enumerate(bodies[0].all("tr")):
        inside = row.walk()
        cells = [clean(c.text()) for c in inside if c.tag == "td"]
        if any(c.tag == "th" for c in inside):
            need(not cells, f"row {k} mixes header and data cells")
        elif any(cells):
            out.append(cells)
        else:
            need(cells or clean(row.text()) is None, f"row {k} has text outside its cells")
    return out


# --- parsers ------------------------------------------------------------------------------------------------------------


def results(text: str) -> list[dict]:
    """Rank or state, bike and name; equal ranks are ties."""
    out, seen = [], set()
    for k, cells in enumerate(table_rows(tree(text), "pitbodyBs")):
        need(len(cells) >= 4 and cells[0] and cells[3], f"row {k} lacks columns")
        bike = number(cells[2], 1, 9, f"bike of row {k}")
        need(bike not in seen, f"bike {bike} appears twice")
        seen.add(bike)
        place = narrow(cells[0])
        ranked = place.isascii() and place.isdigit()
        need(ranked or cells[0] in SHORT_STATES, f"row {k} has an unknown rank or state: {cells[0]}")
        out.append({"rank": int(place) if ranked else None, "bike": bike, "name": cells[3], "status": "FINISHED" if ranked else SHORT_STATES[cells[0]]})
    need(out, "no result rows")
    ranks = [r["rank"] for r in out]
    return [r | {"status": "TIED"} if r["rank"] is not None and ranks.count(r["rank"]) > 1 else r for r in out]


def payouts(text: str) -> list[dict]:
    """Bet type, combination, amount and popularity, numbered within a type; one bad row refuses the page."""
    out, times = [], {}
    for k, cells in enumerate(table_rows(tree(text), "pitbodyHarai")):
        need(len(cells) >= 3 and cells[0], f"payout row {k} lacks columns")
        kind = BET_TYPES.get(narrow(cells[0]).replace(" ", ""))
        amount, combination = money(cells[2]), re.sub(r"\s+", "", narrow(cells[1] or ""))
        need(kind and combination and amount is not None, f"payout row {k} is incomplete")
        times[kind] = times.get(kind, 0) + 1
        out.append({"bet_type": kind, "combination": combination, "amount": amount, "popularity": money(cells[3]) if len(cells) > 3 else None, "sequence": times[kind]})
    return out


def schedule(text: str) -> list[dict]:
    """Meetings of a month's grid: a cell's first day is one more than the days of the cells before it."""
    root = tree(text)
    year, month = ((root.all(id=x) or [Node("", {})])[0].attrs.get("value") for x in ("dispYearData", "dispDayData"))
    need(year and month, "year and month were not found")
    out = []
    for row in root.all("tr"):
        link = next((a for c in row.all("td", class_="td_keirinjo") for a in c.all("a")), None)
        code = re.search(r"jocd=([0-9]+)", (link.attrs.get("href") or "") if link else "")
        if not code:
            continue
        day = 1
        for cell in row.all("td", class_="td_day"):
            span = int(cell.attrs.get("colspan") or 1)
            own = next((a for a in cell.all("a") if a.attrs.get("data-pprm-href")), None)
            if own:
                icon = next((i.attrs.get("src") or "" for i in cell.all("img", class_="gradeIconSize")), "")
                grade = next((g.upper() for g in GRADE_ICONS if f"ico_{g}" in icon), None)
                out.append({"track": code[1], "starts_on": date(int(year), int(month), day).isoformat(), "days": span, "grade": grade})
            day += span
    need(out, "no meetings")
    return out


def plain_text(text: str) -> list[dict]:
    """Number of characters of the decoded page."""
    return [{"chars": len(text)}]


PARSERS: dict[str, tuple[Callable[[str], list[dict]], str]] = {
    "text": (plain_text, "chars long"),
    "results": (results, "rank int, bike int, name string, status string"),
    "payouts": (payouts, "bet_type string, combination string, amount long, popularity int, sequence int"),
    "schedule": (schedule, "track string, starts_on string, days int, grade string"),
}


def raw_documents(rows: DataFrame) -> DataFrame:
    """The raw document table: url, content_type, body (binary), with its SHA-256 and size."""
    return rows.select("url", "content_type", "body", F.sha2("body", 256).alias("sha256"), F.length("body").cast("long").alias("bytes"))


def parse(documents: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all pages of a kind (with url), and the quarantine: url, error_type, error_message."""
    parser, schema = PARSERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, content_type, body in zip(frame["url"], frame["content_type"], frame["body"], strict=True):
                try:
                    need(body is not None, "no body")
                    out.append((url, json.dumps(parser(decode(bytes(body), content_type)), ensure_ascii=False), None, None))
                except ParseError as e:
                    out.append((url, None, "PARSE", str(e)))
                except Exception as e:  # a structure no parser foresaw: the page is kept for a look, the job goes on
                    out.append((url, None, type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=["url", "payload", "error_type", "error_message"])

    found = documents.select("url", "content_type", "body").mapInPandas(run, "url string, payload string, error_type string, error_message string")
    good = found.where("error_type IS NULL").select("url", F.explode(F.from_json("payload", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("url", "r.*")
    return good, found.where("error_type IS NOT NULL").select("url", "error_type", "error_message")
