"""Operator 8: main text of web pages by tree scoring.

The points, names and discounts follow the well-known public readability heuristic, in a form of our own.

A page becomes a tree with the usual implied end tags, in one pass: the scan remembers that no ">" lies ahead or that a quote was
never closed (from there on quotes guard nothing), and open elements are found by their tag, not by a walk. Every paragraph-like block gives points (one, one for each comma, one
for each hundred characters up to three, less by its link density) to its ancestors: all to the parent, half to the
grandparent, less and less above. Containers start with points for their tag and for telling names in class and id; what
stands in menus, headers, footers, sidebars, notices, adverts, forms and reader comments is left out from the start, by tag, role, or a name in its class or id that says so as a whole. A
container's score is discounted by its own link density. The best container and those of its siblings that score well, or are
paragraphs of running text, are kept. If no block scores, the article, the main part or the body stands in.

Defined results: a null or empty page gives an empty text and 0 characters; markup that is never closed ends with the page;
undecodable references stay as they are; repeated rows are repeated; null ids and urls pass through; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolane.llm.pieces import text_groups
from tempolane.llm.shared import text_or_empty

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)").match
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>").match
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)").findall
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])").sub, re.compile(r"&#[0-9]{8,};?").sub
RAW = frozenset("script style textarea title noscript template iframe object svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold the article.
LEFT_OUT = frozenset("nav header footer aside form button select option dialog menu head fieldset input".split()) | RAW
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Implied end tags: a start tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {x: {"p"} for x in "p div section article ul ol dl table blockquote pre form nav header footer aside main figure hr address h1 h2 h3 h4 h5 h6".split()}
#: An implied end doesn't reach beyond these.
WALLS = frozenset("table ul ol dl div section article main body td th blockquote html".split())
POINTS = {"article": 30, "main": 20, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3, "address": -3, "th": -5} | dict.fromkeys(_HEADINGS, -5)
_GOOD = re.compile(r"(?i)article|body|content|entry|main|page|post|story|text|blog")
#: Names of what is left out. A class or id token says so as a whole; of the first list also with more words behind
#: it (ad-slot, comments-area), of the second with more words before it (site-footer, cookie-notice).
_FIRST = frozenset("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments cookie cookies footer masthead menu nav navbar navigation newsletter pagination promo sidebar sponsor sponsored toolbar widget".split())
_LAST = frozenset("ad ads advert adverts banner breadcrumbs comments cookies footer masthead menu nav navbar navigation notice pagination popup promo sidebar toolbar widget".split())
_WHOLE = _FIRST | _LAST | frozenset("alert consent disqus gdpr header login modal overlay pager popup promotion recommended related replies respond share sharing side signup social subscribe tags".split())
_WORDS = re.compile("[_-]+").split


def left_out_by(names: str) -> bool:
    """Whether a token of class or id names what is left out."""
    for token in names.lower().split():
        words = [w for w in _WORDS(token) if w]
        if token in _WHOLE or words and (words[0] in _FIRST or words[-1] in _LAST):
            return True
    return False


_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())


class Tree:
    """Elements in page order. parts holds, for each, its texts and the numbers of its children, in order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.names, self.out, self.parts = ["html"], [-1], [""], [False], [[]]
        #: Open elements; for each tag, and for walls, where they stand among these.
        self.open, self.places, self.walls = [0], {}, [0]
        at, said, end, quotes = 0, 0, len(page), True  # said: the text before it is in the tree
        while True:
            at = page.find("<", at)
            if at < 0:
                break
            if page.startswith(("<!", "<?"), at):
                self._text(page[said:at])
                close, mark = ("-->", at + 4) if page.startswith("<!--", at) else (">", at)
                found = page.find(close, mark)
                at = said = found + len(close) if found >= 0 else end
                continue
            name = _NAME(page, at + 1)
            if name is None:
                at += 1
                continue
            close = page.find(">", name.end())
            if close < 0:  # no tag ends any more: all is text up to a comment that runs to the end
                stop = min((x for x in (page.find("<!", at), page.find("<?", at)) if x >= 0), default=end)
                self._text(page[said:stop])
                said = end
                break
            rest = _REST(page, name.end()) if quotes else None
            quotes = rest is not None
            self._text(page[said:at])
            stop = rest.end() if rest else close + 1
            at = said = self._tag(page, name[1].lower(), page[at + 1] == "/", page[name.end() : stop - 1], stop)
        self._text(page[said:])

    def _tag(self, page: str, tag: str, closes: bool, attributes: str, at: int) -> int:
        """Take a tag that ends before ``at``; the place where the page goes on."""
        if closes:
            last = self._last(tag)
            if tag in ("p", "br") and last < 0:
                self.parts[self.open[-1]].append(" ")
            elif last > 0 and (tag not in INLINE or last > self.walls[-1]):
                self._close(last)
            return at
        ends = ENDS.get(tag)
        if ends:
            last = max(map(self._last, ends))
            if last > 0 and last >= self.walls[-1]:
                self._close(last)
        new = self._element(tag, self.open[-1], attributes)
        if tag in VOID or attributes.endswith("/") and tag not in PARAGRAPHS:
            return at
        if tag in RAW:
            close = re.compile(rf"(?i)</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)").search(page, at)
            return close.end() if close else len(page)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in WALLS:
            self.walls.append(len(self.open))
        self.open.append(new)
        return at

    def _last(self, tag: str) -> int:
        """Where the innermost open element of a tag stands, or -1."""
        own = self.places.get(tag)
        return own[-1] if own else -1

    def _close(self, place: int) -> None:
        """End the open elements from ``place`` on."""
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.places[tag].pop()
            if tag in WALLS:
                self.walls.pop()

    def _text(self, raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = entities.unescape(_HUGE("\ufffd", _ZEROS("&#", raw)))
            self.parts[self.open[-1]].append(raw)

    def _element(self, tag: str, parent: int, attributes: str) -> int:
        names, out = "", tag in LEFT_OUT
        for key, value in _ATTRIBUTE(attributes) if attributes else ():
            value = value.strip("\"'")
            if key.lower() == "role":
                out |= value.lower() in _ROLES
            else:
                names += " " + value
        if names and tag not in ("html", "body", "article", "main") and left_out_by(names):
            out = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.out.append(out)
        self.parts.append([])
        self.parts[parent].append(len(self.tag) - 1)
        return len(self.tag) - 1

    def text(self, top: int) -> str:
        """Text below an element without what is left out; blocks and line breaks part words, other tags don't."""
        pieces: list[str] = []
        stack: list = [top]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                pieces.append(x)
            elif not self.out[x] or x == top:
                if self.tag[x] not in INLINE:
                    pieces.append(" ")
                    stack.append(" ")
                stack.extend(reversed(self.parts[x]))
        return " ".join("".join(pieces).split())

    def best(self) -> list[int]:
        """The elements whose texts make the main text, in page order."""
        n = len(self.tag)
        length, linked, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
        out = self.out
        for x in range(n):
            if x and out[self.parent[x]]:
                out[x] = True
            if not out[x]:
                for part in self.parts[x]:
                    if isinstance(part, str):
                        size = len(part.strip())
                        own[x] += size
                        length[x] += size
                        commas[x] += part.count(",") + part.count("、") + part.count("，")
        score: dict[int, float] = {}
        inline_size = own[:]
        # The nearest ancestor that takes points: a block that is no paragraph.
        holder = [0] * n
        for x in range(1, n):
            up = self.parent[x]
            holder[x] = holder[up] if self.tag[up] in INLINE or self.tag[up] in ("p", "html") else up
        for x in range(n - 1, 0, -1):
            if out[x]:
                continue
            up = self.parent[x]
            length[up] += length[x]
            commas[up] += commas[x]
            linked[up] += length[x] if self.tag[x] == "a" else linked[x]
            if self.tag[x] in INLINE:
                inline_size[up] += inline_size[x]
        for x in range(1, n):
            if out[x] or self.tag[x] not in PARAGRAPHS or length[x] < 25:
                continue
            if self.tag[x] in ("div", "section", "article") and inline_size[x] < 25:
                continue  # a container: its blocks give the points
            size = length[x] if self.tag[x] not in ("div", "section", "article") else inline_size[x]
            points = (1 + commas[x] + min(size / 100, 3)) * (1 - linked[x] / length[x])
            level, up = 0, holder[x] if self.tag[x] not in ("div", "section", "article") else x
            while up > 0 and level < 6:
                if up not in score:
                    score[up] = POINTS.get(self.tag[up], 0) + 25 * bool(_GOOD.search(self.names[up]))
                score[up] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
                up = holder[up]
        final = {x: s * (1 - linked[x] / max(1, length[x])) for x, s in score.items()}
        named = [x for x in range(n) if self.tag[x] in ("article", "main") and not out[x] and length[x]]
        if not final:
            return max(([x] for x in named), key=lambda x: length[x[0]], default=[0] if not named else named[:1])
        top = max(final, key=lambda x: (final[x], -x))
        enough, kept = max(10.0, 0.2 * final[top]), []
        for part in self.parts[self.parent[top]]:
            if isinstance(part, str) or out[part]:
                continue
            density = linked[part] / max(1, length[part])
            if part == top or final.get(part, 0) >= enough or self.tag[part] == "p" and length[part] > 80 and density < 0.25 or self.tag[part] in ("h1", "h2") and self.tag[top] not in ("article", "main"):
                kept.append(part)
        return kept


def main_text(page: str) -> str:
    """Main text of one page."""
    if not page.strip():
        return ""
    tree = Tree(page)
    return " ".join(filter(None, map(tree.text, tree.best())))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    types = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            for at, group in text_groups(batch.column(2).to_pylist()):
                texts = [main_text(x) for x in group]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(group)), batch.column(1).slice(at, len(group)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"]
                )

    chosen = pages.select(F.col(id_col), F.col(url_col), text_or_empty(html_col).alias("_html"))
    return chosen.mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
