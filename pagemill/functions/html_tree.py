"""Per-page helper of `html_nodes`: one HTML string to element ranges over its text.

Elements are nested-set encoded: element ``i`` (1-based, document order) contains exactly the elements
``i < j <= last``. The text of the whole page is kept once, and each element holds the byte range of its
own subtree text, so nothing is repeated for nested elements.

The rules follow the public HTML standard as far as they decide which element a piece of text belongs to:
void elements, raw text, optional end tags, implied html/head/body. Formatting elements are not re-opened
and content is never moved in front of a table.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

# --- fixed values of the HTML standard ---------------------------------------------------------------
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
)
RAW_TEXT = frozenset("iframe noembed noframes noscript script style xmp".split())
RCDATA = frozenset(["textarea", "title"])
HEAD_ONLY = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table "
    "ul xmp".split()
)
SCOPE = frozenset("applet caption html marquee object table td template th".split())
BUTTON_SCOPE = SCOPE | {"button"}
TABLE_SCOPE = frozenset(["html", "table", "template"])
ITEM_STOP = SCOPE | frozenset(
    "article aside blockquote body button center details dir dl fieldset figcaption figure footer form "
    "header main menu nav ol section summary tbody tfoot thead tr ul".split()
)
SPECIAL = VOID | RAW_TEXT | RCDATA | CLOSES_P | ITEM_STOP | frozenset(["colgroup", "head", "select"])
# start tag -> (open elements it closes, elements the search does not cross)
OPTIONAL_END = {
    "li": (frozenset(["li"]), ITEM_STOP),
    "dd": (frozenset(["dd", "dt"]), ITEM_STOP),
    "dt": (frozenset(["dd", "dt"]), ITEM_STOP),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "html"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "html"])),
    "button": (frozenset(["button"]), SCOPE),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), TABLE_SCOPE | {"tr"}),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), TABLE_SCOPE | {"tr"}),
    "tr": (frozenset(["tr", "caption", "colgroup"]), TABLE_SCOPE),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), TABLE_SCOPE),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), TABLE_SCOPE),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), TABLE_SCOPE),
}
SPACE = "\t\n\f\r "
NEAR = 16  # open elements looked at one by one; beyond, the depths kept by tag answer at once
# ------------------------------------------------------------------------------------------------------

_MARKUP = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*+")
_ATTR = re.compile(
    r"""[\t\n\f\r /]*+([^\t\n\f\r />][^\t\n\f\r />=]*+)"""
    r"""(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\t\n\f\r >]*+)))?+"""
)
_TAG_END = re.compile(r"[\t\n\f\r /]*+>")
_COMMENT_END = re.compile(r"--!?>")
_REF = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*+)(;?)(?=(.?))", re.S)


def _attribute_ref(m: re.Match) -> str:
    # inside an attribute a named reference without ";" stays literal before "=" or a letter or digit
    ref = m.group(0)
    if ref[1] == "#":
        return unescape(ref)
    if not m.group(1) and m.group(2) == "=":
        return ref
    return html5.get(ref[1:], ref)


def _attribute_value(value: str) -> str:
    return _REF.sub(_attribute_ref, value) if "&" in value else value


def _raw_end(tag: str, cache: dict = {}) -> re.Pattern:
    if tag not in cache:
        cache[tag] = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I)
    return cache[tag]


class PageTree:
    """Builds the element list of one page. ``rows`` holds [parent, tag, attrs, start, stop, last]."""

    def __init__(self, html: str):
        self.rows: list[list] = []
        self.text: list[bytes] = []
        self.size = 0
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = {}  # depths in the stack, by tag
        self.head = False
        self.body = 0  # row number, 0 while there is none
        self.foreign = 0
        self._read(html)
        self._close_to(0)

    # -- element stack --------------------------------------------------------------------------------
    def _push(self, tag: str, attrs: dict, leaf: bool = False) -> None:
        rows, n = self.rows, len(self.rows) + 1
        rows.append([self.stack[-1] if self.stack else 0, tag, attrs, self.size, self.size, n])
        if leaf:
            return
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(n)
        self.foreign += tag == "svg" or tag == "math"

    def _close_to(self, depth: int) -> None:
        last = len(self.rows)
        while len(self.stack) > depth:
            row = self.rows[self.stack.pop() - 1]
            row[4], row[5] = self.size, last
            self.open[row[1]].pop()
            self.foreign -= row[1] == "svg" or row[1] == "math"

    def _close_last(self) -> None:
        """Close the element just added."""
        self._close_to(len(self.stack) - 1)

    def _find_open(self, tags, stop) -> int:
        """Depth of the innermost open element in ``tags``, not looking past ``stop``; -1 if none."""
        for tag in tags:
            if self.open.get(tag):
                break
        else:
            return -1
        top = len(self.stack) - 1
        for depth in range(top, max(-1, top - NEAR), -1):  # most end tags close something near
            tag = self.rows[self.stack[depth] - 1][1]
            if tag in tags:
                return depth
            if tag in stop:
                return -1
        found = max(self.open[tag][-1] for tag in tags if self.open.get(tag))
        return found if all(self.open[tag][-1] <= found for tag in stop if self.open.get(tag)) else -1

    def _close(self, tags, stop) -> bool:
        depth = self._find_open(tags, stop)
        if depth >= 0:
            self._close_to(depth)
        return depth >= 0

    # -- implied structure ----------------------------------------------------------------------------
    def _need_html(self) -> None:
        if not self.rows:
            self._push("html", {})

    def _need_head(self) -> None:
        self._need_html()
        if not self.head:
            self.head = True
            self._push("head", {})

    def _need_body(self) -> None:
        if not self.body:
            self._need_head()
            self._close_to(1)
            self._push("body", {})
            self.body = len(self.rows)

    # -- tokens ---------------------------------------------------------------------------------------
    def _add_text(self, value: str) -> None:
        if "\0" in value:
            value = value.replace("\0", "")
        if not self.body and len(self.stack) <= 2:
            rest = value.lstrip(SPACE)
            if self.head:
                self._append(value[: len(value) - len(rest)])
            if not rest:
                return
            self._need_body()
            value = rest
        self._append(value)

    def _append(self, value: str) -> None:
        if value:
            raw = value.encode("utf-8", "replace")
            self.text.append(raw)
            self.size += len(raw)

    def _merge(self, index: int, attrs: dict) -> None:
        self.rows[index][2] = {**attrs, **self.rows[index][2]}

    def _start(self, tag: str, attrs: dict, self_closing: bool) -> None:
        if tag == "html":
            self._need_html()
            self._merge(0, attrs)
            return
        if tag == "head":
            if not self.head:
                self._need_head()
                self._merge(len(self.rows) - 1, attrs)
            return
        if tag == "body":
            self._need_body()
            self._merge(self.body - 1, attrs)
            return
        if not self.body:
            if tag in HEAD_ONLY:
                self._need_head()
            elif not self.open.get("template"):
                self._need_body()
        if self.foreign:
            self._push(tag, attrs, leaf=self_closing)
            return
        if tag in CLOSES_P and self.open.get("p"):
            self._close(("p",), BUTTON_SCOPE)
        if tag in HEADINGS and self.rows[self.stack[-1] - 1][1] in HEADINGS:
            self._close_to(len(self.stack) - 1)
        if tag in OPTIONAL_END:
            self._close(*OPTIONAL_END[tag])
            if tag in ("li", "dd", "dt"):
                self._close(("p",), BUTTON_SCOPE)
        self._push("img" if tag == "image" else tag, attrs, leaf=tag in VOID or tag == "image" or
                   (self_closing and tag in ("svg", "math")))

    def _end(self, tag: str) -> None:
        if self.stack and self.rows[self.stack[-1] - 1][1] == tag and tag not in ("html", "head", "body"):
            self._close_to(len(self.stack) - 1)  # the usual case
            return
        if tag in ("html", "head", "body"):
            return
        if tag == "br" or (tag == "p" and self._find_open(("p",), BUTTON_SCOPE) < 0):
            self._start(tag, {}, False)
            if tag == "p":
                self._close_last()
        elif tag == "p":
            self._close(("p",), BUTTON_SCOPE)
        elif tag in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif tag == "li":
            self._close(("li",), SCOPE | {"ol", "ul"})
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"):
            self._close((tag,), TABLE_SCOPE - {tag})
        elif tag in SPECIAL:
            self._close((tag,), SCOPE - {tag})
        else:
            self._close((tag,), SPECIAL)

    def _read(self, html: str) -> None:
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        pos, end = 0, len(html)
        while pos < end:
            m = _MARKUP.search(html, pos)
            lt = m.start() if m else end
            if lt > pos:
                chunk = html[pos:lt]
                self._add_text(unescape(chunk) if "&" in chunk else chunk)
            if lt == end:
                return
            after = html[lt + 1]
            if after == "!" and html.startswith("<!--", lt):
                if html.startswith(("<!-->", "<!--->"), lt):
                    pos = html.index(">", lt) + 1
                    continue
                m = _COMMENT_END.search(html, lt + 4)
                pos = m.end() if m else end
                continue
            closing = after == "/"
            name = _NAME.match(html, lt + 1 + closing)
            if name is None:  # doctype, processing instruction, "</" before anything but a letter
                if closing and lt + 2 == end:
                    self._add_text("</")
                gt = html.find(">", lt + 2)
                pos = end if gt < 0 else gt + 1
                continue
            tag = name.group().lower()
            pos = name.end()
            attrs: dict[str, str] = {}
            while pos < end and html[pos] != ">":
                m = _ATTR.match(html, pos)
                if m is None:
                    m = _TAG_END.match(html, pos)
                    pos = m.end() - 1 if m else end
                    break
                key = m.group(1).lower()
                if key not in attrs:
                    attrs[key] = _attribute_value(m.group(2) or m.group(3) or m.group(4) or "")
                pos = m.end()
            if pos >= end:  # the page ends inside a tag: the tag does not count
                return
            pos += 1
            if closing:
                self._end(tag)
                continue
            foreign = self.foreign
            self._start(tag, attrs, html[pos - 2] == "/")
            if foreign or tag in ("html", "head", "body"):
                continue
            if tag == "plaintext":
                self._append(html[pos:])
                return
            if tag in ("listing", "pre", "textarea") and html.startswith("\n", pos):
                pos += 1
            if tag in RAW_TEXT or tag in RCDATA:
                m = _raw_end(tag).search(html, pos)
                stop = m.start() if m else end
                chunk = html[pos:stop]
                self._append(unescape(chunk) if tag in RCDATA and "&" in chunk else chunk)
                self._close_last()
                if m is None:
                    return
                gt = html.find(">", m.end())
                pos = end if gt < 0 else gt + 1
