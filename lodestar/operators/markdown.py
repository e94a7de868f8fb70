"""The top-level blocks of a Markdown text, by the block structure of CommonMark with tables.

A line is read against the stack of open blocks: it continues some of the containers, may open new ones, and else goes on
with the innermost paragraph, also where it has left the paragraph's containers (lazy continuation). Only lines and offsets
matter here: what is inside a list or a quote is read to know where that ends.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_ATX = re.compile(r"(#{1,6})(?: +(.*?))?(?: +#+)? *$")
_SETEXT = re.compile(r"(=+|-+) *$")
_RULE = re.compile(r"(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
_ITEM = re.compile(r"([-+*]|(\d{1,9})([.)]))(?= |$)")
_DELIMITER = re.compile(r":?-+:?$")
_TITLE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"""
_DEFINITION = re.compile(
    rf" {{0,3}}\[(?!\s*\])(?:[^\[\]\\]|\\.){{1,999}}\]:[ ]*\n?[ ]*(?:<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?: +| *\n *){_TITLE})? *(?:\n|$)", re.S
)
#: Names of elements that open a block which ends at a blank line.
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search "
    "section summary table tbody td tfoot th thead title tr track ul"
).split()
_ATTRIBUTE = r"""\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^"'=<>`\s]+|'[^']*'|"[^"]*"))?"""
#: How a block of HTML begins and how it ends; None is a blank line. The last may not interrupt a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_HTML_NAMES)})(?=\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][\w-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"), None),
]
_CONTAINERS = ("quote", "list", "item")


@dataclass
class Block:
    """start and end are lines, both included. mark: a fence's, a list's kind, or how HTML ends. indent: an item's contents'."""

    kind: str
    start: int
    end: int
    mark: object = None
    indent: int = 0
    empty: bool = False
    level: int = 0
    title: str = ""


def _indent(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


def _columns(row: str) -> int:
    cells = re.sub(r"\\.", "  ", row.strip()).split("|")
    return len(cells) - (cells[0].strip() == "") - (len(cells) > 1 and cells[-1].strip() == "")


def _is_delimiter(row: str) -> int:
    """The columns of a table's second line, 0 if it is none."""
    cells = [c.strip() for c in row.strip().split("|")]
    if cells and not cells[0]:
        cells = cells[1:]
    if cells and not cells[-1]:
        cells = cells[:-1]
    return len(cells) if cells and all(map(_DELIMITER.match, cells)) else 0


def _without_definitions(lines: list[str]) -> int:
    """How many of a paragraph's lines are link definitions at its beginning."""
    body, used = "\n".join(lines), 0
    while m := _DEFINITION.match(body, used):
        if m.end() == used:
            break
        used = m.end()
    return len(lines) if used >= len(body) else body.count("\n", 0, used)


class _Reader:
    def __init__(self, lines: list[str]):
        self.lines = [line.rstrip("\r").expandtabs(4) for line in lines]
        self.stack: list[Block] = []
        self.out: list[Block] = []

    def read(self) -> list[Block]:
        for i, line in enumerate(self.lines):
            self._line(i, line)
        self._close(0, len(self.lines))
        return self.out

    def _close(self, depth: int, i: int) -> None:
        """Closes the open blocks from `depth` on, before line i."""
        while len(self.stack) > depth:
            block = self.stack.pop()
            if block.kind == "list":
                block.end = i - 1  # blank lines after it are its own
            if block.kind == "paragraph" and (gone := _without_definitions(self.lines[block.start : block.end + 1])):
                block.start += gone
            if not self.stack and block.start <= block.end:
                self.out.append(block)

    def _touch(self, i: int, depth: int | None = None) -> None:
        for block in self.stack[:depth]:
            block.end = i

    def _step(self, block: Block, s: str, at: int, i: int) -> int | None:
        """Where the line goes on after a block's part of it; None if it does not continue the block."""
        rest = s[at:]
        blank, indent = not rest.strip(), _indent(rest)
        if block.kind == "quote":
            if indent > 3 or not rest[indent:].startswith(">"):
                return None
            at += indent + 1
            return at + 1 if s[at : at + 1] == " " else at
        if block.kind == "item":
            if blank:
                return None if block.empty and i > block.start else at
            return at + block.indent if indent >= block.indent else None
        if block.kind == "code":
            return at if blank or indent >= 4 else None
        if block.kind == "html":
            return None if blank and block.mark is None else at
        if block.kind == "table":
            return at if i == block.start + 1 or not (blank or indent >= 4) else None
        if block.kind == "paragraph":
            return None if blank else at
        return at

    def _line(self, i: int, s: str) -> None:
        at, depth, quote = 0, 0, 0
        for block in self.stack:
            step = self._step(block, s, at, i)
            if step is None:
                break
            at, depth = step, depth + 1
            quote = depth if block.kind == "quote" else quote
        whole = depth == len(self.stack)
        leaf = self.stack[-1] if self.stack and whole and self.stack[-1].kind not in _CONTAINERS else None
        rest = s[at:]
        if leaf and leaf.kind in ("fence", "html", "code"):
            if leaf.kind != "code" or rest.strip():
                self._touch(i)
            done = leaf.kind == "html" and leaf.mark is not None and leaf.mark.search(rest)
            if leaf.kind == "fence" and _indent(rest) <= 3 and re.fullmatch(rf" *{re.escape(leaf.mark[0])}{{{len(leaf.mark)},}} *", rest):
                done = True
            if done:
                self._close(depth - 1, i + 1)
            return
        if leaf and leaf.kind == "table" and i == leaf.start + 1:
            self._touch(i)
            return
        if not rest.strip():
            self._close(depth, i)
            self._touch(i, quote)
            return
        tip = self.stack[-1] if self.stack else None
        lazy = tip is not None and tip.kind == "paragraph" and not whole
        if self._starts(i, s, at, depth, leaf, lazy):
            return
        if lazy:
            self._touch(i)
        elif leaf:
            self._touch(i)

    def _open(self, block: Block, i: int, depth: int, first: bool) -> None:
        if first:
            self._close(depth, i)
            if self.stack and self.stack[-1].kind not in _CONTAINERS:
                self._close(len(self.stack) - 1, i)
            if self.stack and self.stack[-1].kind == "list" and block.kind != "item":
                self._close(len(self.stack) - 1, i)
        for outer in self.stack:
            outer.empty = False
        self.stack.append(block)
        self._touch(i)

    def _starts(self, i: int, s: str, at: int, depth: int, leaf: Block | None, lazy: bool) -> bool:
        """Opens the blocks that begin on the line; false if it goes on with an open paragraph or table."""
        first = True
        while True:
            rest = s[at:]
            indent, body = _indent(rest), rest.strip()
            going_on = first and (leaf is not None or lazy)
            if not body:  # an item without contents on its line
                return True
            if indent >= 4:
                if going_on:
                    return False
                self._open(Block("code", i, i), i, depth, first)
                return True
            if body[0] == ">":
                self._open(Block("quote", i, i), i, depth, first)
                at += indent + 1
                at += s[at : at + 1] == " "
                first = False
                continue
            if m := _ATX.match(body):
                self._open(Block("heading", i, i, level=len(m[1]), title=(m[2] or "").strip()), i, depth, first)
                self._close(len(self.stack) - 1, i + 1)
                return True
            if m := _FENCE.match(body):
                self._open(Block("fence", i, i, mark=m[1] or m[2]), i, depth, first)
                return True
            kinds = _HTML[:6] if going_on else _HTML
            if body[0] == "<" and (kind := next((k for k in kinds if k[0].match(body)), None)):
                self._open(Block("html", i, i, mark=kind[1]), i, depth, first)
                if kind[1] is not None and kind[1].search(body):
                    self._close(len(self.stack) - 1, i + 1)
                return True
            paragraph = first and leaf is not None and leaf.kind == "paragraph"
            if paragraph and (m := _SETEXT.match(body)):
                gone = _without_definitions(self.lines[leaf.start : i])
                if leaf.start + gone < i:
                    title = "".join(x.strip() for x in self.lines[leaf.start + gone : i])
                    leaf.kind, leaf.level, leaf.title, leaf.start = "heading", 1 if m[1][0] == "=" else 2, title, leaf.start + gone
                    self._touch(i)
                    self._close(len(self.stack) - 1, i + 1)
                    return True
            if _RULE.match(body):
                self._open(Block("rule", i, i), i, depth, first)
                self._close(len(self.stack) - 1, i + 1)
                return True
            m = _ITEM.match(body)
            after = body[m.end() :] if m else ""
            if m and not (paragraph and (not after.strip() or (m[2] and int(m[2]) != 1))):
                kind = m[3] or m[1]
                holder = self.stack[depth - 1] if first and 0 < depth <= len(self.stack) else None
                if not (holder and holder.kind == "list" and holder.mark == kind):
                    self._open(Block("list", i, i, mark=kind), i, depth, first)
                    first = False
                spaces = _indent(after)
                width = m.end() + (1 if not after.strip() or spaces > 4 else spaces)
                self._open(Block("item", i, i, indent=indent + width, empty=not after.strip()), i, depth, first)
                at += indent + width
                first = False
                continue
            if self._is_table(i, body, depth if first else len(self.stack)):
                self._open(Block("table", i, i), i, depth, first)
                return True
            if going_on:
                return False
            self._open(Block("paragraph", i, i), i, depth, first)
            return True

    def _is_table(self, i: int, head: str, depth: int) -> bool:
        """Whether the line is a table's head: the next one, in the same containers, is a delimiter of as many columns."""
        if "|" not in head or i + 1 == len(self.lines):
            return False
        at = 0
        for block in self.stack[:depth]:
            if block.kind in _CONTAINERS:
                step = self._step(block, self.lines[i + 1], at, i + 1)
                if step is None:
                    return False
                at = step
        rest = self.lines[i + 1][at:]
        return _indent(rest) < 4 and (n := _is_delimiter(rest)) > 0 and n == _columns(head)


_CODE, _HTML_INLINE = re.compile(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"), re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->")
_IMAGE, _LINK = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\[([^\[\]]*)\]\([^)]*\)")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>")
_EMPHASIS = re.compile(r"(?<![\\*_\w])(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=[^\s\\])\1(?![*_\w])|(?<!\\)(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s\\*])\3(?!\*)")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def plain(title: str) -> str:
    """The text of a heading without its markup: no code, images or tags; links and emphasis by their text."""
    out = _HTML_INLINE.sub("", _AUTOLINK.sub(r"\1", _CODE.sub("", title)))
    out = _LINK.sub(r"\1", _IMAGE.sub("", out))
    for _ in range(3):
        out = _EMPHASIS.sub(lambda m: m[2] or m[4], out)
    return html.unescape(_ESCAPE.sub(r"\1", out)).strip()


def blocks(text: str) -> list[tuple[Block, int, int]]:
    """The top-level blocks in order, each with the offsets where its first line begins and its last line ends.

    Kinds are heading, paragraph, list, quote, table, fence, code, rule and html. A line's end belongs to its block, as do
    blank lines between a list and what follows. Link definitions are no block. Lines end at a line feed only.
    """
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    starts[-1] = min(starts[-1], len(text))
    return [(b, starts[b.start], starts[b.end + 1]) for b in _Reader(lines).read()]
