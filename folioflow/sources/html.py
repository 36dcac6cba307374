"""Lines of a content document: the innermost blocks of HTML, in order, without notes."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# What makes a line, what makes a heading, what is left out.
BLOCKS = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "div"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
DROPPED = frozenset({"script", "style", "aside"})
NOTE_TYPES = frozenset({"footnote", "endnote", "rearnote"})
NOTE_ROLES = frozenset({"doc-footnote", "doc-endnote"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})

_SPACE = re.compile(r"\s+")


def left_out(tag: str, attrs: dict[str, str | None]) -> bool:
    kind, role = attrs.get("epub:type"), attrs.get("role")
    return tag in DROPPED or kind in NOTE_TYPES or role in NOTE_ROLES or tag == "a" and (kind == "noteref" or role == "doc-noteref")


class _Block:
    __slots__ = ("tag", "parts", "has_block", "order")

    def __init__(self, tag: str, order: int):
        self.tag, self.parts, self.has_block, self.order = tag, [], False, order


class Lines(HTMLParser):
    """Open elements on a stack; text goes to every open block. With `implied_close` a block ends an open paragraph, as browsers have it;
    without, an unclosed paragraph holds what follows and, having a block inside, loses its own text."""

    def __init__(self, implied_close: bool = False):
        super().__init__(convert_charrefs=True)
        self.implied_close = implied_close
        self.stack: list[tuple[str, _Block | None, bool]] = []
        self.hidden = 0
        self.in_body: bool | None = None
        self.blocks: list[_Block] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.blocks, self.in_body = [], True
            self.stack = [(t, None, h) for t, _, h in self.stack]
        if tag in VOID:
            return
        block = None
        hide = left_out(tag, dict(attrs))
        if not hide and not self.hidden and tag in BLOCKS and self.in_body is not False:
            if self.implied_close and any(t == "p" for t, _, _ in self.stack):
                self.handle_endtag("p")
            for _, b, _ in self.stack:
                if b:
                    b.has_block = True
            block = _Block(tag, len(self.blocks))
            self.blocks.append(block)
        self.hidden += hide
        self.stack.append((tag, block, hide))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, _, hide = self.stack.pop()
            self.hidden -= hide
            if t == tag:
                break
        if tag == "body":
            self.in_body = False

    def handle_data(self, data: str) -> None:
        if not self.hidden and (text := data.strip()):
            for _, b, _ in self.stack:
                if b:
                    b.parts.append(text)


def document_lines(html: str | None, implied_close: bool = False) -> tuple[str | None, list[str]]:
    """The first heading, and the lines: texts of blocks that hold no other block, pieces joined by one space, none empty."""
    if not html:
        return None, []
    parser = Lines(implied_close)
    parser.feed(html)
    parser.close()
    heading, lines = None, []
    for b in parser.blocks:
        text = _SPACE.sub(" ", " ".join(b.parts)).strip()
        if b.has_block or not text:
            continue
        if heading is None and b.tag in HEADINGS:
            heading = text
        lines.append(text)
    return heading, lines
