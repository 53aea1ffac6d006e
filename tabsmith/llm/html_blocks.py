"""HTML to leaf blocks: the text of a page cut at block-level tags, each with its tag path.

A small tolerant reader: comments (which end at ``<!-->``, ``<!--->``, ``-->`` or ``--!>``), scripts, styles,
frames, text fields, templates and drawings are dropped (elements whose names only begin so, as
<svg-icon>, are not; templates and drawings end with their own end tag, whatever is nested in them; <svg .../> is
closed at once); a quoted attribute may hold ``>``; a new block closes an open paragraph, an end tag closes what
was left open inside it, and text ends with the page.
"""

from __future__ import annotations

import re
from html import unescape

COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))"
#: What a tag holds up to its ``>``; an unbalanced quote ends with the tag.
INSIDE = r"(?:(?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+|[^>]*)"
TOKEN = re.compile(
    COMMENT
    + rf"|<(?P<raw>script|style|noscript|iframe|textarea)(?=[\s/>]){INSIDE}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    + rf"|<(?P<deep>template|svg)(?=[\s/>])(?P<closed>{INSIDE})(?:>|\Z)"
    + r"|<[!?][^>]*(?:>|\Z)"
    + rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{INSIDE})(?:>|\Z)",
    re.S | re.I)
#: Start and end tags of the elements that nest.
DEEP = {n: re.compile(rf"{COMMENT}|<(?P<end>/?){n}(?=[\s/>])(?P<closed>{INSIDE})>", re.S | re.I) for n in ("template", "svg")}
ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HREF = re.compile(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strong sub sup "
                   "time tt u var wbr img label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of the same group up to the nearest holder.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "option": ("option", ("select",)), "dt": ("dt dd", ("dl",)),
            "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
            "th": ("td th", ("tr", "table"))}


class Leaf:
    __slots__ = ("path", "text", "link_chars")

    def __init__(self, path: tuple, text: str, link_chars: int):
        self.path, self.text, self.link_chars = path, text, link_chars


def names_of(attrs: str) -> tuple:
    out = []
    for m in ATTR.finditer(attrs):
        value = CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "").lower()
        out += [f".{w}" for w in SPLIT.split(value) if w]
    return tuple(out)


def end_of(html: str, at: int, name: str) -> int:
    """Place after the end tag of an open ``template`` or ``svg``; that of the page if it has none."""
    depth = 1
    for m in DEEP[name].finditer(html, at):
        if m["closed"] is None or (name == "svg" and not m["end"] and m["closed"].endswith("/")):
            continue
        depth += -1 if m["end"] else 1
        if not depth:
            return m.end()
    return len(html)


def leaves(html: str | None, links: list | None = None) -> list[Leaf]:
    """Leaf blocks in page order; a path is the open tags' names, each with its class and id words."""
    out: list[Leaf] = []
    if not html:
        return out
    stack: list[tuple[str, tuple]] = []  # (name, whole path down to here)
    text: list[str] = []
    anchors = linked = 0
    seen_attrs: dict[str, tuple] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append(Leaf(stack[-1][1] if stack else (), joined, min(linked, len(joined))))
        linked = 0

    def close_to(i: int) -> None:
        nonlocal anchors
        anchors -= sum(1 for n, _ in stack[i:] if n == "a")
        del stack[i:]

    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            piece = unescape(html[at: m.start()])
            text.append(piece)
            if anchors:
                linked += len(piece)
        at = m.end()
        name = m["name"]
        if name is None:
            if m["deep"] and not (m["deep"].lower() == "svg" and m["closed"].endswith("/")):
                at = end_of(html, at, m["deep"].lower())
            continue
        name = name.lower()
        inline = name in INLINE
        if not inline:
            if name == "br":
                text.append(" ")
                continue
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close_to(i)
                    break
            continue
        attrs = m["attrs"]
        if name == "a" and links is not None and (h := HREF.search(attrs)):
            links.append(unescape(h[1] or h[2] or h[3] or ""))
        if name in VOID:
            continue
        if not inline:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            if name in SIBLINGS:
                group, holders = SIBLINGS[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in holders:
                        break
                    if stack[i][0] in group.split():
                        close_to(i)
                        break
        base = stack[-1][1] if stack else ()
        if inline:
            stack.append((name, base))
            anchors += name == "a"
        else:
            if attrs not in seen_attrs:
                seen_attrs[attrs] = names_of(attrs)
            stack.append((name, (*base, name, *seen_attrs[attrs])))
    if at < len(html):
        text.append(unescape(html[at:]))
    flush()
    return out
