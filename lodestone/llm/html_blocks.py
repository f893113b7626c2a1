"""Leaf blocks of a web page: texts between block-level tags, with the path of tags above each."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base col embed hr img input link meta param source track wbr br".split())
#: Elements whose content is no text of the page.
SILENT_TAGS = frozenset("script style title textarea noscript template svg math iframe object select canvas audio video".split())
#: An opening tag ends an open element of these kinds, up to the list or table that holds both.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z)))")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class Block(NamedTuple):
    #: Tag names above the text, outermost first, each followed by the words of its class, id and role as ``.word``.
    path: tuple[str, ...]
    text: str
    #: Code points inside links.
    linked: int


def parse(html: str) -> list[Block]:
    """Blocks with text in page order; character references decoded, white space single. Unclosed and stray tags are taken as browsers do in the common cases."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    buffer: list[str] = []
    linked = link_depth = pos = 0
    n = len(html)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(Block(tuple(x for _, names in stack for x in names), text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def add(chunk: str) -> None:
        nonlocal linked
        chunk = unescape(chunk) if "&" in chunk else chunk
        buffer.append(chunk)
        linked += len(chunk) * (link_depth > 0)

    while pos < n:
        m = _TAG.search(html, pos)
        if not m:
            add(html[pos:])
            break
        if m.start() > pos:
            add(html[pos:m.start()])
        pos = m.end()
        if m[1]:
            end = html.find("-->", m.start() + 2)
            pos = n if end < 0 else end + 3
            continue
        if m[2]:
            end = html.find(">", pos)
            pos = n if end < 0 else end + 1
            continue
        tag, closing = m[4].lower(), bool(m[3])
        if tag in SILENT_TAGS:
            if not closing and not m[5].rstrip(">").endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, pos)
                pos = end.end() if end else n
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
        elif tag == "br":
            buffer.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        link_depth = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ENDED_BY:
            kinds, until = ENDED_BY[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in until:
                    break
                if stack[k][0] in kinds:
                    del stack[k:]
                    break
        if tag not in VOID_TAGS:
            words = (w for a in _NAMES.findall(m[5]) for w in _WORD.findall("".join(a).lower())) if "=" in m[5] else ()
            stack.append((tag, (tag, *(f".{w}" for w in words))))
    flush()
    return out
