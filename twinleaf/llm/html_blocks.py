"""From HTML to the sequence of leaf blocks with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms msub msup mtext mfrac msqrt object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg textarea select".split())
#: An opening tag of the key closes an open one of the values, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article aside body details div dl fieldset footer form header html main menu nav ol section table tbody ul blockquote figure".split())

BLOCKS = frozenset("address caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup legend li p pre search summary td th thead tfoot tr".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
BLANKS = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int


def is_block(tag: str) -> bool:
    """Whether the tag parts blocks of text; those within a form's or a drawing's elements don't."""
    return bool(tag) and tag not in INLINE and tag not in VOID and tag in CONTAINERS | BLOCKS


def element(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role, as one string."""
    if not attributes or not attributes.strip(" /"):
        return tag
    names = " ".join(filter(None, (x for m in NAMES.finditer(attributes) for x in m.groups())))
    return f"{tag} {names.lower()}".strip() + (" hidden" if HIDDEN.search(attributes) else "")


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: runs of text between block-level tags, blank ones left out."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    link = 0
    in_link = 0
    unclosed: set[str] = set()  # raw elements of which no end follows

    def flush() -> None:
        nonlocal link
        if parts:
            text = BLANKS.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(tuple(e for t, e in stack if t not in INLINE), text, link))
            parts.clear()
        link = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        in_link -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if in_link:
                link += end - at
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            flush()
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
                continue
            # without an end it reaches to the next block
            unclosed.add(tag)
            while (m := MARKUP.search(page, at)) and not is_block((m[2] or m[5] or "").lower()):
                at = m.end()
            at = m.start() if m else n
            continue
        if tag in INLINE:
            if tag not in VOID and not attributes.endswith("/"):
                stack.append((tag, tag))
                in_link += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        if tag == "body":
            for k, (t, _) in enumerate(stack):
                if t == "head":
                    pop_to(k)
                    break
        closes = CLOSES.get(tag)
        for k in range(len(stack) - 1, -1, -1):
            t = stack[k][0]
            if t == "p" or (closes and t in closes):
                pop_to(k)
                break
            if t in CONTAINERS or t in ("td", "th") and tag not in CLOSES:
                break
        stack.append((tag, element(tag, attributes)))
    flush()
    return out
