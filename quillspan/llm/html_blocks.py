"""Pages to leaf blocks: text between block-level tags, with the path of elements above it."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = "script|style|template|noscript|iframe|svg|textarea|title|object"
#: A new one of these ends an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<hidden>{HIDDEN})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=hidden)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?(?P<odd>[a-z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
#: Open elements of a block's path, the innermost; all are followed to know what an end tag closes.
DEPTH = 256


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int  # of its characters, those in links


def _labels(name: str, rest: str) -> tuple[str, ...]:
    found = [name]
    if rest and "=" in rest:
        for m in NAMED.finditer(rest):
            found += ["." + w for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, character references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked, in_link, at = 0, False, 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, path, min(linked, len(text))))
            held.clear()
        linked = 0

    def close() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        name = m["name"] or m["odd"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif name == "a":
                in_link = not (m["end"] or m[0].startswith("</"))
            continue
        flush()
        if m["end"] or m[0].startswith("</"):
            if opened[name]:
                while close() != name:
                    pass
        elif name not in VOID:
            if name in SELF_CLOSING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        while len(stack) > k:
                            close()
                        break
                    if stack[k][0] not in SELF_CLOSING:
                        break
            stack.append((name, _labels(name, m["rest"] or "")))
            opened[name] += 1
        path = tuple(x for _, labels in stack[-DEPTH:] for x in labels)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out
