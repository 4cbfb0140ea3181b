"""One page's elements and blocks of text: a tolerant reading of its tags."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import xxhash

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: What an element's start ends, within the element that follows the colon.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
# Choices: what isn't part of an article.
ASIDE_TAGS = frozenset("head nav footer aside form button select option datalist dialog menu noscript template svg canvas object audio video map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations share sharing social comment comments disqus discussion reply replies "
    "respond responses newsletter subscribe subscription signup login search footer masthead toolbar pagination pager".split()
)
WHOLE = frozenset(["html", "body", "main", "article"])

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
_WORTH = re.compile("class|id|role|hidden|style", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """``parent, key, tag, aside`` of each element, of which 0 is the page itself; an element's key tells the path
    of tags, classes and ids to it, numbers in them aside. ``blocks`` are (element, text, characters in links);
    ``inline`` has the keys of tags that make no element."""

    parent: list[int] = field(default_factory=lambda: [-1])
    key: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    aside: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)


def child_key(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, parent & 0xFFFFFFFFFFFFFFFF) >> 1


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if attributes else {}


def _named_aside(own: dict[str, str]) -> bool:
    if "hidden" in own or own.get("role", "").lower() in ASIDE_ROLES or _HIDDEN.search(own.get("style", "")):
        return True
    for word in f"{own.get('class', '')} {own.get('id', '')}".split():
        parts = [p.lower() for p in _PART.findall(word)]
        if ASIDE_NAMES.intersection(parts) and parts[0] not in ("has", "with", "no", "without", "js"):
            return True
    return False


def read(source: str) -> Page:
    """Elements and blocks in page order. What isn't closed ends with what holds it; ends of what isn't open are
    passed over; a page may stop anywhere. An element that names itself aside holds no article and no main part."""
    page, low = Page(), ""
    open_, text, links, at = [0], [], 0, 0
    linked = 0

    def flush():
        nonlocal links
        if text:
            found = "".join(text)
            found = " ".join((entities.unescape(found) if "&" in found else found).split())
            if found:
                page.blocks.append((open_[-1], found, min(links, len(found))))
            text.clear()
        links = 0

    def close(count: int):
        flush()
        del open_[-count:]

    while at < len(source):
        m = _TAG.search(source, at)
        if not m:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
            if linked:
                links += m.start() - at
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            if name == "a":
                linked = 0
            for k in range(len(open_) - 1, 0, -1):
                if page.tag[open_[k]] == name:
                    close(len(open_) - k)
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            low = low or source.lower()
            stop = low.find(f"</{name}", at)
            at = len(source) if stop < 0 else stop
            continue
        own = _names(attributes) if attributes and _WORTH.search(attributes) else {}
        if name == "br":
            text.append(" ")
        if name in INLINE and (name in VOID or not (own and _named_aside(own))):
            page.inline.append(child_key(page.key[open_[-1]], name))
            linked = 1 if name == "a" else linked
            continue
        if name not in INLINE:
            flush()
            if name in VOID:
                continue
            ends, within = CLOSES.get(name, ("p", ""))
            ends, within = ends.split(), {*within.split(), "table", "td", "th"} if within else set()
            for k in range(len(open_) - 1, 0, -1):
                tag = page.tag[open_[k]]
                if tag in ends:
                    close(len(open_) - k)
                    if name not in ("td", "th", "tr"):
                        break
                elif tag in within or (name not in CLOSES and tag not in INLINE):
                    break
        up = open_[-1]
        label = f"{name}.{own.get('class', '')}#{own.get('id', '')}"
        inside = any(page.tag[k] in ("article", "main") for k in open_)
        aside = name in ASIDE_TAGS or (name == "header" and not inside) or (name not in WHOLE and bool(own) and _named_aside(own))
        page.parent.append(up)
        page.key.append(child_key(page.key[up], _DIGITS.sub("0", label)))
        page.tag.append(name)
        page.aside.append(aside)
        open_.append(len(page.key) - 1)
    flush()
    holds = [t in ("article", "main") for t in page.tag]
    for k in range(len(holds) - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
    for k in range(1, len(holds)):
        by_name = page.aside[k] and page.tag[k] not in ASIDE_TAGS and holds[k] and page.tag[k] not in ("article", "main")
        page.aside[k] = (page.aside[k] and not by_name) or page.aside[page.parent[k]]
    return page
