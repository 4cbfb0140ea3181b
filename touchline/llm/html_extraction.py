"""The main text of web pages, by the template that the pages of a host share.

Tokens are elements by their path, tags within text, and words by the element that they stand in (a block of
more than ``LONG`` words is one token). Tokens that occur equally often on every page of a host, page by page,
form an equivalence class. Classes that keep their order on the pages are valid; they nest by the paths of
their elements and make up the host's template. What is between them are slots: the region of the
template whose slots hold the host's own text is extracted, without what stays the same from page to page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .html_page import Page, read

LONG = 16  #: words of a block that is one token
ELEMENT_SHARE, TEXT_SHARE = 0.2, 0.5  #: of a host's pages that a token of a class is on
LEAST_PAGES = 5  #: pages of different headings on which text of the template is, at least
LEAST_SIZE = 2  #: tokens of a class
DISORDER = 0.1  #: share of a class's pages on which its tokens may be out of order
REGION = 0.65  #: share of a host's text that a region holds where no element says that it is the article
NO_REGION = frozenset("p li dt dd td th tr pre blockquote h1 h2 h3 h4 h5 h6 caption figcaption summary".split())  #: parts of a text
ELEMENT, TEXT = 0, 1


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; what has none counts as one host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def block_tokens(page: Page, k: int) -> list[int]:
    """The text tokens of a block: its words, or itself where it is long."""
    element, text, _ = page.blocks[k]
    words, seed = text.split(" "), page.key[element] ^ 0x5555
    return [xxhash.xxh64_intdigest(w, seed) >> 1 for w in (words if len(words) <= LONG else [text])]


def tokens_of(page: Page) -> Iterator[tuple[int, int]]:
    """Kind and token of everything on the page: elements, tags, words. Within each, in page order."""
    yield from ((ELEMENT, key) for key in page.key[1:])
    yield from ((ELEMENT, key) for key in page.inline)
    for k in range(len(page.blocks)):
        yield from ((TEXT, token) for token in block_tokens(page, k))


def heading(page: Page) -> str:
    """What the page is about: its first h1, or its first block that isn't aside."""
    own = [(page.tag[e] != "h1", k) for k, (e, _, _) in enumerate(page.blocks) if not page.aside[e]]
    return page.blocks[min(own)[1]][1] if own else ""


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    for batch in batches:
        for part in slices(batch, "html"):
            yield part, [read(x or "") for x in part.column("html").to_pylist()]


def count_tokens(pages: DataFrame) -> DataFrame:
    """host, kind, token with n (pages it is on), low, high (sums that are equal for tokens of equal occurrence
    vectors), place (its mean place on them) and seen (64 bits, of which different headings set different ones).
    Summed in each task before rows move."""

    def task(batches):
        for part, read_pages in _pages(batches):
            hosts = part.column("host").to_pylist()
            number = {h: k for k, h in enumerate(dict.fromkeys(hosts))}
            rows: dict[tuple[int, int, int], list[int]] = {}
            for host, source, page in zip(hosts, part.column("html").to_pylist(), read_pages, strict=True):
                found: dict[tuple[int, int], list[int]] = {}
                for place, token in enumerate(tokens_of(page)):
                    own = found.get(token)
                    if own is None:
                        found[token] = [1, place]
                    else:
                        own[0] += 1
                identity, bit = xxhash.xxh64_intdigest(source or ""), 1 << xxhash.xxh64_intdigest(heading(page)) % 64
                for (kind, token), (times, place) in found.items():
                    vector = (identity ^ times * 0x9E3779B97F4A7C15) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
                    key = (number[host], kind, token)
                    own = rows.get(key)
                    if own is None:
                        rows[key] = [1, vector & 0xFFFFFFFF, vector >> 32, place, bit]
                    else:
                        own[0] += 1
                        own[1] += vector & 0xFFFFFFFF
                        own[2] += vector >> 32
                        own[3] += place
                        own[4] |= bit
            names = list(number)
            columns = [np.array(c, np.uint64).view(np.int64) for c in zip(*rows.values(), strict=True)] if rows else [np.empty(0, np.int64)] * 5
            keys = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in keys[0]], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int64()), *map(pa.array, columns)], ["host", "kind", "token", "n", "low", "high", "place", "seen"]
            )

    found = pages.mapInArrow(task, "host string, kind int, token long, n long, low long, high long, place long, seen long")
    return found.groupBy("host", "kind", "token").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high", "place")], F.bit_or("seen").alias("seen"))


def page_counts(pages: DataFrame) -> DataFrame:
    """host, n_pages; a scan of the URLs alone."""
    return pages.groupBy("host").agg(F.count("*").alias("n_pages"))


def equivalence_classes(tokens: DataFrame, totals: DataFrame) -> DataFrame:
    """host, n_pages, tokens: an array of kind, token, class and place in page order, of all classes large and
    frequent enough; ``totals`` has host, n_pages. A host's tokens are bounded: each is on a fifth of its pages at least, so there are at most
    five times as many as a page has."""
    share = F.when(F.col("kind") == TEXT, TEXT_SHARE).otherwise(ELEMENT_SHARE)
    both = tokens.join(totals, "host").where(F.col("n") >= share * F.col("n_pages"))
    both = both.where((F.col("kind") != TEXT) | (F.bit_count("seen") >= LEAST_PAGES))
    each = F.struct(F.col("kind"), F.col("token"), (F.col("place") / F.col("n")).alias("place"))
    classes = both.groupBy("host", "n_pages", "n", "low", "high").agg(F.collect_list(each).alias("own")).where(F.size("own") >= LEAST_SIZE)
    classes = classes.select("host", "n_pages", F.xxhash64("n", "low", "high").alias("class"), F.explode("own").alias("t"))
    listed = F.array_sort(F.collect_list(F.struct("t.place", "t.kind", "t.token", "class")))
    return classes.groupBy("host", "n_pages").agg(listed.alias("tokens"))


@dataclass
class Template:
    """A host's template as tasks use it: class of each token, and mean text of each slot."""

    classes: dict[tuple[int, int], int] = field(default_factory=dict)
    order: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    slots: dict[int, float] = field(default_factory=dict)

    @classmethod
    def of(cls, tokens: list[dict] | None, slots: list[dict] | None = None) -> Template:
        out = cls()
        for t in tokens or ():
            out.classes[t["kind"], t["token"]] = t["class"]
            out.order.setdefault(t["class"], []).append((t["kind"], t["token"]))
        out.slots = {s["slot"]: s["chars"] for s in slots or ()}
        return out

    def slot(self, page: Page, element: int) -> int:
        """The innermost element of the template around ``element``; 0 is the page."""
        while element and (ELEMENT, page.key[element]) not in self.classes:
            element = page.parent[element]
        return element

    def unordered(self, page: Page) -> dict[int, bool]:
        """For each class on the page: whether its tokens are out of the order that they have over all pages."""
        first: dict[tuple[int, int], int] = {}
        for place, token in enumerate(tokens_of(page)):
            if token in self.classes:
                first.setdefault(token, place)
        out = {}
        for number, tokens in self.order.items():
            for kind in (ELEMENT, TEXT):
                places = [first[t] for t in tokens if t[0] == kind and t in first]
                if places:
                    out[number] = out.get(number, False) or places != sorted(places)
        return out

    def same_text(self, page: Page, k: int) -> bool:
        return all((TEXT, token) in self.classes for token in block_tokens(page, k))

    def region(self, page: Page) -> int:
        """The element to extract: the article or main part with the most text by the host's mean, else the
        innermost element of the template with most of the page's text by that mean."""
        weight = [0.0] * len(page.key)
        slots = {e: self.slots.get(page.key[e], 0.0) for e in dict.fromkeys(self.slot(page, e) for e in range(len(page.key))) if not page.aside[e]}
        spread: dict[int, int] = {}
        for e in slots:
            spread[page.key[e]] = spread.get(page.key[e], 0) + 1
        for e, chars in slots.items():
            weight[e] += chars / spread[page.key[e]]
        for e, text, links in page.blocks:  # what the host's mean can't tell apart, the page's own text does
            if not page.aside[e]:
                weight[e] += 1e-6 * (len(text) - links)
        for e in range(len(weight) - 1, 0, -1):
            weight[page.parent[e]] += weight[e]
        for tag in ("article", "main"):
            own = [e for e in range(1, len(weight)) if page.tag[e] == tag and not page.aside[e]]
            if own:
                return max(own, key=lambda e: (weight[e], -e))
        region = 0
        while True:
            inner = [e for e in range(region + 1, len(weight)) if page.parent[e] == region and page.tag[e] not in NO_REGION and weight[e] >= REGION * weight[0] > 0]
            if not inner:
                return region
            region = inner[0]

    def text(self, page: Page) -> str:
        region = self.region(page)
        inside = [region == 0]
        for e in range(1, len(page.key)):
            inside.append(e == region or inside[page.parent[e]])
        own = [k for k, (e, _, _) in enumerate(page.blocks) if inside[e] and not page.aside[e]]
        if not any(page.tag[page.blocks[k][0]] == "h1" for k in own):
            own = sorted({*own, *(k for k, (e, _, _) in enumerate(page.blocks) if page.tag[e] == "h1" and not page.aside[e])})
        return "\n".join(page.blocks[k][1] for k in own if not self.same_text(page, k))


def _templates(part: pa.RecordBatch, known: dict[str, Template], with_slots: bool) -> list[Template]:
    hosts, out = part.column("host").to_pylist(), []
    for k, host in enumerate(hosts):
        if host not in known:
            if len(known) > 256:
                known.clear()
            known[host] = Template.of(part.column("tokens")[k].as_py(), part.column("slots")[k].as_py() if with_slots else None)
        out.append(known[host])
    return out


def measure_slots(pages: DataFrame) -> DataFrame:
    """host, kind, token, n, bad, chars over ``pages(host, html, tokens)``: of each class (kind TEXT) the pages that it is
    on and out of order on; of each slot (kind ELEMENT) the characters outside links that don't belong to the template."""

    def task(batches):
        known: dict[str, Template] = {}
        for part, read_pages in _pages(batches):
            rows: dict[tuple[str, int, int], list[int]] = {}
            for host, page, template in zip(part.column("host").to_pylist(), read_pages, _templates(part, known, False), strict=True):
                for number, bad in template.unordered(page).items():
                    own = rows.setdefault((host, TEXT, number), [0, 0, 0])
                    own[0] += 1
                    own[1] += bad
                for k, (element, text, links) in enumerate(page.blocks):
                    if not page.aside[element] and not template.same_text(page, k):
                        rows.setdefault((host, ELEMENT, page.key[template.slot(page, element)]), [0, 0, 0])[2] += len(text) - links
            found = [(*key, *own) for key, own in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(_SLOT_TYPES)], _SLOT_NAMES)

    found = pages.mapInArrow(task, "host string, kind int, token long, n long, bad long, chars long")
    return found.groupBy("host", "kind", "token").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "chars")])


_SLOT_NAMES, _SLOT_TYPES = ["host", "kind", "token", "n", "bad", "chars"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def templates(pages: DataFrame) -> DataFrame:
    """host, tokens, slots: the valid classes of each host of ``pages(host, html)`` and the text in its slots. Pages
    meet their host's classes by a join on the host, whose small side is a written table: Spark sends it to all
    tasks if it is small, else joins by sorting, where it can split the pages of a hot host."""
    classes = written(equivalence_classes(count_tokens(pages), page_counts(pages)), "classes")
    measured = written(measure_slots(pages.join(classes.select("host", "tokens"), "host", "left")), "slots")
    bad = measured.where((F.col("kind") == TEXT) & (F.col("bad") > DISORDER * F.col("n"))).groupBy("host").agg(F.collect_list("token").alias("invalid"))
    slots = measured.where(F.col("kind") == ELEMENT).join(classes.select("host", "n_pages"), "host")
    slots = slots.groupBy("host").agg(F.collect_list(F.struct(F.col("token").alias("slot"), (F.col("chars") / F.col("n_pages")).alias("chars"))).alias("slots"))
    both = classes.join(bad, "host", "left").join(slots, "host", "left")
    valid = F.filter("tokens", lambda t: ~F.array_contains(F.coalesce("invalid", F.array().cast("array<bigint>")), t["class"]))
    return written(both.select("host", valid.alias("tokens"), "slots"), "templates")


def extract(pages: DataFrame, pick: Callable[[Template, Page], str] = Template.text) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``, repeated and null ids too.

    A null html is empty; a page without blocks has the text ''. Hosts of few pages have no text in their
    template; there, elements alone decide. White space of any kind within a block is one space; blocks are
    lines. A page whose heading others share (copies) is no evidence that its words belong to the template.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = rows.join(templates(rows.select("host", "html")), "host", "left")

    def task(batches):
        known: dict[str, Template] = {}
        for part, read_pages in _pages(batches):
            texts = [pick(template, page) for page, template in zip(read_pages, _templates(part, known, True), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")
