"""Substring deduplication by runs of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SENTENCE_WORDS = 10  #: longer sentences are cut further, at places that their words choose
RUN_WORDS = 30  #: a run has as many sentences as hold so many words

#: A sentence ends after a word with closing marks (of any script) at its end, or with its line.
MARKS = ".!?。！？．｡।॥؟۔։።፧។៕"
CLOSED = re.compile(rf"[{MARKS}][\"'”’»)\]」』]*\Z")

#: Characters of scripts without spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han): each counts as a word.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
TOKEN = re.compile(rf"\n|[{UNSPACED}]|[^\s{UNSPACED}]+")
SPACED_TOKEN = re.compile(r"\n|\S+")

# Odd multipliers of the hashes of runs: their powers have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SLICE_BYTES = 4 << 20  #: text that a task lays out at once

RUNS = "h1 long, h2 long, doc_id long, text_hash long, first int, n int"
_RUNS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])


def tokens(text: str) -> re.Pattern:
    return SPACED_TOKEN if text.isascii() else TOKEN


@dataclass
class Layout:
    """Sentences of some texts in a row. Word numbers run through all texts; ``first[d]`` and
    ``first[d + 1]`` bound the sentences of text d. ``hashes`` are two arrays, by word."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    line_end: np.ndarray
    hashes: np.ndarray


def layout(texts: list[str | None]) -> Layout:
    """Words, and where sentences begin and end. White space and letter case don't count.

    A sentence of over ten words is cut where the hash of two neighbours is the least of ten in a row.
    So no sentence is longer than ten words, and where two texts share a passage, all cuts but those
    within ten words of the passage's ends are the same in both, whatever stands around it.
    """
    parts = [tokens(x).findall(x.lower()) for x in (t or "" for t in texts)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    coded = pa.array(chain.from_iterable(parts), pa.large_string()).dictionary_encode()
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words), "<u8").reshape(-1, 2)
    closes = np.fromiter((CLOSED.search(w) is not None for w in words), bool, len(words))
    line = np.fromiter((w == "\n" for w in words), bool, len(words))[index]

    owner = np.repeat(np.arange(len(texts)), size)[~line]
    upto = np.cumsum(~line)
    index = index[~line]
    n = len(index)
    line_end = np.zeros(n, bool)
    line_end[upto[line & (upto > 0)] - 1] = True
    border = np.searchsorted(owner, np.arange(len(texts) + 1))
    if n:
        line_end[border[1:][border[1:] > 0] - 1] = True
    cut = np.ones(n + 1, bool)
    cut[1:] = closes[index] | line_end
    hashes = digest[index].T

    w = SENTENCE_WORDS
    if n >= w:
        rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        rank[1:] = (hashes[0][:-1] * np.uint64(BASES[0]) ^ hashes[0][1:]) * np.uint64(BASES[1]) >> np.uint64(1)
        least, at = rank[: n - w + 1].copy(), np.arange(n - w + 1)
        for k in range(1, w):
            lower = rank[k : n - w + 1 + k] <= least
            least[lower], at[lower] = rank[k : n - w + 1 + k][lower], np.flatnonzero(lower) + k
        cuts = np.concatenate([[0], np.cumsum(cut)])
        cut[at[cuts[w : n + 1] == cuts[: n - w + 1]]] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], n) if len(start) else start
    return Layout(start, end, np.searchsorted(start, border), line_end[end - 1] if n else line_end, hashes)


def runs(of: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first sentence, last sentence (both by layout) and hashes (two columns) of each run.

    From each sentence on, the fewest sentences that hold thirty words; and the fewest up to the end of
    each line. So of any fifty words in a row that two texts share, a run lies within them in both.
    """
    k = np.arange(len(of.start))
    text = np.searchsorted(of.first, k, side="right") - 1
    last = np.searchsorted(of.end, of.start + RUN_WORDS)
    back = np.searchsorted(of.start, of.end - RUN_WORDS, side="right") - 1
    on = np.flatnonzero(of.line_end & (back >= of.first[text]))
    first, last = np.concatenate([k, back[on]]), np.concatenate([last, on])
    own = last < of.first[text[first] + 1] if len(k) else np.zeros(0, bool)
    both = np.unique(np.stack([first[own], last[own]]), axis=1)
    first, last = both
    found = []
    for base, h in zip(BASES, of.hashes, strict=True):
        power, inverse = (np.append(np.uint64(1), np.cumprod(np.full(len(h), x, np.uint64))) for x in (base, pow(base, -1, 2**64)))
        sums = np.append(np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64))
        found.append((sums[of.end[last]] - sums[of.start[first]]) * inverse[of.start[first]])
    return text[first], first, last, np.stack(found) if len(first) else np.zeros((2, 0), np.uint64)


def again(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the same text has had the run before."""
    order = np.lexsort((np.arange(len(text)), hashes[1], hashes[0], text))
    same = np.zeros(len(text), bool)
    if len(text):
        t, a, b = text[order], hashes[0][order], hashes[1][order]
        same[order[1:]] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return same


def run_table(docs: DataFrame) -> DataFrame:
    """A row for each distinct run of each text, and rows without hashes for sentences (``n`` from
    ``first`` on) that the same text has had before in a run."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in common.slices(whole, "text", SLICE_BYTES)):
            of = layout(batch.column("text").to_pylist())
            text, first, last, hashes = runs(of)
            old = again(text, hashes)
            fresh = ~old
            covered = np.zeros(len(of.start) + 1, np.int64)
            np.add.at(covered, first[old], 1)
            np.add.at(covered, last[old] + 1, -1)
            edge = np.diff(np.concatenate([[0], (np.cumsum(covered)[:-1] > 0).astype(np.int64), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a text's first sentence is in no old run
            owner = np.concatenate([text[fresh], np.searchsorted(of.first, a, side="right") - 1])
            starts = np.concatenate([first[fresh], a])
            null = np.zeros(len(owner), bool)
            null[int(fresh.sum()) :] = True
            columns = [pa.array(np.concatenate([h[fresh], np.zeros(len(a), np.uint64)]).view(np.int64), mask=null) for h in hashes]
            columns += [batch.column(c).take(pa.array(owner)) for c in ("doc_id", "text_hash")]
            columns += [pa.array(starts - of.first[owner], pa.int32()), pa.array(np.concatenate([last[fresh] + 1 - first[fresh], b - a]), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=_RUNS)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return named.mapInArrow(task, RUNS)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the sentences' numbers of every document with a run that isn't the corpus's
    first: the first is the one of the smallest doc_id, and there the earliest. Rows with a null doc_id
    come last, a document for each text, in order of the texts' hashes.

    Counts by hash are combined before they move. The runs of hashes that occur more than once are
    joined from a written table, whose large partitions Spark splits if a hash is very frequent. Copies
    of a row give equal findings, of which one is kept before they move, too.
    """
    table = common.written(run_table(docs), "runs")
    fresh, own = table.where("h1 is not null"), table.where("h1 is null")
    nameless = F.col("doc_id").isNull()
    counts = fresh.groupBy("h1", "h2").agg(F.count("*").alias("count"), F.min("doc_id").alias("first_doc"), F.min(F.when(nameless, F.col("text_hash"))).alias("first_text"))
    often = common.written(counts.where("count > 1").select("h1", "h2", "first_doc", "first_text"), "repeated-runs")
    earlier = F.when(nameless, F.col("first_doc").isNotNull() | (F.col("text_hash") != F.col("first_text"))).otherwise(F.col("doc_id") != F.col("first_doc"))
    place = ["doc_id", "text_hash", "first", "n"]
    later = fresh.join(often, ["h1", "h2"]).where(earlier).select(*place).unionByName(own.select(*place))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n")).alias("found"))


def _with_copies(named: DataFrame) -> DataFrame:
    """``named(doc_id, text, text_hash)`` with ``copy``: whether a row with a null doc_id repeats the text of
    another such row. One of them, by the numbers of the rows as written, is no copy."""
    nameless = named.where("doc_id is null")
    if nameless.isEmpty():
        return named.withColumn("copy", F.lit(False))
    rows = common.written(nameless.withColumn("row_number", F.monotonically_increasing_id()), "nameless")
    first = common.written(rows.groupBy("text_hash").agg(F.min("row_number").alias("first")).select("first"), "nameless-firsts")
    marked = rows.join(first, F.col("row_number") == F.col("first"), "left").select("doc_id", "text", "text_hash", F.col("first").isNull().alias("copy"))
    return named.where("doc_id is not null").withColumn("copy", F.lit(False)).unionByName(marked)


def cut_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the sentences removed), n_sentences, n_removed and removed_spans (characters,
    merged) of every row of ``docs(doc_id, text)``.

    A sentence goes if any run that covers it has occurred before, in a document of smaller doc_id or
    earlier in its own. Sentences are at most ten words long (see :func:`layout`) and runs hold thirty
    words or more. Null and empty texts have no sentences (a null text stays null). Rows that share
    a doc_id count as one document: what it has first stays in each of them. Rows with a null doc_id come
    last and are a document each; all but one of those with equal texts are later
    copies. Other columns are ignored; an empty table gives an empty table.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    found = common.written(repeated_runs(docs), "covered").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found")
    rows = _with_copies(named).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "found", "copy")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "n_sentences": pa.int64(), "n_removed": pa.int64(), "removed_spans": span}

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in common.slices(whole, "text", SLICE_BYTES)):
            texts = batch.column("text").to_pylist()
            of, out = layout(texts), []
            text_of, first, last, _ = runs(of) if any(batch.column("copy").to_pylist()) else (None, None, None, None)
            for k, (text, found, copy) in enumerate(zip(texts, batch.column("found").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                a, b = of.first[k], of.first[k + 1]
                gone = np.zeros(b - a, bool)
                for x in found or []:
                    gone[x["first"] : x["first"] + x["n"]] = True
                if copy:
                    for i, j in zip(first[text_of == k] - a, last[text_of == k] - a, strict=True):
                        gone[i : j + 1] = True
                base = of.start[a] if b > a else 0
                out.append((*cut(text, of.start[a:b] - base, of.end[a:b] - base, gone),))
            columns = [batch.column("doc_id"), *(pa.array(list(x), kinds[n]) for n, x in zip(list(kinds)[1:], zip(*out, strict=True), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return rows.mapInArrow(task, "doc_id long, text string, n_sentences long, n_removed long, removed_spans array<struct<start:int,end:int>>")


def cut(text: str | None, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple[str | None, int, int, list[dict]]:
    """What is left of a text without the sentences (words from start to before end) that go."""
    if not gone.any():
        return text, len(gone), 0, []
    words = [m.span() for m in tokens(text).finditer(text) if m[0] != "\n"]
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    spans = [{"start": words[start[i]][0], "end": words[end[j - 1] - 1][1]} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    keep = [0, *(x for m in spans for x in (m["start"], m["end"])), len(text)]
    return "".join(text[a:b] for a, b in zip(keep[::2], keep[1::2], strict=True)), len(gone), int(gone.sum()), spans
