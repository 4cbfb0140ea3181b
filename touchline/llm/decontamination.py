"""Benchmark decontamination: phrases of benchmark items found through an FM-index of each shard."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .fm_index import FMIndex

WINDOW = 13  # words (fixed value)
BLOCK_WINDOWS = 200_000  #: phrases that a task holds at once; a larger benchmark is searched in blocks
SHARD_BYTES = 8 << 20  #: text per shard
STRETCH = 128  #: words of a text that are indexed in a row
INDEX_WORDS = 4 << 20  #: of an index; a longer text gets several

#: ASCII bytes: letters to lower case, digits as they are, all others to spaces.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
WORD_CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


class Phrases:
    """Distinct windows of some items, as numbers of the windows' own vocabulary; 0 fills up short ones."""

    def __init__(self, windows: dict[tuple[bytes, ...], set]):
        codes = {w: k for k, w in enumerate(sorted({w for x in windows for w in x}), 1)}
        self.vocabulary = list(codes)
        self.length = np.array([len(x) for x in windows], np.int64)
        self.words = np.zeros((len(windows), WINDOW), np.int64)
        for k, x in enumerate(windows):
            self.words[k, WINDOW - len(x) :] = [codes[w] for w in x]
        self.items = list(dict.fromkeys(i for x in windows.values() for i in x))
        at = {i: k for k, i in enumerate(self.items)}
        owned = [sorted(at[i] for i in x) for x in windows.values()]
        self.owners = np.array([i for x in owned for i in x], np.int64)
        self.owned = np.cumsum([0, *map(len, owned)])


def write_phrases(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> list[str]:
    """Files in the shared folder, each with the windows of some items. Tasks make and write them; the
    driver gets their names. A window that items of several files have is in each of these."""
    folder = common.shared_folder(benchmark.sparkSession, "phrases")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[tuple[bytes, ...], set] = {}

        def close() -> pa.RecordBatch:
            file = f"{folder}/{uuid.uuid4().hex}.pickle"
            with common.open_output(file) as out:
                out.write(pickle.dumps(Phrases(windows)))
            windows.clear()
            return pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for k in range(max(len(words) - WINDOW + 1, bool(words))):
                    windows.setdefault(tuple(words[k : k + WINDOW]), set()).add(item)
                    if len(windows) >= block_windows:
                        yield close()
        if windows:
            yield close()

    return sorted(r["file"] for r in benchmark.select("item_id", "text").mapInArrow(task, "file string").collect())


_loaded: dict[str, Phrases] = {}


def load(file: str) -> Phrases:
    """A worker keeps the last block that it read."""
    if file not in _loaded:
        _loaded.clear()
        with common.open_input(file) as f:
            _loaded[file] = pickle.loads(f.read())
    return _loaded[file]


class Shard:
    """The words of some documents in a row, as numbers from 1 of the shard's own vocabulary."""

    def __init__(self, docs: list[list[bytes]]):
        self.borders = np.cumsum([0, *map(len, docs)])
        coded = pa.array(chain.from_iterable(docs), pa.large_binary()).dictionary_encode()
        self.words, self.vocabulary = coded.indices.to_numpy().astype(np.int64) + 1, coded.dictionary

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretches begin that the texts are indexed in, and how many words each has: STRETCH, and
        as many of the next one's as a window can reach into. Their length bounds how far suffixes can be
        equal, whatever copies a shard holds, and so the rounds of sorting them."""
        size = np.diff(self.borders)
        each = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + 1) // STRETCH)), 0)
        number = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        start = np.repeat(self.borders[:-1], each) + number * STRETCH
        return start, np.minimum(STRETCH + WINDOW - 1, np.repeat(self.borders[1:], each) - start)

    def indexes(self) -> Iterator[tuple[FMIndex, np.ndarray]]:
        """An index of all stretches, with the number of the word at each place of its text; several only if
        the shard is one very long text."""
        start, size = self.stretches()
        upto = np.concatenate([[0], np.cumsum(size + 1)])
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + INDEX_WORDS, side="right")) - 1)
            own, ends = size[a:b], upto[a + 1 : b + 1] - upto[a] - 1
            place = np.repeat(start[a:b] - (ends - own), own + 1) + np.arange(int(ends[-1]) + 1)
            place[ends] -= 1
            text = self.words[place]
            text[ends] = 0
            yield FMIndex(text, len(self.vocabulary) + 1), place
            a = b

    def search(self, blocks: Callable[[], Iterable[Phrases]]) -> tuple[np.ndarray, list[set]]:
        """Which words lie in an occurrence of a window, and the items with an occurrence, by document."""
        hit, items = np.zeros(len(self.words), bool), [set() for _ in self.borders[1:]]
        for index, place in self.indexes():
            for phrases in blocks():
                own = pc.index_in(pa.array(phrases.vocabulary, pa.large_binary()), value_set=self.vocabulary)
                code = np.concatenate([[0], pc.fill_null(own, -2).to_numpy().astype(np.int64) + 1])  # words that the shard lacks: -1
                low, high = index.search(code[phrases.words], phrases.length)
                n = np.maximum(high - low, 0)
                window = np.repeat(np.arange(len(n)), n)
                at = index.locate(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                change = np.zeros(len(place) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + phrases.length[window], -1)
                hit[place[np.cumsum(change)[:-1] > 0]] = True
                doc = np.searchsorted(self.borders, place[at], side="right") - 1
                for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                    items[d].update(phrases.items[i] for i in phrases.owners[phrases.owned[w] : phrases.owned[w + 1]])
        return hit, items


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Merged spans of characters: from the first to the last word of each row of hit words."""
    spans, last = [], -2
    for k, (m, on) in enumerate(zip(WORD_CHARS.finditer(text), hit.tolist(), strict=True)):
        if on:
            if k == last + 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = k
    return spans


def scan(docs: DataFrame, benchmark: DataFrame, schema, emit: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch]) -> DataFrame:
    """Search all texts shard by shard; ``emit`` makes the result of a shard and its findings."""
    files = write_phrases(benchmark)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in common.slices(whole, "text", SHARD_BYTES)):
            texts = batch.column("text").to_pylist()
            shard = Shard([words_of(x) for x in texts])
            borders = shard.borders
            hit, items = shard.search(lambda: map(load, files))
            rows = []
            for k, text in enumerate(texts):
                own = hit[borders[k] : borders[k + 1]]
                n = int(own.sum())
                rows.append({"n_words": len(own), "n_hit": n, "items": list(items[k]), "spans": spans_of(text, own) if n else []})
            yield emit(batch, rows)

    return docs.mapInArrow(task, schema)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids with an occurring window) and spans (characters to remove,
    merged) of every row of ``docs(doc_id, text)``, against ``benchmark(item_id, text)``.

    Null and empty texts have no words, neither as documents nor as items; an item of fewer than
    thirteen words is one window. Repeated item_ids are one item; a null item_id is an item like
    any other; ids may be of any type. Repeated documents get a row each. Empty tables: no rows, or no hits.
    """
    kind = benchmark.schema["item_id"].dataType
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def emit(batch: pa.RecordBatch, rows: list[dict]) -> pa.RecordBatch:
        column = lambda name, kind: pa.array([x[name] for x in rows], kind)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), column("n_words", pa.int64()), column("n_hit", pa.int64()), column("items", pa.list_(to_arrow_type(kind))), column("spans", span)],
            ["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    schema = f"doc_id long, n_words long, n_hit long, items array<{kind.simpleString()}>, spans array<struct<start:int,end:int>>"
    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, schema, emit)


def contaminated(n_words, n_hit):
    """A twentieth of the words or more lies in benchmark passages (columns or numbers)."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; all columns, unchanged. Rows are judged one by one, so
    repeated rows and ids share their fate; null and empty texts stay; an empty table stays empty."""

    def emit(batch: pa.RecordBatch, rows: list[dict]) -> pa.RecordBatch:
        return batch.filter(pa.array([not contaminated(x["n_words"], x["n_hit"]) for x in rows], pa.bool_()))

    return scan(docs, benchmark, docs.schema, emit)
