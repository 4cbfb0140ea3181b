"""Quality rules: how far a document's characters and common words are from those of its language."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base rules (fixed values).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_SHARE = 50  # percent

LEAST_SHARE = 1 / 1000  #: of a language's words, to be one of its common words
MAX_COMMON_WORDS = 1_000_000  #: of all languages together
MIN_CHARS = 200  #: shorter texts aren't judged by their characters
MIN_JUDGED_WORDS = 50  #: nor by their words
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.50

CLASSES = ("lower", "upper", "other letter", "mark", "digit", "space", "line end", "punctuation", "symbol", "other")
_CLASS_OF = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 3, "Mc": 3, "Me": 3, "Nd": 4, "Nl": 4, "No": 4, "Zs": 5, "Zl": 6, "Zp": 6}


def _class_of(code: int) -> int:
    char = chr(code)
    if char in "\n\r":
        return 6
    if char in "\t\v\f":
        return 5
    if char in SYMBOLS or unicodedata.category(char)[0] == "S":
        return 8
    return 7 if unicodedata.category(char)[0] == "P" else _CLASS_OF.get(unicodedata.category(char), 9)


_table: list[np.ndarray] = []


def char_classes(text: str) -> np.ndarray:
    """How many characters of the text are of each of CLASSES; those beyond U+FFFF are other."""
    if not _table:
        _table.append(np.array([_class_of(c) if not 0xD800 <= c < 0xE000 else 9 for c in range(1 << 16)] + [9], np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.bincount(_table[0][np.minimum(codes, 1 << 16)], minlength=len(CLASSES))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode().split()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter((count[x] > 1 for x in windows), bool, len(windows)))
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence in bits) of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


class Reference:
    """The histograms of a language: of character classes, and of its common words and all others."""

    def __init__(self, classes: list[int], words: dict[bytes, int], total: int):
        self.classes = np.array(classes, float)
        self.words = {w: k for k, w in enumerate(sorted(words))}
        self.counts = np.array([words[w] for w in self.words] + [total - sum(words.values())], float)

    def word_histogram(self, words: list[bytes]) -> np.ndarray:
        found = Counter(map(self.words.get, words))
        out = np.zeros(len(self.counts))
        for k, n in found.items():
            out[-1 if k is None else k] += n
        return out


COUNTS = "lang string, word binary, class int, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])
HELD_WORDS = 300_000


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Lower-cased words and character classes by language, counted over all documents."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        classes: dict[str, np.ndarray] = {}
        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).extend(words_of(text.lower()))
                    classes[lang] = classes.get(lang, 0) + char_classes(text)
            for lang, found in by.items():
                for w, n in Counter(found).items():
                    words[lang, w] += n
            if len(words) > HELD_WORDS:
                yield emit(words, {})
                words.clear()
        yield emit(words, classes)

    def emit(words: Counter, classes: dict[str, np.ndarray]) -> pa.RecordBatch:
        rows = [(lang, w, None, n) for (lang, w), n in words.items()]
        rows += [(lang, None, k, int(n)) for lang, x in classes.items() for k, n in enumerate(x)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_COUNTS)], schema=_COUNTS)

    parts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(task, COUNTS)
    return parts.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict[str, Reference]:
    """A reference for each language that has a word, counted over all its documents, whatever else the corpus holds.
    A language of few documents is what they are: each is near a reference of which it is a large part,
    and the fewer others there are, the nearer. There is no size from which on a language counts. It has a thousand common words at most; more than
    MAX_COMMON_WORDS of all languages, which would be thousands of languages, raise an error."""
    counts = common.written(corpus_counts(docs), "counts")
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("total")).where(F.col("total") > 0)
    own = counts.join(common.written(totals, "totals"), "lang")
    known = common.written(own.where(F.col("word").isNull() | (F.col("n") >= LEAST_SHARE * F.col("total"))), "references")
    if known.count() > MAX_COMMON_WORDS:
        raise ValueError("too many languages for references that every task holds")
    classes: dict[str, list[int]] = {}
    words: dict[str, dict[bytes, int]] = {}
    sums: dict[str, int] = {}
    for r in known.collect():
        sums[r["lang"]] = r["total"]
        if r["word"] is None:
            classes.setdefault(r["lang"], [0] * len(CLASSES))[r["class"]] = r["n"]
        else:
            words.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    return {x: Reference(classes[x], words.get(x, {}), n) for x, n in sums.items()}


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "char_distance double, word_distance double, base_failed boolean, kept boolean"
)


def judge(text: str | None, reference: Reference | None) -> tuple:
    """The columns of RESULT after doc_id."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEATED_SHARE * n
    by_char = by_word = None
    if reference and len(text) >= MIN_CHARS:
        by_char = distance(char_classes(text), reference.classes)
    if reference and n >= MIN_JUDGED_WORDS:
        by_word = distance(reference.word_histogram(words_of(text.lower())), reference.counts)
    near = (by_char or 0) <= MAX_CHAR_DISTANCE and (by_word or 0) <= MAX_WORD_DISTANCE
    return n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, by_char, by_word, failed, near and not failed


def assess(docs: DataFrame) -> DataFrame:
    """RESULT for every row of ``docs(doc_id, text, lang)``: the base rules' figures, the distances from
    the language's reference (null where the text is too short to judge) and the verdict.

    A null text counts as empty, and an empty one fails the base rules. A null language is a language of
    its own, like the empty name. Repeated rows get a row each; an empty table gives an empty table; other
    columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(references(docs))
    kinds = [pa.int64()] * 6 + [pa.float64()] * 2 + [pa.bool_()] * 2
    names = [x.split()[0] for x in RESULT.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = known.value
        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            rows = [judge(t, refs.get(x)) for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    return named.mapInArrow(task, RESULT)
