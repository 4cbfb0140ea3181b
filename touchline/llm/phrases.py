"""Phrase collocations: how often phrases of two to five words occur, and which are more than their parts.

Counting is by vertical partitioning of a suffix tree that is cut at five words. Words and then pairs of words
that are too rare to be in a result end every phrase, so that what is left of the texts can be told by
numbers. The pairs are the prefixes: they are dealt to groups of at most ``Settings.budget`` suffixes, a subtree is built
for each group by itself, and a node's count is the total of its leaves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, open_input, slices, written

MIXES = 64  #: parts in which a language's candidates are ranked first
END = b"\xff"  #: between pieces; no byte of a text


@dataclass(frozen=True)
class Settings:
    """What is reported, and how much a task holds at a time (which changes no result)."""

    least: int = 100  #: occurrences of a candidate
    top: int = 2000  #: rows of a language's report
    budget: int = 1 << 16  #: suffixes of a group
    block: int = 1 << 22  #: words or pairs of a block, of which a task holds one
    words: int = 1 << 18  #: distinct words that a task counts before it hands them on
    pairs: int = 1 << 21  #: pairs, likewise


SETTINGS = Settings()
_PLAIN = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", END * 10 + b" ")


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order, with END between pieces."""
    return END.join(texts).lower().translate(_PLAIN).replace(END, b" \xff ").split()


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of some texts at a time; ``batches`` have lang and text."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                yield lang, words_of(own)


def count_words(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """lang, word, n; ``docs`` has lang and text. Counted in each task before rows move."""

    def task(batches):
        held: dict[str, Counter] = {}

        def rows():
            found = [(lang, word.decode(), n) for lang, counts in held.items() for word, n in counts.items()]
            held.clear()
            return pa.RecordBatch.from_pydict({"lang": [x[0] for x in found], "word": [x[1] for x in found], "n": [x[2] for x in found]}, pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

        for lang, words in by_language(batches):
            counts = held.setdefault(lang, Counter())
            counts.update(words)
            counts.pop(END, None)
            if sum(map(len, held.values())) > settings.words:
                yield rows()
        yield rows()

    return docs.mapInArrow(task, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def saved_in_blocks(df: DataFrame, key: str, name: str, block: int) -> tuple[DataFrame, list[str]]:
    """``df`` as a table sorted by ``key`` over files of about ``block`` rows, and the files in order."""
    rows = written(df, name)
    blocks = max(1, -(-rows.count() // block))
    found = written(rows.repartitionByRange(blocks, key).sortWithinPartitions(key), name)
    files = sorted(found.inputFiles())
    dropped(rows)
    return found, files


class Blocks:
    """Sorted keys in files, one of which is held at a time."""

    def __init__(self, files: list[str], key: str, count: str | None = None):
        self.files, self.key, self.count, self.at, self.table = files, key, count, -1, None

    def load(self, k: int) -> tuple[np.ndarray, np.ndarray | None]:
        if self.at != k:
            with open_input(self.files[k]) as f:
                table = pq.read_table(f, columns=[self.key] + [self.count] * bool(self.count))
            self.at, self.table = k, tuple(table.column(c).to_numpy() for c in table.column_names)
        return self.table[0], self.table[1] if self.count else None

    def places(self, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each block: its number, the keys in all blocks before it, which of ``keys`` are in it, and where."""
        past = 0
        for k in range(len(self.files)):
            own, _ = self.load(k)
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                yield k, past, hit, at[hit]
                past += len(own)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places over all blocks, from 1; 0 for others."""
        out = np.zeros(len(keys), np.int32)
        for _, past, hit, at in self.places(keys):
            out[hit] = at + past + 1
        return out


def word_hash(lang: Column, word: Column, salt: int) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\0"), word, F.lit(f"\0{salt}")))


def frequent_words(words: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, list[str], int]:
    """lang, word, n, id of the words frequent enough, the blocks of their hashes, and the salt by which no
    frequent word shares its hash with any other: numbers then stand for words without doubt."""
    salt = 0
    while True:
        hashed = words.withColumn("hash", word_hash(F.col("lang"), F.col("word"), salt))
        shared = hashed.groupBy("hash").agg(F.count("*").alias("rows"), F.max("n").alias("most")).where((F.col("rows") > 1) & (F.col("most") >= settings.least))
        if shared.isEmpty():
            break
        salt += 1
    table, files = saved_in_blocks(hashed.where(F.col("n") >= settings.least), "hash", "frequent", settings.block)

    def task(batches):
        blocks = Blocks(files, "hash")
        for batch in batches:
            yield batch.append_column("id", pa.array(blocks.numbers(batch.column("hash").to_numpy())))

    return table.mapInArrow(task, "lang string, word string, n long, hash long, id int").drop("hash"), files, salt


def encoded(docs: DataFrame, files: list[str], salt: int) -> DataFrame:
    """ids: the texts in numbers of frequent words as 32-bit integers, a row for some texts of a language; 0 is
    the end of a piece or any rarer word."""

    class Numbered(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    def task(batches):
        blocks, tail = Blocks(files, "hash"), b"\0%d" % salt
        for lang, words in by_language(batches):
            index, head = Numbered(), lang.encode() + b"\0"
            at = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
            hashes = np.fromiter((xxhash.xxh64_intdigest(head + w + tail, 42) for w in index), np.uint64, len(index)).view(np.int64)
            number = blocks.numbers(hashes)
            number[index.get(END, len(index)) :][:1] = 0
            ids = number[at]
            ids = ids[(ids != 0) | (np.append(0, ids[:-1]) != 0)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array([ids.tobytes()], pa.binary())})

    return docs.mapInArrow(task, "ids binary")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column("ids"):
            yield np.frombuffer(row.as_buffer(), np.int32)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """The key of each word and the next; 0 where one of the two is none."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), a << 32 | b, 0)


def _totals(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns, in order, and the sums of n."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    begins = np.flatnonzero(new)
    return [c[begins] for c in columns], np.add.reduceat(n, begins) if len(n) else n


def count_pairs(texts: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """pair, n of all pairs of frequent words that follow one another."""

    def task(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            (keys,), n = _totals([np.concatenate([np.empty(0, np.int64), *(k for k, _ in held)])], np.concatenate([np.empty(0, np.int64), *(n for _, n in held)]))
            held[:] = [(keys, n)]
            return keys, n

        for ids in _ids(batches):
            keys = _pairs(ids)
            held.append(np.unique(keys[keys > 0], return_counts=True))
            if sum(len(k) for k, _ in held) > settings.pairs:
                keys, n = merged()
                if len(keys) > settings.pairs // 2:
                    held.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
        keys, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    return texts.mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def suffixes(texts: DataFrame, files: list[str], settings: Settings = SETTINGS) -> DataFrame:
    """group, whole, pair, rest (third and fourth word), fifth, n of all suffixes that go on after a frequent
    pair with another, cut at five words and before the first pair that isn't frequent.

    A block's pairs go to groups one after the other, up to ``budget`` suffixes each. A pair that has more is dealt
    over groups by the words that follow it: their counts are parts (``whole`` is false)."""

    def task(batches):
        blocks = Blocks(files, "pair", "n")
        for ids in _ids(batches):
            keys = np.append(_pairs(ids), np.zeros(4, np.int64))
            frequent = np.zeros(len(keys), bool)
            for _, _, hit, _ in blocks.places(keys):
                frequent |= hit
            begins = np.flatnonzero(frequent[:-1] & frequent[1:])
            long = np.append(ids, np.zeros(4, np.int32)).astype(np.int64)
            four = frequent[begins + 2]
            five = four & frequent[begins + 3]
            rest = long[begins + 2] << 32 | np.where(four, long[begins + 3], 0)
            (pair, rest, fifth), n = _totals([keys[begins], rest, np.where(five, long[begins + 4], 0)], np.ones(len(begins), np.int64))
            for k, _, hit, at in blocks.places(pair):
                counts = blocks.load(k)[1]
                whole = counts <= settings.budget
                group = np.cumsum(np.where(whole, counts, 0)) // settings.budget << 1
                parts = -(-counts[at] // settings.budget)
                mixed = (rest[hit] * 0x9E3779B1 + fifth[hit] * 0x85EBCA77 >> 7) % parts
                own = np.where(whole[at], group[at], mixed << 32 | at << 1 | 1) << 10 | k
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, whole[at], pair[hit], rest[hit], fifth[hit], n[hit])], ["group", "whole", "pair", "rest", "fifth", "n"])

    return texts.mapInArrow(task, "group long, whole boolean, pair long, rest long, fifth long, n long")


def subtrees(leaves: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """pair, rest, fifth, n of all nodes of three to five words of each group's subtree; groups are built
    independently, and nodes below ``least`` go where the group holds all of their leaves."""

    def build(table: pa.Table) -> pa.Table:
        pair, rest, fifth, n = (table.column(c).to_numpy() for c in ("pair", "rest", "fifth", "n"))
        whole = table.column("whole")[0].as_py()
        nodes = []
        for columns, there in (([pair, rest >> 32 << 32], rest > 0), ([pair, rest], rest & 0xFFFFFFFF > 0), ([pair, rest, fifth], fifth > 0)):
            keys, total = _totals([c[there] for c in columns], n[there])
            keep = total >= settings.least if whole else total > 0
            nodes.append([*[k[keep] for k in keys], *[np.zeros(int(keep.sum()), np.int64)] * (3 - len(keys)), total[keep]])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*nodes, strict=True)], ["pair", "rest", "fifth", "n"])

    found = leaves.groupBy("group").applyInArrow(build, "pair long, rest long, fifth long, n long")
    return found.groupBy("pair", "rest", "fifth").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)


def count_phrases(docs: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ids, f of every phrase of one to five words with ``least`` occurrences; lang, word, n, id of its words; and
    lang, n of all words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = written(count_words(docs, settings), "words")
    words, files, salt = frequent_words(counted, settings)
    words = written(words, "word-ids")
    texts = written(encoded(docs, files, salt), "encoded")
    pairs, pair_files = saved_in_blocks(count_pairs(texts, settings).where(F.col("n") >= settings.least), "pair", "pairs", settings.block)
    nodes = subtrees(suffixes(texts, pair_files, settings), settings)
    high, low = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    two = pairs.select(F.array(high("pair"), low("pair")).alias("ids"), F.col("n").alias("f"))
    ids = F.array(high("pair"), low("pair"), high("rest"), low("rest"), F.col("fifth").cast("int"))
    more = nodes.select(F.array_remove(ids, 0).alias("ids"), F.col("n").alias("f"))
    one = words.select(F.array("id").alias("ids"), F.col("n").alias("f"))
    found = written(one.unionByName(two).unionByName(more), "phrases")
    dropped(texts)
    return found, words, written(counted.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")


def collocations(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two to five words.

    A null language is ``und``; a null or empty text has no words; repeated rows count each time. Phrases end
    at punctuation and line ends and may overlap. Products are decimals of 38 digits. A phrase within another
    that is as frequent is left out: the next longer ones are enough to tell, for all between are as frequent.
    """
    phrases, words, totals = count_phrases(docs, settings)
    size = F.size("ids")
    candidates = phrases.where(size >= 2)
    cuts = candidates.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    parts = lambda side, count: phrases.select(F.col("ids").alias(side), F.col("f").alias(count))
    cuts = cuts.join(parts("left", "l"), "left").join(parts("right", "r"), "right")
    language = words.join(totals.withColumnRenamed("n", "total"), "lang").select(F.array("id").alias("first"), "lang", "total")
    cuts = cuts.withColumn("first", F.slice("ids", 1, 1)).join(language, "first")
    score = F.expr("(1000BD * CAST(a AS DECIMAL(19, 0)) * CAST(total AS DECIMAL(16, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best")
    scored = cuts.withColumn("score", score).groupBy("ids", "lang", "a", F.col("total").alias("n")).agg(best)
    inner = F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1)))
    covers = candidates.where(size >= 3).select(inner.alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = written(scored.join(covers, "ids", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("ids", "lang", "a", "n", "best.*"), "scored")
    spelled = kept.select("ids", F.posexplode("ids").alias("k", "id")).join(words.select("id", "word"), "id")
    texts = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(texts, "ids").withColumn("mix", F.pmod(F.xxhash64("ids"), F.lit(MIXES)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "mix").orderBy(*order))).where(F.col("rank") <= settings.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= settings.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
