"""Spelling variants: words one edit apart, and the common form that each rare one belongs to."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

RUN = "[A-Za-zÀ-ÿ]+"  #: what can be a word
LEAST_LENGTH, LEAST_COUNT = 7, 2  #: code points and occurrences of a word
SLIP = 31  #: a run loses a code point where this divides its checksum
RATIO = 10  #: a form occurs so many times as often as its variant


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is. Runs of ASCII alone take the fast way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, ascii_uppercase, ascii_lowercase))


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where its checksum with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of all texts. A null text has none; a null id counts as empty text. Runs are counted in each
    task before they move, so that a word as common as you like is a few rows."""
    runs = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("id", lowered(F.col("run")).alias("run")).select(slipped(F.col("id"), F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def chunk_keys(word: Column, longer: bool) -> Column:
    """Four keys of a word. One edit leaves one of its two halves whole, and in the other half one of two
    quarters: a key is a half and a quarter beside it, with their places and the length.

    A ``longer`` word gives the grams that a word shorter by one would have as chunks: before the edit in
    the same place, after it shifted by one. So equal keys are chunks met within a shift of one."""
    extra = int(longer)
    length = F.length(word) - extra
    keys = []
    for k in range(4):
        begin, end = F.floor(length * k / 4).cast("int"), F.floor(length * (k + 1) / 4).cast("int")
        before, after = F.substring(word, F.lit(1), begin), F.substring(word, end + 1 + extra, F.length(word))
        keys.append(F.xxhash64(length, F.lit(k), before, after))
    return F.array(*keys)


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of every two words of ``words(word, n)`` that differ by exactly one inserted, deleted or
    replaced code point; a pair is one row. Words are distinct.

    Halves alone would pair all words that share one: each of the two quarters of the damaged half goes with
    the whole half into the key. What meets is verified, so that a chance meeting of hashes adds nothing."""
    word = F.col("word")
    chunks = words.select(word.alias("a"), F.col("n").alias("n_a"), F.explode(chunk_keys(word, False)).alias("key"))
    flagged = lambda longer: F.transform(chunk_keys(word, longer), lambda k: F.struct(k.alias("key"), F.lit(longer).alias("longer")))
    either = F.concat(flagged(False), flagged(True))
    grams = words.select(word.alias("b"), F.col("n").alias("n_b"), F.inline(either))
    met = chunks.join(grams, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs(doc_id, text)``.

    ``form`` is the near word of largest n (ties: first in code-point order) if it occurs ten times as often,
    else null; ``root`` is the last of a word's chain of forms. Repeated rows count as often as they occur.
    Chains grow at least tenfold with each step, so that few rounds of doubling end them.
    """
    words = written(count_words(docs), "words")
    pairs = written(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other"))).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    common = F.col("best.m") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(common, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.m")).alias("form_n")
    )
    found = written(found, "forms")
    roots = followed(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(steps: DataFrame) -> DataFrame:
    """word, root for ``steps(word, root)`` without cycles: each root replaced by its own until none has one."""
    steps, moving = written(steps, "roots"), True
    while moving:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moving = not step.where("moved").isEmpty()
        dropped(steps)
        steps = step.drop("moved")
    return steps
