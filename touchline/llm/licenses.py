"""Licence scan: normalised text against templates by word bigrams; DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES

LEAST_DICE = 0.8
KEY = ["doc_id", "text_hash"]


def normal(text: str) -> list[str]:
    """The words of a template, as :func:`_words` makes them of a column."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def _words(text: Column) -> Column:
    """Lower case; words are rows of a-z and 0-9."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")


def bigrams(words: list[str]) -> set[str]:
    """Pairs of neighbours."""
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bounds(n: int, least: float) -> tuple[int, int]:
    """How many bigrams a run of words has that can reach ``least`` with a template of n: with a and b
    bigrams Dice is 2 min(a, b) / (a + b) at most. It must share as many as the lower bound."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def least_words(template: str, least: float) -> int:
    """How many of the template's words a text holds that can reach ``least``: the most frequent first
    words of its bigrams, as many as it takes to make up the bigrams that must be shared."""
    grams = bigrams(normal(template))
    share, k, made = bounds(len(grams), least)[0], 0, 0
    for _, n in Counter(g.split()[0] for g in grams).most_common():
        if made >= share:
            break
        k, made = k + 1, made + n
    return k


def listed(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """License and text of each template with two words or more; its number is its place."""
    return [(name, text) for name, own in templates.items() for text in own if bigrams(normal(text))]


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _possible(text: Column, texts: list[tuple[str, str]], least: float) -> Column:
    """The numbers of the templates of which a text has enough words."""
    every = F.array(*map(F.lit, sorted({w for _, x in texts for w in normal(x)})))

    def tests(known: Column) -> Column:
        own = [F.array(*map(F.lit, sorted(set(normal(x))))) for _, x in texts]
        enough = [F.size(F.array_intersect(known, words)) >= least_words(x, least) for words, (_, x) in zip(own, texts, strict=True)]
        return F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in enumerate(enough)]))

    fewest = min((least_words(x, least) for _, x in texts), default=1)
    none = F.array().cast("array<int>")
    return _let(F.array_intersect(_words(text), every), lambda known: F.when(F.size(known) >= fewest, tests(known)).otherwise(none))


def _hits(docs: DataFrame, texts: list[tuple[str, str]], least: float) -> DataFrame:
    """doc_id, text_hash, template, place and gram of every bigram of a text that a template has, for the
    templates of which the text has enough words. Rows that repeat a text under one id count once."""
    spark = docs.sparkSession
    grams = spark.createDataFrame([(g, k) for k, (_, x) in enumerate(texts) for g in sorted(bigrams(normal(x)))], "gram string, template int")
    rows = docs.select(*KEY, "text", _possible(F.col("text"), texts, least).alias("possible")).where(F.size("possible") > 0)
    rows = rows.select(*KEY, "possible", _words(F.col("text")).alias("words"))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    each = rows.select(*KEY, "possible", F.posexplode(pairs).alias("place", "gram"))
    return each.join(F.broadcast(grams), "gram").where(F.array_contains("possible", F.col("template"))).select(*KEY, "template", "place", "gram").distinct()


def _best_runs(hits: DataFrame, texts: list[tuple[str, str]], least: float) -> DataFrame:
    """doc_id, text_hash, template and its best run: dice, first and last word.

    A best run begins and ends with bigrams of the template. From each of these on, those within the
    upper bound are gone through in order; one counts if it hasn't occurred since the run's beginning.
    """
    sizes = [len(bigrams(normal(x))) for _, x in texts]
    low, high = zip(*(bounds(n, least) for n in sizes), strict=True)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)
    one = Window.partitionBy(*KEY, "template")
    hits = hits.withColumn("before", F.lag("place").over(Window.partitionBy(*KEY, "template", "gram").orderBy("place")))
    ahead = one.orderBy("place").rangeBetween(0, max(high) - 1)
    runs = hits.withColumn("ahead", F.collect_list(F.struct("place", "before")).over(ahead)).where(F.size("ahead") >= of(low))
    runs = runs.withColumns({"n": of(sizes), "high": of(high)})
    start = F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(-1).alias("last"))

    def step(so_far: Column, x: Column) -> Column:
        fresh = x["before"].isNull() | (x["before"] < F.col("place"))
        shared, length = so_far["shared"] + fresh.cast("int"), x["place"] - F.col("place") + 1
        dice = F.lit(2.0) * shared / (length + F.col("n"))
        better = (length <= F.col("high")) & (dice >= so_far["dice"])
        return F.struct(shared.alias("shared"), F.when(better, dice).otherwise(so_far["dice"]).alias("dice"), F.when(better, x["place"]).otherwise(so_far["last"]).alias("last"))

    found = runs.select(*KEY, "template", "place", F.aggregate("ahead", start, step).alias("run")).where(F.col("run.dice") >= least)
    best = F.max_by(F.struct(F.col("run.dice").alias("dice"), F.col("place").alias("first"), (F.col("run.last") + 1).alias("last")), F.struct("run.dice", -F.col("place")))
    return found.groupBy(*KEY, "template").agg(best.alias("run"))


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, n_matches (licences found), license (that of the best match), dice and matches (license, dice,
    first and last word of the best run of each licence) of every row of ``docs(doc_id, text)``.

    Text is lower-cased and other characters than a-z and 0-9 count as spaces, so line ends don't matter.
    Every run of consecutive words is compared with every template: Dice is twice the template's distinct
    bigrams that the run holds, over the run's bigrams and the template's. Only runs within the size
    bounds of a template can reach ``least``, and only texts with enough of its words; these are the only
    rows that move. Ties go to the licence that is last by name, to the earlier run, then to the longer. Null and empty
    texts and single words match nothing (n_matches 0, license and dice null). Repeated rows get a row
    each; other columns are ignored; an empty table gives an empty table. Words are counted from 0.
    """
    texts = listed(templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    hits = common.written(_hits(rows, texts, least), "licence-words")
    best = _best_runs(hits, texts, least)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in texts]), F.col("template") + 1)
    match = F.struct("run.dice", name.alias("license"), (-F.col("run.first")).alias("negative"), F.col("run.last").alias("last"))
    each = best.groupBy(*KEY, name.alias("license")).agg(F.max(match).alias("m"))
    plain = F.struct("m.dice", "m.license", (-F.col("m.negative")).alias("first"), "m.last")
    found = common.written(each.groupBy(*KEY).agg(F.array_sort(F.collect_list(plain)).alias("matches")), "licences")
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "matches")
    both = rows.select(*KEY).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    top = F.get("matches", F.size("matches") - 1)
    return both.select("doc_id", F.when(F.col("matches").isNull(), 0).otherwise(F.size("matches")).cast("long").alias("n_matches"), top["license"].alias("license"), top["dice"].alias("dice"), "matches")
