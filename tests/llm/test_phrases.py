"""Collocations against a plain restatement."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import phrases


def plain(rows, least, top):
    total, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(re.findall("[^ \t]+", piece))
            total[lang] += len(w)
            own = f.setdefault(lang, Counter())
            own.update(w[i : i + k] for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                inside |= {q for i in range(len(p) - k + 1) if 100 * a >= 100 * own[q := p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(rng, n):
    words = "the of and River STONE élan ÉLAN a-b x's naïve   中文 long".split(" ")
    rows = []
    for k in range(n):
        body = []
        for _ in range(rng.randrange(1, 60)):
            body += ["new york city council met", "as well as"][rng.randrange(2)].split() if rng.random() < 0.1 else [rng.choice(words)]
            body[-1] += rng.choice(["", "", "", "", ".", ", ", "\t", "\n", "\r\n", " ;"])
        rows.append((rng.choice(["en", "en", "de", None, ""]), " ".join(body)))
    return rows


#: Small tables then fill many blocks and groups.
SMALL = phrases.Settings(least=6, budget=40, block=7, words=20, pairs=30)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("settings", [phrases.Settings(least=8), SMALL])
def test_equals_brute_force(spark, settings):
    rows = made(random.Random(1), 400) + [(None, None), ("en", ""), ("fr", " \t\n. ."), ("en", "same again " * 300), ("de", "x" * 5000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("word", "n", "ids", "f", "hash", "id", "group", "pair", "rank")})
    want = plain(rows, settings.least, 2000)
    assert len(want) > 60 and {x[0] for x in want} == {"en", "und", "de", ""} and {len(x[2].split(" ")) for x in want} == {2, 3, 4, 5}
    assert rows_of(phrases.collocations(docs, settings)) == want


def test_groups_hold_no_more_than_the_budget(spark):
    """Nearly: a group may go past it by less than one pair's suffixes; pairs of more are dealt over several."""
    rows = made(random.Random(3), 300)
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, files, salt = phrases.frequent_words(phrases.count_words(docs, SMALL), SMALL)
    texts = phrases.encoded(docs, files, salt)
    pairs, pair_files = phrases.saved_in_blocks(phrases.count_pairs(texts, SMALL).where("n >= 6"), "pair", "pairs", SMALL.block)
    leaves = phrases.suffixes(texts, pair_files, SMALL)
    sizes = leaves.where("whole").groupBy("group").agg(F.sum("n").alias("n")).collect()
    assert len(pair_files) > 3 and len(sizes) > 5 and max(r["n"] for r in sizes) <= 2 * SMALL.budget
    assert leaves.where("not whole").select("pair").distinct().count() < leaves.where("not whole").select("group").distinct().count()


def test_top_of_a_language_and_ties(spark):
    rows = [("en", f"w{k % 40} v{k % 40}. ") for k in range(40 * 120)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(phrases.collocations(docs, phrases.Settings(top=7)))
    assert got == plain(rows, 100, 7) and len(got) == 7


def test_odd_documents_and_no_documents(spark, odd_docs, no_docs):
    many = odd_docs
    for _ in range(5):
        many = many.unionByName(many)
    rows = [(r["lang"], r["text"]) for r in many.collect()]
    assert rows_of(phrases.collocations(many)) == plain(rows, 100, 2000)
    assert phrases.collocations(no_docs).count() == 0
