"""Spelling variants against a plain restatement."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import spelling


def plain_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            count[low] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(rows):
    words = plain_words(rows)
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out[w] = [forms[w], None, n, len(near), words[best] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found(docs):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(docs).collect()}


def test_equals_brute_force(spark):
    chain = ["abcdefgh"] * 1200 + ["abcdefg"] * 110 + ["abcdegç"] * 4 + ["abcdefgx"] * 2 + ["xabcdefg"] * 2
    more = ["strengths"] * 40 + ["strengthss"] * 3 + ["stengths"] * 4 + ["STRENGTHS"] * 5 + ["aaaaaaaa"] * 30 + ["aaaaaaaaa"] * 3 + ["aaaaaaa"] * 2
    more += ["Élèvement"] * 20 + ["Élèvemant"] * 2 + ["élèvement"] * 3 + ["quarter×"] * 2 + ["quarters"] * 25
    rows = [(k, w) for k, w in enumerate(chain + more)] + [(None, "quarters quarterz quarterz"), (7, None), (8, ""), (9, " -- 12 "), (3, "quarters " * 40)]
    rows += [(1, "quarters"), (1, "quarters")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "a", "b", "form", "root")})
    want = plain(rows)
    assert found(docs) == want
    assert sum(v[0] is not None for v in want.values()) >= 8 and any(v[0] not in (None, v[1]) for v in want.values())


def test_near_words_are_all_found(spark, documents):
    words = [r["word"] for r in spelling.count_words(documents).select("word").distinct().orderBy(F.xxhash64("word")).limit(1200).collect()]
    words += [w[:k] + w[k + 1 :] for w in words[:60] for k in range(len(w))] + [w[:k] + "q" + w[k:] for w in words[60:90] for k in range(len(w) + 1)]
    words = sorted(set(words))
    pairs = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()}
    assert pairs == {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if abs(len(a) - len(b)) < 2 and one_apart(a, b)}
    assert len(pairs) > 500


def test_whole_table_and_odd_documents(spark, documents, odd_docs, no_docs, texts):
    got, want = {r["word"]: r["n"] for r in spelling.count_words(documents).collect()}, plain_words(texts.items())
    assert got == want
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs) == plain(rows)
    assert spelling.group_variants(no_docs).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 5, 6])
def test_chains_are_followed_to_their_end(spark, depth):
    steps = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(depth)], "word string, root string")
    assert {r["root"] for r in spelling.followed(steps).collect()} == {f"w{depth}"}
