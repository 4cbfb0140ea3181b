import random
import re

import numpy as np
import pytest

from touchline.llm import decontamination as d
from touchline.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, bench):
    words, hit, items = words_of(text), set(), set()
    for item, own in bench:
        w = words_of(own)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for a in range(len(words) - size + 1):
                if words[a : a + size] == w[k : k + size]:
                    items.add(item)
                    hit |= set(range(a, a + size))
    return len(words), len(hit), items


@pytest.mark.parametrize("seed", range(20))
def test_index_finds_all_phrases(seed):
    rng = np.random.default_rng(seed)
    symbols = int(rng.integers(1, 6))
    text = rng.integers(0, symbols + 1, int(rng.integers(1, 300)))
    text[-1] = 0
    order = suffix_array(text)
    ranked = [tuple((v, -1) if v else (0, p) for p, v in enumerate(text[i:], i)) for i in order]
    assert ranked == sorted(ranked)
    index = FMIndex(text, symbols + 1)
    sizes = rng.integers(1, 6, 40)
    phrases = np.zeros((40, 6), np.int64)
    for k, n in enumerate(sizes):
        phrases[k, 6 - n :] = rng.integers(1, symbols + 1, n)
    low, high = index.search(phrases, sizes)
    for k, n in enumerate(sizes):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k, 6 - n :]).all()]
        got = index.locate(np.arange(low[k], high[k])).tolist() if high[k] > low[k] else []
        assert sorted(got) == want


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(2)
    pool = [f"w{k}" for k in range(9)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(n))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 40])]
    rows += [(100, None), (101, ""), (102, "..."), (7, "W1, w2-W3"), (7, "café 中"), (None, "w8 w8 w8 w8")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("block", [3, 10**6])
def test_equals_brute_force(spark, bench, odd_docs, block, monkeypatch):
    monkeypatch.setattr(d, "write_phrases", lambda b, f=d.write_phrases: f(b, block))
    rng = random.Random(4)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(9)] + ["x"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += [f"pre {t} post" for _, t in bench[1] if t] + ["CafÉ café 中"]
    docs = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(odd_docs, allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    got = d.find_passages(docs, bench[0]).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], sorted(map(str, r["items"]))) for r in got) == sorted(
        (x["doc_id"] or -1, n, h, sorted(map(str, i))) for x in rows for n, h, i in [by_hand(x["text"], bench[1])]
    )


def test_spans_cover_the_words_hit(spark, bench):
    docs = spark.createDataFrame([(1, "x; W1, w2-w3! x café  中.")], "doc_id long, text string")
    r = d.find_passages(docs, bench[0].where("item_id = 7")).first()
    assert [r_ for r_ in map(tuple, r["spans"])] == [(3, 12), (16, 23)] and r["n_hit"] == 5


def test_stage_drops_the_contaminated(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {r["doc_id"]: d.contaminated(r["n_words"], r["n_hit"]) for r in d.find_passages(documents, bench).collect()}
    kept = d.without_contaminated(documents, bench)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in found.items() if not v} and any(found.values())


def test_empty_tables(bench, odd_docs, no_docs):
    assert d.find_passages(no_docs, bench[0]).collect() == []
    assert all(r["n_hit"] == 0 for r in d.find_passages(odd_docs, bench[0].limit(0)).collect())


def test_all_words_are_indexed(texts):
    """Every word of a shard lies in a stretch; very long texts get several indexes."""
    words = [d.words_of(t) for t in texts.values()][:120]
    shard = d.Shard(words)
    placed = [(index, place) for index, place in shard.indexes()]
    assert len(placed) == 1 and set(placed[0][1].tolist()) == set(range(sum(map(len, words))))
    assert placed[0][0].n - len(shard.stretches()[0]) >= sum(map(len, words))


def test_long_text_is_indexed_in_parts(monkeypatch):
    monkeypatch.setattr(d, "INDEX_WORDS", 300)
    rng = random.Random(8)
    words = [b"w%d" % rng.randrange(40) for _ in range(2000)]
    phrases = d.Phrases({tuple(words[k : k + 13]): {k} for k in range(0, 1988)} | {(b"w1", b"w2"): {"x"}, (b"none", b"w1"): {"y"}})
    hit, items = d.Shard([[], words, words[5:25]]).search(lambda: [phrases])
    pair = {k for k in range(1999) if words[k : k + 2] == [b"w1", b"w2"]}
    assert hit.all() and items[0] == set() and items[1] == set(range(1988)) | ({"x"} if pair else set())
    assert items[2] - {"x"} == set(range(5, 13))


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "two three"), ("b", "Four!"), (None, "five")], "item_id string, text string")
    assert sorted((r["doc_id"], r["items"]) for r in d.find_passages(docs, bench).collect()) == [(1, ["a"]), (2, ["b"])]


def test_copies_sort_in_few_rounds():
    """Many copies of a long text; positions come back in order of suffixes."""
    text = np.concatenate([np.append(np.arange(1, 400) % 37 + 1, 0)] * 6)
    order = suffix_array(text)
    ranked = [tuple((v, -1) if v else (0, p) for p, v in enumerate(text[i : i + 401], i)) for i in order]
    assert ranked == sorted(ranked)
