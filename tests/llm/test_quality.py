import math
import re
from collections import Counter

import numpy as np
import pytest

from touchline.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit), failed


def test_base_rules(odd_docs, odd_texts):
    got = [tuple(r)[1:] for r in q.assess(odd_docs).orderBy("doc_id").where("doc_id is not null").collect()]
    want = sorted([(i, *base(t)) for i, t in enumerate(odd_texts)] + [(5, *base(odd_texts[5]))])
    assert [(*r[:5], r[7]) for r in got] == [w[1:] for w in want]
    assert all(not r[8] for r in got if r[7])


def test_verdict_over_documents(spark, documents, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in q.assess(documents).collect()}
    assert {d: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for d, r in got.items()} == {d: base(t) for d, t in texts.items()}
    clean = [got[d]["kept"] for d, y in labels.items() if y == 1 and not got[d]["base_failed"]]
    assert all(clean)


def test_distances_by_hand(documents, texts):
    """One document's distances from references counted in plain Python."""
    rows = documents.collect()
    lang = rows[1]["lang"]
    own = [r["text"] for r in rows if r["lang"] == lang]
    words, classes = Counter(w for t in own for w in t.lower().split()), sum(q.char_classes(t) for t in own)
    total = sum(words.values())
    common = {w: n for w, n in words.items() if n >= total / 1000}
    text = rows[1]["text"]
    mine = Counter(w if w in common else None for w in text.lower().split())
    names = [*common, None]
    p, r = np.array([mine[w] for w in names], float), np.array([*common.values(), total - sum(common.values())], float)

    def js(a, b):
        a, b = a / a.sum(), b / b.sum()
        kl = lambda x, m: sum(v * math.log2(v / w) for v, w in zip(x, m, strict=True) if v)
        m = (a + b) / 2
        return math.sqrt((kl(a, m) + kl(b, m)) / 2)

    got = q.assess(documents).where(f"doc_id = {rows[1]['doc_id']}").first()
    assert got["word_distance"] == pytest.approx(js(p, r), abs=1e-9)
    assert got["char_distance"] == pytest.approx(js(q.char_classes(text).astype(float), classes.astype(float)), abs=1e-9)


def test_all_verdicts_by_hand(spark, documents):
    """Distances and verdicts of all documents, from references counted in plain Python; a language of few
    words has one, too, and what one language holds changes no other's verdicts."""
    few = spark.createDataFrame([(-1, "## ## " * 120, "xx", "src0", 0), (-2, "!!! ??? " * 400, None, "src0", 0)], documents.schema)
    rows = documents.unionByName(few).collect()
    words, classes = {}, {}
    for r in rows:
        lang = r["lang"] or ""
        words.setdefault(lang, Counter()).update(r["text"].lower().split())
        classes.setdefault(lang, Counter()).update(q._class_of(ord(c)) if ord(c) < 1 << 16 else 9 for c in r["text"])

    def js(a, b):
        p, r = {k: v / sum(a.values()) for k, v in a.items()}, {k: v / sum(b.values()) for k, v in b.items()}
        terms = [x * math.log2(x / ((p.get(k, 0) + r.get(k, 0)) / 2)) for side in (p, r) for k, x in side.items() if x]
        return math.sqrt(max(0.0, sum(terms) / 2))

    got = {r["doc_id"]: r for r in q.assess(documents.unionByName(few)).collect()}
    judged = 0
    for r in rows:
        lang, text = r["lang"] or "", r["text"]
        own, total = words[lang], sum(words[lang].values())
        common = {w for w, n in own.items() if 1000 * n >= total}
        merged = lambda c, common=common: sum((Counter({w if w in common else None: n}) for w, n in c.items()), Counter())
        by_char = js(Counter(q._class_of(ord(c)) if ord(c) < 1 << 16 else 9 for c in text), classes[lang]) if len(text) >= 200 else None
        by_word = js(merged(Counter(text.lower().split())), merged(own)) if len(text.split()) >= 50 else None
        x = got[r["doc_id"]]
        assert (x["char_distance"], x["word_distance"]) == (pytest.approx(by_char, abs=1e-9), pytest.approx(by_word, abs=1e-9))
        assert x["kept"] == (not base(text)[5] and (by_char or 0) <= 0.28 and (by_word or 0) <= 0.5)
        judged += by_word is not None
    assert judged > 100 and got[-1]["char_distance"] == 0
    before = {r["doc_id"]: r for r in q.assess(documents).collect()}
    assert all(got[d] == r for d, r in before.items())


def test_classes():
    assert q.char_classes("aB中́3 \n.|\x00\U0001f600").tolist() == [1, 1, 1, 1, 1, 1, 1, 1, 1, 2]


def test_empty(no_docs):
    assert q.assess(no_docs).collect() == []
