import random
import re

import pytest
from pyspark.sql import functions as F

from touchline.llm import sentence_dedup as s

HAN = re.compile("[一-鿿]|[^\\s一-鿿]+")
SHORT, LONG = 30, 50


def in_repeats(rows, size):
    """By plain comparison of all windows of ``size`` words: the windows (word numbers) of each row that an
    earlier row has had, or the row itself before."""
    seen, out = {}, []
    for k, (_, text) in enumerate(rows):
        words, found = [m[0].lower() for m in HAN.finditer(text or "")], []
        for i in range(len(words) - size + 1):
            if seen.setdefault(tuple(words[i : i + size]), (k, i)) != (k, i):
                found.append(i)
        out.append(found)
    return out


def removed_words(text, spans):
    at = [m.span() for m in HAN.finditer(text or "")]
    return {k for k, (a, b) in enumerate(at) for x in spans if x["start"] <= a and b <= x["end"]}


def check(rows, got):
    """Nothing goes but what lies in a repeat of thirty words; of fifty words repeated, thirty go at least."""
    for (_, text), r, short, long in zip(rows, got, in_repeats(rows, SHORT), in_repeats(rows, LONG), strict=True):
        gone = removed_words(text, r["removed_spans"])
        assert gone <= {i + k for i in short for k in range(SHORT)}
        assert all(len(gone & set(range(i, i + LONG))) >= SHORT for i in long)
        assert (r["n_removed"] > 0) == bool(gone)
        keep, at = [], 0
        for x in r["removed_spans"]:
            keep.append(text[at : x["start"]])
            at = x["end"]
        assert text is None or "".join([*keep, text[at:]]) == r["text"]


def cut(spark, rows):
    got = {r["doc_id"]: r for r in s.cut_sentences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return [got[d] for d, _ in rows]


@pytest.fixture(scope="module")
def passage():
    return " ".join(f"word{k} and word{k + 1}." for k in range(30))


def test_documents_against_all_windows(documents, texts):
    rows = sorted(texts.items())
    got = {r["doc_id"]: r for r in s.cut_sentences(documents).collect()}
    check(rows, [got[d] for d, _ in rows])
    assert any(r["n_removed"] for r in got.values())


@pytest.mark.parametrize("seed", range(4))
def test_passages_that_begin_and_end_anywhere(spark, seed):
    """Passages of 50 to 90 words, with and without marks and line ends, put anywhere into other texts."""
    rng = random.Random(seed)

    def prose(n, stop):
        out = []
        for _ in range(n):
            out.append(f"w{rng.randrange(5000)}" + (rng.choice([". ", "! ", ".\n"]) if stop and rng.random() < 1 / stop else " "))
        return "".join(out)

    rows = []
    for _ in range(12):
        source = prose(300, rng.choice([0, 4, 9, 25])).split(" ")
        a, n = rng.randrange(200), rng.randrange(50, 91)
        part = " ".join(source[a : a + n])
        for _ in range(rng.randrange(2, 5)):
            rows.append((len(rows), prose(rng.randrange(60), 9).strip() + " " + part + " " + prose(rng.randrange(60), 9)))
    rows += [(len(rows) + k, " ".join([w] * n)) for k, (w, n) in enumerate([("same", 400), ("Same", 70), ("other", 49), ("a b", 60), ("b a", 60), ("x y z", 55), ("z x y", 55)])]
    got = cut(spark, rows)
    check(rows, got)
    assert sum(r["n_removed"] > 0 for r in got) > 15


def test_sentences_cover_all_words_and_are_short(odd_texts):
    for text in odd_texts:
        of = s.layout([text, None, text])
        n = len(HAN.findall(text or ""))
        assert [*of.start[1:], 2 * n][: len(of.end)] == of.end.tolist() and (of.start.tolist() or [0])[0] == 0
        assert len(of.end) == 0 or (of.end - of.start).max() <= s.SENTENCE_WORDS
        assert of.first.tolist() == [0, len(of.start) // 2, len(of.start) // 2, len(of.start)]


def test_later_copies_lose_the_passage_and_keep_the_rest(spark, passage):
    one = "Some clean beginning here that is its own. " + passage + "\nAn end of its own."
    two = "Another start. " + passage.upper() + "\nAnother end, quite unlike the first."
    long = " ".join(f"z{k}" for k in range(60))  # sixty words without a mark
    docs = [(1, one), (2, two), (3, f"A b c.\n{long}\nD e f."), (4, f"G h i.\n{long}\nJ k l."), (5, passage + "\n" + passage)]
    got = cut(spark, docs)
    check(docs, got)
    assert got[0]["n_removed"] == 0 and got[0]["text"] == one
    assert got[1]["text"].split() == "Another start. Another end, quite unlike the first.".split()
    assert got[2]["n_removed"] == 0 and got[3]["text"].split() == "G h i. J k l.".split()
    assert got[4]["text"].strip() == ""


def test_odd_texts(odd_docs, odd_texts, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = s.cut_sentences(odd_docs.withColumns({"found": F.lit("clash"), "h1": F.lit("clash"), "first": F.lit(0)})).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None]
    assert [r["n_removed"] for r in got if r["doc_id"] == 5] == [0, 0]  # rows that share an id are one document
    assert [r["n_removed"] > 0 for r in got if r["doc_id"] == 6] == [True]
    assert s.cut_sentences(no_docs).collect() == []


@pytest.mark.parametrize("mark", ["。", "！", "？", "।", "؟", "。」"])
def test_marks_of_other_scripts_end_sentences(mark):
    """Eight sentences of nine characters, each a word, and a mark that ends the sentence."""
    text = "".join(chr(0x4E00 + 97 * k) * 2 + "学习数据集很重" + mark for k in range(8))
    of = s.layout([text])
    assert of.start.tolist() == [10 * k for k in range(8)]
    first, last = s.runs(of)[1:3]
    assert {j for i, k in zip(first, last, strict=True) for j in range(i, k + 1)} == set(range(8))


def test_copies_in_chinese_and_under_null_ids(spark, passage):
    chinese = "".join(f"第{chr(0x4E00 + 97 * k)}句说明数据清洗的一个步骤。" for k in range(8))
    docs = [(1, chinese), (2, chinese), (None, passage), (None, passage), (None, passage), (None, "A start. " + passage), (None, "Quite another text. It has no copy. None at all in any other row here.")]
    got = s.cut_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in got if r["doc_id"]} == {1: False, 2: True} and "".join(r["text"] for r in got if r["doc_id"] == 2).strip() == ""
    left = " ".join(r["text"] for r in got if r["doc_id"] is None)
    assert len(got) == len(docs) and left.count("word3 and word4.") == 1 and left.count("Quite another") == 1
