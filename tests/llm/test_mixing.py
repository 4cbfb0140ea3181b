import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing as m


def cell_sums(rows, name, weight=lambda r: r["tokens"] * r["weight"]):
    out = defaultdict(float)
    for r in rows:
        out[r[name]] += weight(r)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


@pytest.fixture(scope="module")
def mixed(documents):
    return m.sample_to_targets(documents).collect()


def test_margins_are_met(mixed, texts):
    assert len(mixed) == len(texts)
    assert {r["doc_id"]: r["tokens"] for r in mixed} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    for name in m.DIMENSIONS:
        natural = cell_sums(mixed, name, lambda r: r["tokens"])
        power = {k: v ** m.TEMPER[name] for k, v in natural.items() if v}
        want = {k: v / sum(power.values()) for k, v in power.items()}
        got = cell_sums(mixed, name)
        assert {k: got[k] for k in want} == pytest.approx(want, rel=2e-2)


def test_equals_plain_fitting(spark):
    cells = [(a, b, c, 5 + 7 * k) for k, (a, b, c) in enumerate((a, b, c) for a in "abc" for b in "xy" for c in "pq")]
    total = sum(c[3] for c in cells)
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.4, "q": 0.6}}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {(r["source"], r["lang"], r["topic"]): r["factor"] for r in m.rake(df, targets, tolerance=1e-9).collect()}
    factor = {c[:3]: 1.0 for c in cells}
    for _ in range(300):
        for k, name in enumerate(m.DIMENSIONS):
            mass = defaultdict(float)
            for c in cells:
                mass[c[k]] += c[3] * factor[c[:3]]
            for c in cells:
                factor[c[:3]] *= targets[name][c[k]] * total / mass[c[k]]
    assert got == pytest.approx(factor, rel=1e-6)


def test_value_without_target_gets_nothing(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "en", s) for k, s in enumerate("aaabbbccc")], "doc_id long, text string, lang string, source string")
    rows = m.sample_to_targets(docs, {"source": {"a": 1.0, "b": 1.0}}).collect()
    assert {r["source"]: (r["weight"], r["kept"]) for r in rows if r["source"] == "c"} == {"c": (0.0, False)}
    assert all(r["kept"] for r in rows if r["source"] != "c")


def test_share_and_calibration(documents):
    rows = m.sample_to_targets(documents, share=0.5).collect()
    total = sum(r["tokens"] for r in rows)
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(total / 2, rel=1e-3)
    free = [r for r in rows if r["probability"] < 1 and r["weight"] > 0]
    assert len({round(r["probability"] / r["weight"], 9) for r in free}) == 1
    kept = sum(r["tokens"] for r in rows if r["kept"])
    assert kept == pytest.approx(total / 2, rel=0.3)


@pytest.mark.parametrize("share", [0.02, 0.5, 0.97, 1.0])
def test_share_is_met_however_many_cells_fill_up(spark, share):
    cells = spark.createDataFrame([(10 + k % 3, 1.5**-k) for k in range(60)], "tokens long, factor double")
    p = m._calibrated(cells, share)
    got = cells.agg(F.sum(F.col("tokens") * p).alias("got"), F.sum("tokens").alias("all")).first()
    assert got["got"] == pytest.approx(share * got["all"], rel=1e-9)


def test_share_that_no_scale_meets(spark):
    cells = spark.createDataFrame([(10, 1.0), (10, 0.0)], "tokens long, factor double")
    assert cells.select(m._calibrated(cells, 0.5)).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="share"):
        m._calibrated(cells, 0.6)
    assert cells.limit(0).select(m._calibrated(cells.limit(0), 0.5)).count() == 0


def test_hash_is_uniform(spark):
    u = [r[0] for r in spark.range(20_000).select(m.uniform(F.col("id"), 7)).collect()]
    assert 0 <= min(u) and max(u) < 1
    for k in range(10):
        assert sum(k / 10 <= x < (k + 1) / 10 for x in u) == pytest.approx(2000, rel=0.1)


def test_stage_keeps_the_kept(documents, mixed):
    kept = m.sampled(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in mixed if r["kept"]}


def test_odd_documents(odd_docs, no_docs):
    rows = m.sample_to_targets(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["probability"] <= 1 for r in rows)
    again = [r for r in rows if r["doc_id"] == 5]
    assert len(again) == 2 and all(r["kept"] == (r["probability"] == 1) or r["probability"] < 1 for r in again)
    assert m.sample_to_targets(no_docs).collect() == [] and m.sampled(no_docs).collect() == []
    assert set(m.sampled(odd_docs).columns) == set(odd_docs.columns)


def test_plan_is_native(documents):
    plan = m.sample_to_targets(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_rows_that_share_an_id_have_their_own_fate(spark):
    """A cell that is dropped takes no other cell's rows with it, though ids repeat or are null."""
    rows = [(d, "w " * 10, "en", s) for d in (None, 4) for s in "aabbc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = m.sampled(docs, targets={"source": {"a": 1.0, "b": 1.0}}).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted((r for r in rows if r[3] != "c"), key=repr)


def test_an_odd_document_does_not_shrink_the_sample(spark):
    """One document with a source and language of its own; the kept share stays, and so do the targets."""
    many = [("a", "x", "p", 600_000), ("a", "y", "p", 150_000), ("b", "x", "q", 100_000), ("b", "y", "p", 100_000), ("c", "y", "q", 50_000)]
    share = []
    for cells in (many, [*many, ("odd", "odd", "p", 1)]):
        fitted = m.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), {})
        rows = fitted.withColumn("probability", m._calibrated(fitted, None)).collect()
        kept, mass = sum(r["tokens"] * r["probability"] for r in rows), sum(r["tokens"] * r["factor"] for r in rows)
        scale = max(r["probability"] / r["factor"] for r in rows)
        assert kept == pytest.approx((1 - m.SHORTFALL) * scale * mass, rel=1e-6)
        share.append(kept / sum(r["tokens"] for r in rows))
    assert share[1] == pytest.approx(share[0], rel=0.02)


def test_margins_that_cannot_be_met_are_told(spark):
    """A language that only one source has, and that has no other: two targets, one cell."""
    cells = [("a", "x", "p", 50), ("b", "y", "p", 30), ("b", "z", "p", 20)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.8, "y": 0.1, "z": 0.1}}
    rows = m.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets).collect()
    assert all(r["unmet"] > 0.3 for r in rows)
    met = m.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), {"lang": {"x": 0.5, "y": 0.25, "z": 0.25}, "source": {"a": 0.5, "b": 0.5}}).collect()
    assert all(r["unmet"] < m.TOLERANCE for r in met)


def kind_of(text):
    text = text or ""
    tokens, n = re.findall(r"[^\x20\x09-\x0D]+", text), max(1, len(text))
    if any(len(set(tokens[i : i + 10])) == 1 for i in range(len(tokens) - 9)):
        return "repetition"
    share = lambda marks: sum(map(text.count, marks)) / n
    if share("{}<>[]()=;/\\_|*#$%&@") >= 0.03:
        return "markup"
    if share("0123456789") >= 0.05:
        return "figures"
    if sum(unicodedata.category(c) == "Lu" for c in text) / n >= 0.25:
        return "capitals"
    lines = sum(bool(x.strip(" \t\n\r\v\f")) for x in text.split("\n"))
    if lines >= 5 and len(tokens) <= 6 * lines:
        return "list"
    return "note" if len(tokens) < 50 else "prose"


def test_topics_probabilities_and_kept_by_hand(spark, documents, mixed, odd_texts):
    more = ["a" * 10 + " " + "b " * 9, "b " * 10, "x <y> {z}; " * 9, "12 345 6789", "LOUD TEXT HERE", "one\ntwo\n\nthree\nfour\nfive six", "ÄÖÜ ß", "ab ab ab ab ab ab ab ab ab abc", "w\n" * 9 + "w"]
    kinds = spark.createDataFrame(list(enumerate([*more, *(x for x in odd_texts if x is not None)])), "k long, text string").select("text", m.topic_of(F.col("text"), m.n_tokens(F.col("text"))).alias("topic")).collect()
    assert [r["topic"] for r in kinds] == [kind_of(r["text"]) for r in kinds] and len({r["topic"] for r in kinds}) == 7
    rows = {r["doc_id"]: r for r in documents.withColumn("u", m.uniform(F.col("doc_id"), 7)).collect()}
    assert all(r["topic"] == kind_of(rows[r["doc_id"]]["text"]) for r in mixed)
    total, mass = sum(r["tokens"] for r in mixed), sum(r["tokens"] * r["weight"] for r in mixed)
    assert mass == pytest.approx(total, rel=1e-3)
    free = {r["probability"] / r["weight"] for r in mixed if r["probability"] < 1 and r["weight"]}
    scale = max(free)
    assert min(free) == pytest.approx(scale)
    assert all(r["probability"] == pytest.approx(min(1, scale * r["weight"])) for r in mixed)
    assert sum(r["tokens"] * r["probability"] for r in mixed) == pytest.approx((1 - m.SHORTFALL) * scale * mass, rel=1e-6)
    assert all(r["kept"] == (rows[r["doc_id"]]["u"] < r["probability"]) for r in mixed)
