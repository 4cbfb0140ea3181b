import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import common, toxicity as t


def all_segments(events, drift, length):
    """Maximal segments by their recursive definition: the best of all, then left and right of it."""
    scores = [-drift] * length
    for i, s in events:
        scores[i] += s

    def split(a, b):
        best, where = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > best + 1e-12:
                    best, where = total, (i, j + 1)
        if where is None:
            return []
        return [*split(a, where[0]), (*where, best), *split(where[1], b)]

    return split(0, length)


@pytest.mark.parametrize("seed", range(60))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    length = rng.randrange(1, 40)
    events = [(i, rng.choice([-3.1, -0.7, 0.05, 0.9, 2.3, 4.7]) + rng.random() / 100) for i in range(length) if rng.random() < 0.5]
    got = t.maximal_segments(events, 0.31)
    want = all_segments(events, 0.31, length)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_long_scan_is_linear():
    events = [(i, 1.0 if i % 3 else -2.5) for i in range(200_000)]
    assert len(t.maximal_segments(events, 0.1)) > 1000


@pytest.fixture(scope="module")
def made(spark):
    """Toxic documents hold three of a few words, close together; others one at most, rarely."""
    rng = random.Random(11)
    plain, bad = [f"w{k}" for k in range(400)], ["grot", "snarl", "blight", "vermin"]
    docs, labels = [], []
    for d in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        toxic = d % 6 == 0
        for _ in range(3 if toxic else rng.random() < 0.05):
            at = min(len(words), 3)
            words.insert(rng.randrange(at + 1), rng.choice(bad))
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(made):
    docs, labels = made
    model = t.fit(docs, labels)
    assert {w.decode() for w, s in model.scores.items() if s > 3} >= {"grot", "snarl", "blight", "vermin"}
    rows = t.score(docs, model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200
    right = sum((r["score"] >= t.THRESHOLD) == bool(r["toxic"]) for r in rows)
    assert right / len(rows) > 0.97
    hit = next(r for r in rows if r["toxic"])
    assert hit["passages"] and all(p["expected"] < 1 and p["start"] < p["end"] for p in hit["passages"])


def test_held_out_labels_are_never_read(made):
    docs, labels = made
    other = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert t.fit(docs, labels).scores == t.fit(docs, other).scores


def test_stage_keeps_what_scores_low(made):
    docs, labels = made
    model = t.fit(docs, labels)
    kept = {r["doc_id"] for r in t.without_toxic(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert kept == {r["doc_id"] for r in t.score(docs, model).where(F.col("score") < t.THRESHOLD).collect()}


def test_no_labels_and_odd_texts(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = t.fit(odd_docs, none)
    rows = t.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] < 0.01 and r["passages"] == [] for r in rows)
    assert t.without_toxic(odd_docs, model).columns == odd_docs.columns
    assert t.score(no_docs, model).collect() == []
    nulls = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    t.fit(odd_docs, nulls)


def test_law_scale_and_score_by_hand(made):
    """Everything after the labels restated in plain Python: counts, log-odds, drift, decay, scale, score."""
    docs, labels = made
    model = t.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where(~common.held_out(F.col("doc_id"))).collect()}
    held = {y: Counter(w for d, own in toxic.items() if own == y for w in text[d].encode().split()) for y in (0, 1)}
    holders = Counter(w for d, own in toxic.items() if own for w in set(text[d].encode().split()))
    n, vocabulary = {y: sum(held[y].values()) for y in (0, 1)}, held[0].keys() | held[1].keys()
    scores = {}
    for w in vocabulary:
        prior = t.PRIOR + t.PRIOR_TOTAL * (held[0][w] + held[1][w]) / (n[0] + n[1])
        odds = [(held[y][w] + prior) / (n[y] + t.PRIOR * len(vocabulary) + t.PRIOR_TOTAL - held[y][w] - prior) for y in (0, 1)]
        delta = math.log(odds[1]) - math.log(odds[0])
        z = delta / math.sqrt(sum(1 / (held[y][w] + prior) for y in (0, 1)))
        if z <= -t.LEAST_Z or (z >= t.LEAST_Z and holders[w] >= t.LEAST_DOCS):
            scores[w] = delta
    assert model.scores == pytest.approx(scores)
    share = {w: (held[0][w] + t.PRIOR) / n[0] for w in scores}
    mean = sum(share[w] * s for w, s in scores.items())
    assert model.drift == pytest.approx(max(t.DRIFT, t.DRIFT + mean), abs=1e-6) and mean < model.drift
    rest = 1 - sum(share.values())
    assert sum(share[w] * math.exp(model.decay * (s - model.drift)) for w, s in scores.items()) + rest * math.exp(-model.decay * model.drift) == pytest.approx(1, abs=1e-6)

    def segments(d):
        words, events = text[d].encode().split(), []
        for i, w in enumerate(words):
            if w in scores:
                k, repeat = i, 0  # how often it was said before, each within the span of the next
                while scores[w] > 0 and (back := [j for j in range(max(0, k - t.REPEAT_SPAN), k) if words[j] == w]):
                    k, repeat = back[-1], repeat + 1
                events.append((i, scores[w] / (1 + repeat)))
        return len(words), all_segments(events, model.drift, len(words))

    law = [n * math.exp(-model.decay * max((x[2] for x in own), default=0.0)) for d, y in toxic.items() if not y for n, own in [segments(d)]]
    assert model.scale == pytest.approx(len(law) / sum(law), rel=1e-6)
    got = {r["doc_id"]: r["score"] for r in t.score(docs, model).collect()}

    def evidence_of(d):
        n_words, own = segments(d)
        return sum(-math.log(x) for x in (model.scale * n_words * math.exp(-model.decay * x[2]) for x in own) if x < 1)

    # The map: where the slope of the log-likelihood (the map's slope held back a little) is zero.
    seen = [(math.log1p(evidence_of(d)), y) for d, y in toxic.items()]
    miss = [(x, y - 1 / (1 + math.exp(-model.offset - model.slope * x))) for x, y in seen]
    assert sum(m for _, m in miss) == pytest.approx(0, abs=1e-3)
    assert sum(x * m for x, m in miss) - model.slope / len(seen) == pytest.approx(0, abs=1e-3)
    for d in range(0, 1200, 37):
        evidence = evidence_of(d)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-model.offset - model.slope * math.log1p(evidence))), abs=1e-9)


def test_a_repeated_label_is_one_document_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(500)] + [(3, "other"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    got = sorted((r["doc_id"], r["toxic"]) for r in t._sample(docs, labels, 10).collect())
    assert got == sorted((d, d == 1) for d in (1, 3, 4) if zlib.crc32(str(d).encode()) % 4 != 2)


def test_passages_are_words_of_the_text():
    model = t.Model({b"bad": 5.0, b"worse": 4.0}, decay=1.0, scale=0.1)
    assert [x[:2] for x in model.passages("so so so bad bad worse so fine fine")] == [(3, 6)]
    assert model.passages(None) == [] and model.evidence("") == 0


THREE = t.Model({b"bad": 5.0, b"worse": 5.0, b"vile": 5.0}, decay=1.0, scale=0.001)


def test_a_passage_that_comes_again_is_found_again():
    text = " ".join(["bad worse vile", *["so"] * 300, "bad worse vile", *["then"] * 200, "vile bad"])
    assert [x[:2] for x in THREE.passages(text)] == [(0, 3), (303, 306), (506, 508)]
    assert [x[2] for x in THREE.passages(text)][:2] == pytest.approx([14.7, 14.7])
    twice = "so bad worse vile so " + " ".join(f"w{k}" for k in range(200))
    assert len(THREE.passages(f"{twice} {twice}")) == 2 * len(THREE.passages(twice)) == 2


def test_scored_words_far_apart_are_no_passage():
    text = " ".join(["bad", *["so"] * 5000, "worse", *["so"] * 5000, "vile"])
    assert all(x[1] - x[0] == 1 for x in THREE.passages(text))


def test_repeats_near_by_count_less():
    assert [s for _, s in THREE.events(b"bad bad so bad".split())] == pytest.approx([5, 5 / 2, 5 / 3])
    assert [s for _, s in THREE.events([b"bad", *[b"so"] * 29, b"bad", *[b"so"] * 30, b"bad"])] == pytest.approx([5, 5 / 2, 5])
    assert [s for _, s in t.Model({b"fine": -1.0}).events([b"fine"] * 3)] == [-1, -1, -1]
