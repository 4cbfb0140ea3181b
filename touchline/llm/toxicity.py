"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontamination import words_of

SAMPLE_DOCS = 20_000  #: labelled documents that the model is fitted on, at most; a document is a row
PRIOR = 0.5  #: Dirichlet pseudo-count of every word, besides its share of PRIOR_TOTAL
PRIOR_TOTAL = 500.0
LEAST_Z = 2.5  #: log-odds of words nearer to zero (in standard errors) count as zero
LEAST_DOCS = 4  #: toxic documents that hold a word of positive log-odds
REPEAT_SPAN = 30  #: words within which a repeated word of positive log-odds counts half, a third, ... of its first
DRIFT = 0.1  #: what a token's score falls by at least, on average over harmless text
HELD_WORDS = 300_000  #: words that a task counts before it passes them on
THRESHOLD = 0.3  # of the contract (fixed value)


@dataclass
class Model:
    """Token scores, the extreme-value law of segment scores in harmless text, and the map to a
    probability."""

    scores: dict[bytes, float]
    drift: float = DRIFT
    decay: float = 1.0
    scale: float = 1.0
    offset: float = -10.0
    slope: float = 0.0

    def events(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Place and score of every word of the text that has one. A word said again within REPEAT_SPAN words of
        the last time is less of a surprise: its r-th repeat there counts 1 / (1 + r) of its score."""
        out, last = [], {}
        for i, w in enumerate(words):
            score = self.scores.get(w)
            if score is None:
                continue
            if score > 0:
                place, repeat = last.get(w, (-REPEAT_SPAN - 1, 0))
                repeat = repeat + 1 if i - place <= REPEAT_SPAN else 0
                last[w] = i, repeat
                score /= 1 + repeat
            out.append((i, score))
        return out

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Start, end (in words) and score of each segment of the text that can't be bettered."""
        return maximal_segments(self.events(words), self.drift)

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Start, end (in words of the text, which are contiguous), score and expected number (in harmless text of
        that length) of the segments that are expected less than once by chance."""
        words = words_of(text)
        found = []
        for start, end, score in self.segments(words):
            expected = self.scale * len(words) * math.exp(-self.decay * score)
            if expected < 1:
                found.append((start, end, score, expected))
        return found

    def evidence(self, text: str | None) -> float:
        return sum(-math.log(max(x[3], 1e-300)) for x in self.passages(text))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.offset + self.slope * math.log1p(evidence)))))


def maximal_segments(events: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in time linear in the tokens with a score:
    ``events`` are position and score, every token costs ``drift``.

    A candidate joins the last one whose left sum is lower as long as its own right sum is higher;
    each candidate keeps a link to that one, so sums aren't searched twice.
    """
    start, end, left, right, link = [], [], [], [], []
    total, last = 0.0, -1
    for position, score in events:
        total -= drift * (position - last - 1)
        last, before = position, total
        total += score - drift
        if total <= before:
            continue
        a, low = position, before
        j = len(start) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= total:
                break
            a, low = start[j], left[j]
            for x in (start, end, left, right, link):
                del x[j + 1 :]
            j_next = link[j]
            for x in (start, end, left, right, link):
                del x[j:]
            j = j_next
        start.append(a)
        end.append(position + 1)
        left.append(low)
        right.append(total)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(start, end, left, right, strict=True)]


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """doc_id, text and toxic of up to ``size`` labelled documents outside the held-out fold, by hash of
    the id; a document with several labels is toxic if one says so, and of several rows with one id that
    of the least text hash counts. So rows are bounded, however often an id is repeated."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~common.held_out(F.col("doc_id")))
    each = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))
    return common.written(one.select("doc_id", "text", (F.col("toxic") == 1).alias("toxic")), "sample")


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, its occurrences in toxic and in other documents of the sample, and the toxic documents that hold it."""
    schema = pa.schema([("word", pa.binary()), ("toxic", pa.int64()), ("other", pa.int64()), ("holders", pa.int64())])

    def counted(*counts: Counter) -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([x[w] for w in words], pa.int64()) for x in counts)], schema=schema)
        for x in counts:
            x.clear()
        return out

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other, holders = Counter(), Counter(), Counter()
        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                (toxic if label else other).update(words)
                if label:
                    holders.update(set(words))
                if len(toxic) + len(other) > HELD_WORDS:
                    yield counted(toxic, other, holders)
        yield counted(toxic, other, holders)

    return sample.mapInArrow(task, "word binary, toxic long, other long, holders long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "other", "holders")])


def _lexicon(counts: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Log-odds of the sure words, and their share of harmless tokens, with an informative Dirichlet
    prior (pseudo-counts in proportion to the word's share of the whole sample). Words come to the driver
    that are sure, of the bounded sample's."""
    n = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count("*").alias("words")).first()
    if not n["toxic"] or not n["other"]:
        return {}, {}
    every, prior_sum = n["toxic"] + n["other"], PRIOR * n["words"] + PRIOR_TOTAL
    prior = F.lit(PRIOR) + PRIOR_TOTAL * (F.col("toxic") + F.col("other")) / every

    def log_odds(name: str):
        own = F.col(name) + prior
        return F.log(own / (n[name] + prior_sum - own))

    delta = log_odds("toxic") - log_odds("other")
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    sure = counts.withColumns({"delta": delta, "z": delta / error}).where((F.abs("z") >= LEAST_Z) & ((F.col("z") < 0) | (F.col("holders") >= LEAST_DOCS)))
    rows = sure.orderBy("word").collect()
    return {bytes(r["word"]): r["delta"] for r in rows}, {bytes(r["word"]): (r["other"] + PRIOR) / n["other"] for r in rows}


def _law(scores: dict[bytes, float], share: dict[bytes, float]) -> tuple[float, float]:
    """Drift and decay. The drift makes the mean step over harmless tokens negative, by DRIFT at least. The
    decay is the positive root of sum(p e^(x s)) = 1 over them: chance segments of score s or more thin
    out as e^(-x s)."""
    p = np.array([*share.values(), max(1e-9, 1 - sum(share.values()))])
    steps = np.array([*scores.values(), 0.0])
    drift = max(DRIFT, DRIFT + float(p @ steps) / float(p.sum()))
    steps = steps - drift
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        below = float((p * np.exp(np.minimum(mid * steps, 500))).sum()) < p.sum()
        low, high = (mid, high) if below else (low, mid)
    return drift, low


def _scanned(sample: DataFrame, model: Model) -> DataFrame:
    """toxic, words and segment scores of every document of the (bounded) sample, written: the scan runs once."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            texts = [words_of(text) for text in batch.column("text").to_pylist()]
            found = [[x[2] for x in model.segments(words)] for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(map(len, texts), pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "words", "scores"])

    return common.written(sample.mapInArrow(task, "toxic boolean, words long, scores array<double>"), "scanned")


def _scale(decay: float, scanned: DataFrame) -> float:
    """The most likely scale of the law, of lengths and best scores of harmless documents: one over the mean
    of n e^(-decay best)."""
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    harmless = scanned.where(~F.col("toxic") & (F.col("words") > 0))
    n = harmless.agg(F.count("*").alias("rows"), F.sum(F.col("words") * F.exp(-decay * best)).alias("sum")).first()
    return n["rows"] / max(1e-12, n["sum"]) if n["rows"] else 1.0


def _evidence(model: Model, scanned: DataFrame) -> list[tuple[bool, float]]:
    """toxic and evidence (as in :meth:`Model.evidence`) of every document of the sample."""
    surprise = lambda s: model.decay * s - F.log(model.scale * F.col("words"))
    each = F.transform("scores", lambda s: F.least(F.greatest(surprise(s), F.lit(0.0)), F.lit(-math.log(1e-300))))
    return [(r["toxic"], r["evidence"]) for r in scanned.select("toxic", F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x).alias("evidence")).collect()]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on up to ``sample_docs`` documents of ``labels(doc_id, toxic)`` outside the held-out fold.

    Only ids, labels and texts are read; the score itself is a function of the text alone. With no
    label of either kind every text scores about zero.
    """
    sample = _sample(docs, labels, sample_docs)
    scores, share = _lexicon(common.written(_word_counts(sample), "word-counts"))
    model = Model(scores)
    if not scores:
        return model
    model.drift, model.decay = _law(scores, share)
    scanned = _scanned(sample, model)
    model.scale = _scale(model.decay, scanned)
    seen = _evidence(model, scanned)
    model.offset, model.slope = _logistic([math.log1p(x) for _, x in seen], [toxic for toxic, _ in seen])
    return model


def _logistic(x: list[float], y: list[bool], ridge: float = 1.0) -> tuple[float, float]:
    """Newton's method for two coefficients, the slope held back a little. A step that would not raise the likelihood
    is halved, so that labels that the evidence tells apart wholly don't throw it off."""
    a, t, hold = np.stack([np.ones(len(x)), np.array(x)], axis=1), np.array(y, float), np.array([0, ridge / len(x)])
    gain = lambda w: float((t * (a @ w) - np.logaddexp(0, a @ w)).sum() - 0.5 * (hold * w * w).sum())
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (t - p) - hold * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(hold) + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        while np.abs(step).max() > 1e-9 and gain(w + step) < gain(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and passages (words from start to before end, score, expected number by
    chance) of every row of ``docs(doc_id, text)``.

    Null and empty texts have no passages and the lowest score. Repeated rows get a row each; other
    columns are ignored; an empty table gives an empty table.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            found = [m.passages(x) for x in batch.column("text").to_pylist()]
            scores = [m.probability(sum(-math.log(max(p[3], 1e-300)) for p in x)) for x in found]
            listed = [[dict(zip(("start", "end", "score", "expected"), p, strict=True)) for p in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(listed, passage)], ["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, f"doc_id long, score double, passages {PASSAGES}")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold; all columns, unchanged. A row's fate is
    its text's: repeated rows share it, null and empty texts stay; an empty table stays empty."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            keep = [m.probability(m.evidence(x)) < threshold for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
