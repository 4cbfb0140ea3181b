"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = ("source", "lang", "topic")
#: Default target share: in proportion to the token share to this power, by dimension. So large sources and
#: languages give way to small ones.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
TOLERANCE = 1e-4  #: share of the tokens that lie off their marginals, to stop
PROGRESS = 0.99  #: or where a round leaves more of it than this share: the margins can't all be met
SHORTFALL = 0.01  #: share of the target tokens that cells kept whole may lack; it sets the size of a sample without a ``share``

# What a text is made of; the tables name no topics. Shares are of its characters, lines are those with a word.
MARKUP, MARKUP_SHARE = r"[{}<>\[\]()=;/\\_|*#$%&@]", 0.03
DIGIT_SHARE = 0.05
CAPITAL_SHARE = 0.25
NOTE_TOKENS = 50
LIST_LINES, LIST_TOKENS = 5, 6  #: a list has so many lines, of so many tokens on average at most
MONOTONE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1){9}(?![^\x20\x09-\x0D])"  #: ten times the same word


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The kind of a text of so many tokens, by what it is made of: the first that fits of repetition, code and markup, figures,
    capitals, lists, notes (short texts) and prose. Columns are measured, no words looked up, so it is the
    same for any language."""
    length = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / length
    lines = F.regexp_count(text, F.lit(r"[^\n]*[^\x20\x09-\x0D][^\n]*"))
    return (
        F.when(F.regexp_like(text, F.lit(MONOTONE)), "repetition")
        .when(share(MARKUP) >= MARKUP_SHARE, "markup")
        .when(share(r"[0-9]") >= DIGIT_SHARE, "figures")
        .when(share(r"\p{Lu}") >= CAPITAL_SHARE, "capitals")
        .when((lines >= LIST_LINES) & (tokens <= LIST_TOKENS * lines), "list")
        .when(tokens < NOTE_TOKENS, "note")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, dimension: str, shares: Mapping[str, float] | None) -> DataFrame:
    """value and target (a share; they sum to 1 over the values that occur)."""
    by = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if shares is None:
        wanted = by.withColumn("target", F.pow(F.col("tokens").cast("double"), F.lit(TEMPER[dimension])))
    else:
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "value string, target double")
        wanted = by.join(F.broadcast(named), "value", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    total = wanted.agg(F.sum("target").alias("all"))
    return wanted.join(F.broadcast(total), F.col("all") > 0).select("value", (F.col("target") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | None], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``factor``: tokens times factor has the target
    marginals, as nearly as the cells allow; and ``unmet``, the largest relative error that is left in
    the marginals of a cell's values.

    Each step scales the cells of every value of one dimension to that value's target; sums by value
    are combined before they move, so a value with most of the cells is no hot task. The cells are
    written once a round. Rounds end when hardly any token lies off its marginals, or when a round brings
    no progress: where a source has a language to itself, say, and their targets differ, no factors meet
    both, and ``unmet`` says by how much. A value without a target (or with target 0) gets the factor 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {d: common.written(_targets(cells, d, targets.get(d)), f"targets-{d}") for d in DIMENSIONS}

    def change(now: DataFrame, d: str) -> DataFrame:
        margin = now.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("mass"))
        scale = F.coalesce(F.col("target") * total / F.nullif(F.col("mass"), F.lit(0.0)), F.lit(0.0))
        return margin.join(wanted[d], "value", "left").select(F.col("value").alias(d), scale.alias("change"))

    error = F.when(F.col("change") > 0, F.abs(1 / F.col("change") - 1)).otherwise(0.0)  # of the margin before the step
    cells = common.written(cells.select(*DIMENSIONS, "tokens", F.lit(1.0).alias("factor"), F.lit(None).cast("double").alias("unmet")), "cells")
    last, going = math.inf, bool(total)
    while going:
        now = cells.withColumns({"unmet": F.lit(0.0), "off": F.lit(0.0)})
        for d in DIMENSIONS:
            off = F.col("off") + F.col("tokens") * F.col("factor") * F.abs(1 - F.col("change"))
            now = now.join(change(now, d), d).select(*DIMENSIONS, "tokens", (F.col("factor") * F.col("change")).alias("factor"), F.greatest("unmet", error).alias("unmet"), off.alias("off"))
        now = common.written(now, "cells")
        off = now.agg(F.sum("off")).first()[0] / total
        common.dropped(cells)
        cells, going = now, tolerance < off <= PROGRESS * last
        last = off
    return cells.select(*DIMENSIONS, "tokens", "factor", F.coalesce("unmet", F.lit(0.0)).alias("unmet"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 53)) / F.lit(float(1 << 53))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of every document; null names count as an empty name."""
    return _described(docs.select(F.struct("doc_id", "source", "lang", "text").alias("row"))).select("doc_id", *DIMENSIONS, "tokens")


def _described(rows: DataFrame) -> DataFrame:
    """``row``, a document, with what :func:`described` tells of it. Tokens have a projection of their own, for
    they are used more than once and a pass over the text is dear."""
    text = F.coalesce("row.text", F.lit(""))
    counted = rows.select(
        "row",
        "row.doc_id",
        F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("row.lang").cast("string"), F.lit("")).alias("lang"),
        n_tokens(text).alias("tokens"),
    )
    return counted.withColumn("topic", topic_of(text, F.col("tokens")))


def sample_to_targets(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | None] | None = None,
    share: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, unmet, probability and kept of every row of
    ``docs(doc_id, text, lang, source)``.

    ``targets`` gives token shares by dimension (missing: the corpus's own shares to the power that TEMPER has for it).
    ``weight`` is the raked factor of the document's cell, ``unmet`` the error left in its margins (see :func:`rake`). Probabilities are in proportion to it, 1 at
    most. With no ``share`` the sample is the largest of which cells kept whole lack SHORTFALL of the
    tokens, so that a scarce cell counts by its tokens and can't shrink the sample. With one, the
    expected tokens are that share of all, where weights that reach certainty stay there and the
    others make up for it. A document is kept if a hash of its id falls below its probability:
    rows that repeat an id have the same fate if they lie in the same cell.

    Null texts have no tokens. Null names are a value of their own; a null doc_id is hashed like an id.
    Documents in cells without tokens have weight 1. Other columns are ignored; an empty table gives
    an empty table.
    """
    named = common.written(described(docs), "described")
    rows = named.join(*_own_cell(fitted_cells(named, targets, share)))
    probability = F.coalesce("probability", F.lit(1.0))
    return rows.select(
        "doc_id",
        *DIMENSIONS,
        "tokens",
        F.coalesce("factor", F.lit(1.0)).alias("weight"),
        F.coalesce("unmet", F.lit(0.0)).alias("unmet"),
        probability.alias("probability"),
        (uniform(F.col("doc_id"), seed) < probability).alias("kept"),
    )


def fitted_cells(named: DataFrame, targets: Mapping[str, Mapping[str, float] | None] | None, share: float | None) -> DataFrame:
    """Factor and probability of every cell of ``named`` (as of :func:`described`) that has tokens."""
    cells = common.written(named.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = rake(cells.where("tokens > 0"), targets or {})
    return common.written(fitted.withColumn("probability", _calibrated(fitted, share)), "fitted")


def _own_cell(fitted: DataFrame) -> tuple[DataFrame, Column, str]:
    """What joins its cell to a row with the columns DIMENSIONS."""
    keys = [F.col(d) == F.col(f"c_{d}") for d in DIMENSIONS]
    return fitted.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "factor", "unmet", "probability"), keys[0] & keys[1] & keys[2], "left"


def _calibrated(cells: DataFrame, share: float | None) -> Column:
    """The probability of a cell's documents: factor times a scale, 1 at most. The scale is a number found
    by a few sums over the cells."""
    scale = _largest_scale(cells) if share is None else _scale_of_share(cells, share)
    return F.least(F.lit(1.0), F.col("factor") * F.lit(scale))


def _scale_of_share(cells: DataFrame, share: float) -> float:
    """The scale at which the expected tokens are ``share`` of all. An error where the cells that have a
    target hold fewer.

    Expected tokens are a concave function of the scale, made of straight pieces: Newton's steps from
    zero never pass the goal, and meet it after as many pieces as they enter.
    """
    goal = share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    scale = 0.0
    while True:
        whole = F.col("factor") * scale >= 1
        now = cells.agg(F.sum(F.when(whole, F.col("tokens"))).alias("whole"), F.sum(F.when(~whole, F.col("tokens") * F.col("factor"))).alias("rest")).first()
        short = goal - (now["whole"] or 0)
        if not now["rest"]:
            if short > 1e-9 * goal:
                raise ValueError(f"the cells with a target hold less than a share of {share} of the tokens")
            return scale
        if short / now["rest"] <= scale * (1 + 1e-12):
            return scale
        scale = short / now["rest"]


def _largest_scale(cells: DataFrame, shortfall: float = SHORTFALL) -> float:
    """The largest scale at which the expected tokens are 1 - ``shortfall`` of tokens times factor times
    scale, or more.

    Expected tokens are a concave function of the scale, made of straight pieces, and Newton's steps
    from above meet the goal after as many pieces as they pass.
    """
    sums = cells.agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("factor")).alias("mass")).first()
    if not sums["mass"]:
        return 1.0
    goal = (1 - shortfall) * sums["mass"]
    scale = sums["tokens"] / goal
    while True:
        whole = F.col("factor") * scale >= 1
        now = cells.agg(F.sum(F.when(whole, F.col("tokens"))).alias("whole"), F.sum(F.when(~whole, F.col("tokens") * F.col("factor"))).alias("rest")).first()
        if not now["whole"] or goal <= (now["rest"] or 0):
            return scale
        lower = now["whole"] / (goal - (now["rest"] or 0))
        if lower >= scale * (1 - 1e-9):
            return scale
        scale = lower


def sampled(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | None] | None = None,
    share: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` that :func:`sample_to_targets` keeps; all columns, unchanged. Each row has its
    own fate, by its cell and id: rows that repeat an id share it within a cell, null ids are hashed like
    others, texts without tokens stay, and an empty table stays empty. Rows are written once with their cell,
    which costs less than to measure each text again."""
    rows = common.written(_described(docs.select(F.struct("*").alias("row"))), "described")
    fitted = fitted_cells(rows, targets, share)
    return rows.join(*_own_cell(fitted)).where(uniform(F.col("doc_id"), seed) < F.coalesce("probability", F.lit(1.0))).select("row.*")
