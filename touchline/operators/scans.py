"""Scans in order of a match's frames, in two levels: within blocks of frames, and over a match's blocks.

A match may have more frames than a task should hold. So its rows are dealt by blocks of frames, each block is gone
through by itself, and what it hands on is one row: those of a match are few, and are gone through again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..sources.folder import partitions

BLOCK = ["match_id", "block"]


def dealt(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``rows`` with their ``block``, a block in one partition: one shuffle, that all steps of a scan use. Rows without a
    match or a frame number are in no block and are left out, here and not by the joins that follow, so that these
    all read the same rows and Spark reuses the shuffle."""
    blocks = rows.withColumn("block", F.floor(F.col("frame_num") / params.block_frames))
    return blocks.where("match_id IS NOT NULL AND block IS NOT NULL").repartition(partitions(rows), *BLOCK)


def within(backward: bool = False) -> WindowSpec:
    """The rows of a block up to each frame, or from its end back to it."""
    return _upto(BLOCK, "frame_num", 0, backward)


def over_blocks(backward: bool = False) -> WindowSpec:
    """The blocks of a match before each block, or after it."""
    return _upto(["match_id"], "block", -1, backward)


def _upto(key: list[str], order: str, end: int, backward: bool) -> WindowSpec:
    by = F.desc(order) if backward else F.asc(order)
    return Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, end)


def with_carried(rows: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with what comes over the edges of their block: ``summary`` are aggregates of a block, ``carry`` goes over
    the blocks' summaries (see :func:`over_blocks`)."""
    blocks = rows.groupBy(*BLOCK).agg(*[c.alias(name) for name, c in summary.items()])
    return rows.join(blocks.select(*BLOCK, *[c.alias(name) for name, c in carry.items()]), BLOCK, "left")


def first_and_last(value: Column) -> tuple[Column, Column]:
    """Aggregates: the first and the last ``value`` of a block that isn't null."""
    at = F.when(value.isNotNull(), F.col("frame_num"))
    return F.min_by(value, at), F.max_by(value, at)
