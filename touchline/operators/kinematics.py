"""Balls between detections, and speed and distance by windows of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import geometry as g
from ..schema import BOX, FRAME, TRACK
from . import scans


def interpolate_ball(frames: DataFrame, balls: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """A ball in every frame: straight lines between detections, the first one before them and the last
    one after them; null boxes in a match without any.

    Both neighbours are the last ones seen, once in order of frames and once against it, in a scan by blocks
    (:mod:`.scans`). Frames and balls are dealt together and meet by frame within their block, so
    that the join and the scan take one shuffle. Balls of frames that ``frames`` lacks don't count."""
    spine = frames.select(*FRAME, F.lit(True).alias("asked"), *[F.lit(None).cast("double").alias(c) for c in BOX])
    seen = balls.where("match_id IS NOT NULL").select(*FRAME, F.lit(None).cast("boolean").alias("asked"), *BOX)
    each = scans.dealt(spine.unionByName(seen), params).groupBy(*scans.BLOCK, "frame_num")
    rows = each.agg(F.max("asked").alias("asked"), *[F.max(c).alias(c) for c in BOX]).where("asked")
    ball = F.when(F.col("x1").isNotNull(), F.struct("frame_num", *BOX))
    first, last = scans.first_and_last(ball)
    edges = {"before": F.last("last", True).over(scans.over_blocks()), "after": F.last("first", True).over(scans.over_blocks(backward=True))}
    rows = scans.with_carried(rows, {"first": first, "last": last}, edges)
    past, future = F.last(ball, True).over(scans.within()), F.last(ball, True).over(scans.within(backward=True))
    near = rows.select(*FRAME, F.coalesce(past, "before").alias("p"), F.coalesce(future, "after").alias("n"))
    ratio = (F.col("frame_num") - F.col("p.frame_num")) / F.col("gap")
    near = near.withColumn("gap", F.nullif(F.col("n.frame_num") - F.col("p.frame_num"), F.lit(0)))

    def value(c: str):
        p, n = F.col(f"p.{c}"), F.col(f"n.{c}")
        return F.coalesce(p + (n - p) * ratio, p, n).alias(c)

    return near.select(*FRAME, F.lit("balls").alias("object"), F.lit(1).cast("long").alias("track_id"), *[value(c) for c in BOX])


def frame_counts(frames: DataFrame) -> DataFrame:
    """match_id and n_frames."""
    return frames.groupBy("match_id").agg((F.max("frame_num") + 1).alias("n_frames"))


def window_start(frame_num, params: Params = DEFAULTS):
    return F.floor(frame_num / params.window_frames) * params.window_frames


def windows(tracks: DataFrame, frames: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, object, track_id, start, last, metres and speed_kmh of every window of five frames whose
    ends are both there and on the pitch. The last window of a match is short; one of no length is
    left out. The end of a window is the start of the next.

    Only frames at which a window ends or begins are kept, and a window is valid if the track's next one
    is the window's end. That takes one shuffle by track, which the running sum over windows uses again,
    where a join of starts with ends would take two of each. ``tracks`` has a row per track and frame."""
    moving = tracks.where(~F.col("object").isin(*params.no_speed) & F.col("world_x").isNotNull() & F.col("world_y").isNotNull())
    begins, final = F.col("frame_num") % params.window_frames == 0, F.col("n_frames") - 1
    edges = moving.select(*TRACK, "frame_num", "world_x", "world_y").join(frame_counts(frames), "match_id").where(begins | (F.col("frame_num") == final))
    track = Window.partitionBy(*TRACK).orderBy("frame_num")
    seen = edges.withColumns({"next": F.lead(F.struct("frame_num", "world_x", "world_y")).over(track), "last": F.least(F.col("frame_num") + params.window_frames, final)})
    full = seen.where(begins & (F.col("last") > F.col("frame_num")) & (F.col("next.frame_num") == F.col("last")))
    metres = g.distance(F.col("world_x"), F.col("world_y"), F.col("next.world_x"), F.col("next.world_y"))
    found = full.select(*TRACK, F.col("frame_num").alias("start"), "last", metres.alias("metres"))
    return found.withColumn("speed_kmh", g.kmh(F.col("metres"), F.col("last") - F.col("start"), params.frame_rate))


def cumulative(window_rows: DataFrame) -> DataFrame:
    """``distance_m``: metres of a track up to and with each of its windows."""
    upto = Window.partitionBy(*TRACK).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return window_rows.withColumn("distance_m", F.sum("metres").over(upto))


def total_distance(window_rows: DataFrame) -> DataFrame:
    """match_id, object, track_id and all its metres."""
    return window_rows.groupBy(*TRACK).agg(F.sum("metres").alias("total_m"), F.count("*").alias("n_windows"))


def onto_frames(tracks: DataFrame, window_rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Speed and distance on every frame of a window, its end excluded: an equi-join on the window that
    holds the frame instead of a range join."""
    own = window_rows.select(*TRACK, "start", "last", "speed_kmh", "distance_m")
    keyed = tracks.withColumn("start", window_start(F.col("frame_num"), params))
    both = keyed.join(own, [*TRACK, "start"], "left")
    within = F.col("frame_num") < F.col("last")
    return both.withColumns({c: F.when(within, F.col(c)) for c in ("speed_kmh", "distance_m")}).drop("start", "last")


def speed_distance(tracks: DataFrame, frames: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``tracks`` (with world positions) with ``speed_kmh`` and ``distance_m``, null outside valid windows."""
    return onto_frames(tracks, cumulative(windows(tracks, frames, params)), params)
