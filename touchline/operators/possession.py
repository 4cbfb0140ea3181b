"""Who has the ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import geometry as g
from ..schema import FRAME
from . import scans


def reach(bx: Column, by: Column) -> Column:
    """From the nearer lower corner of a player's box to a point."""
    left = g.distance(F.col("x1"), F.col("y2"), bx, by)
    right = g.distance(F.col("x2"), F.col("y2"), bx, by)
    return F.least(left, right)


def ball_distances(tracks: DataFrame, balls: DataFrame) -> DataFrame:
    """match_id, frame_num, track_id, first_index and d of every player in a frame with a ball."""
    x, y = g.centre()
    centres = balls.where("x1 is not null").select(*FRAME, x.alias("ball_x"), y.alias("ball_y"))
    players = tracks.where(F.col("object") == "players").join(centres, FRAME)
    return players.select(*FRAME, "track_id", "first_index", reach(F.col("ball_x"), F.col("ball_y")).alias("d"))


def nearest_player(distances: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, frame_num, player_id and d: the nearest player within the radius (strictly); ties go to
    the one detected first. Frames without one have no row."""
    near = distances.where(F.col("d") < params.ball_radius)
    best = F.min_by(F.struct("track_id", "d"), F.struct("d", "first_index", "track_id")).alias("b")
    return near.groupBy(*FRAME).agg(best).select(*FRAME, F.col("b.track_id").alias("player_id"), F.col("b.d").alias("d"))


def assign_ball(frames: DataFrame, tracks: DataFrame, balls: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Every frame with its player_id, null if nobody is near."""
    found = nearest_player(ball_distances(tracks, balls), params)
    return frames.select(*FRAME).join(found.select(*FRAME, "player_id"), FRAME, "left")


def flag_holder(tracks: DataFrame, assigned: DataFrame) -> DataFrame:
    """``has_ball`` of every row of ``tracks``: true for the assigned player. ``assigned`` has a row a frame, so the join
    is by frame alone, as tables are dealt."""
    holder = assigned.where("player_id is not null").select(*FRAME, F.col("player_id").alias("holder_id"))
    holds = (F.col("object") == "players") & (F.col("track_id") == F.col("holder_id"))
    return tracks.join(holder, FRAME, "left").withColumn("has_ball", F.coalesce(holds, F.lit(False))).drop("holder_id")


def carried(assigned: DataFrame, player_team: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``team`` of every frame: that of the assigned player, else the team before; null until the first."""
    return _carried(assigned, player_team, params).drop("block")


def _carried(assigned: DataFrame, player_team: DataFrame, params: Params) -> DataFrame:
    teams = player_team.select("match_id", F.col("track_id").alias("player_id"), F.col("team").alias("own"))
    rows = scans.dealt(assigned.join(teams, ["match_id", "player_id"], "left").select(*FRAME, "player_id", "own"), params)
    last = scans.first_and_last(F.col("own"))[1]
    rows = scans.with_carried(rows, {"last": last}, {"before": F.last("last", True).over(scans.over_blocks())})
    return rows.select(*FRAME, "block", "player_id", F.coalesce(F.last("own", True).over(scans.within()), "before").alias("team"))


def running_share(possession: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``share_1, share_2``: shares of the frames with a team, up to each frame; null before the first."""
    return _running_share(scans.dealt(possession, params))


def _running_share(rows: DataFrame) -> DataFrame:
    each = {k: F.sum((F.coalesce("team", F.lit(0)) == k).cast("long")) for k in (1, 2)}
    before = {f"before_{k}": F.sum(f"frames_{k}").over(scans.over_blocks()) for k in (1, 2)}
    rows = scans.with_carried(rows, {f"frames_{k}": n for k, n in each.items()}, before)
    counted = rows.withColumns({f"n_{k}": F.coalesce(f"before_{k}", F.lit(0)) + n.over(scans.within()) for k, n in each.items()})
    shares = {f"share_{k}": F.try_divide(f"n_{k}", F.col("n_1") + F.col("n_2")) for k in (1, 2)}
    return counted.withColumns(shares).drop("block", "before_1", "before_2", "n_1", "n_2")


def timeline(assigned: DataFrame, player_team: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """:func:`carried` and :func:`running_share` at once: frames are dealt to their blocks once."""
    return _running_share(_carried(assigned, player_team, params))


def match_share(possession: DataFrame) -> DataFrame:
    """match_id, frames of each team, and their shares."""
    n = {k: F.count_if(F.col("team") == k).alias(f"frames_{k}") for k in (1, 2)}
    shares = {f"share_{k}": F.try_divide(f"frames_{k}", F.col("frames_1") + F.col("frames_2")) for k in (1, 2)}
    return possession.groupBy("match_id").agg(n[1], n[2]).withColumns(shares)


def possession(frames: DataFrame, tracks: DataFrame, balls: DataFrame, player_team: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, frame_num, player_id, team, share_1, share_2 of every frame."""
    return timeline(assign_ball(frames, tracks, balls, params), player_team, params)
