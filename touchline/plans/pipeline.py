"""The user-level jobs, composed of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..operators import appearance, camera, kinematics, overlay, possession, tracks
from ..sources.folder import dealt_by_frame, partitions, written


def build_tracks(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Detections to tracks."""
    return tracks.build_tracks(detections, params)


def camera_motion(frames: DataFrame, features: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Feature matches to a movement for every frame."""
    return camera.camera_motion(frames, features, params)


def to_pitch(track_rows: DataFrame, camera_rows: DataFrame, params: Params = DEFAULTS, calibrations: DataFrame | None = None) -> DataFrame:
    """Tracks with pixel positions, camera-compensated positions, and positions on the pitch in metres: by the
    parameters' polygon, or each match by its own row of ``calibrations(match_id, src, dst)``."""
    seen = camera.adjusted(tracks.with_position(track_rows, params), camera_rows, params)
    return camera.on_pitch(seen, params) if calibrations is None else camera.on_pitch_by_calibration(seen, calibrations, "match_id")


def interpolate_ball(frames: DataFrame, track_rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Tracks with a ball in every frame; the filled balls have boxes only."""
    balls = track_rows.where(F.col("object") == "balls")
    return tracks.replaced(track_rows, "balls", kinematics.interpolate_ball(frames, balls, params))


def speed_distance(world: DataFrame, frames: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return kinematics.speed_distance(world, frames, params)


def assign_teams(pixels: DataFrame, crops: DataFrame, overrides: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    return appearance.assign_teams(pixels, crops, overrides, params)


def assign_teams_from_frames(pixels: appearance.Pixels, track_rows: DataFrame, overrides: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Frames and tracks to teams: boxes are cut where players are first seen."""
    return appearance.assign_teams_from_frames(pixels, track_rows, overrides, params)


def possession_by_frame(frames: DataFrame, track_rows: DataFrame, player_team: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Player, team and running shares of every frame, from detected tracks."""
    balls = kinematics.interpolate_ball(frames, track_rows.where(F.col("object") == "balls"), params)
    return possession.possession(frames, track_rows, balls, player_team, params)


@dataclass
class Inputs:
    frames: DataFrame
    detections: DataFrame
    features: DataFrame
    player_team: DataFrame | None = None
    pixels: appearance.Pixels | None = None
    crops: DataFrame | None = None  #: if given, pixels are those of crops, else of whole frames (a table, or a source called with frames)
    overrides: DataFrame | None = None
    calibrations: DataFrame | None = None  #: match_id, src, dst


@dataclass
class Results:
    tracks: DataFrame
    camera: DataFrame
    possession: DataFrame
    shares: DataFrame
    shapes: DataFrame
    teams: DataFrame | None = field(default=None)


def analyze_matches(inputs: Inputs, params: Params = DEFAULTS, stage: Callable[[DataFrame, str], DataFrame] = written, deal: Callable[[DataFrame, str], DataFrame] = dealt_by_frame) -> Results:
    """All jobs in order. Balls are filled after the positions are computed, so filled balls have none,
    unless ``reposition_balls`` is set. Teams come from the given table, else from the crops, else from
    the frames' pixels.

    Tables that several jobs read go through ``stage``, which writes them to the shared folder, so that
    they are computed once and lineage stays short. Those that meet by match and frame go through ``deal``, which deals
    them so: what follows joins them without a shuffle. Only speeds, which are by track and window, move rows again.
    """
    if deal is dealt_by_frame:
        deal = partial(dealt_by_frame, n=partitions(inputs.frames, inputs.detections))
    moved = deal(camera_motion(inputs.frames, inputs.features, params), "camera")
    world = deal(to_pitch(build_tracks(inputs.detections, params), moved, params, inputs.calibrations), "world")
    balls = kinematics.interpolate_ball(inputs.frames, world.where(F.col("object") == "balls"), params)
    if params.reposition_balls:
        balls = to_pitch(balls, moved, params, inputs.calibrations)
    balls = deal(balls, "balls")
    world = tracks.replaced(world, "balls", balls)
    teams = None
    player_team = inputs.player_team
    if player_team is None:
        if inputs.crops is not None:
            player_team, teams = assign_teams(inputs.pixels, inputs.crops, inputs.overrides, params)
        else:
            player_team, teams = assign_teams_from_frames(inputs.pixels, world, inputs.overrides, params)
        player_team = stage(player_team, "player-team")
    elif inputs.overrides is not None:
        player_team = appearance.overridden(player_team, inputs.overrides)
    assigned = deal(possession.assign_ball(moved, world, balls, params), "assigned")
    by_frame = stage(possession.timeline(assigned, player_team, params), "possession")
    speeds = kinematics.cumulative(kinematics.windows(world, moved, params))
    none = F.lit(None).cast("array<double>")
    coloured = appearance.with_team_colour(player_team, teams) if teams is not None else player_team.withColumn("team_color", none)
    held = appearance.with_team(possession.flag_holder(world, assigned), coloured)
    rows = stage(kinematics.onto_frames(held, speeds, params), "tracks")
    return Results(rows, moved, by_frame, possession.match_share(by_frame), overlay.display_list(rows, by_frame, moved), teams)


