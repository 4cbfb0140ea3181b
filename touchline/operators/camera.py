"""Camera movement from matched features, and positions without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import geometry as g
from ..schema import FRAME


def in_mask(x: Column, params: Params = DEFAULTS) -> Column:
    """In one of the vertical strips that players don't cross (end excluded)."""
    out = F.lit(False)
    for low, high in params.mask_ranges:
        out = out | ((x >= low) & (x < high))
    return out


def dominant_movement(features: DataFrame) -> DataFrame:
    """match_id, frame_num, dx, dy, d of the feature that moved farthest in each frame: ties go to the
    smaller feature_id, and features that didn't move never win."""
    dx, dy = g.delta(F.col("new_x"), F.col("new_y"), F.col("old_x"), F.col("old_y"))
    moved = features.select(*FRAME, "feature_id", dx.alias("dx"), dy.alias("dy"), g.distance(F.col("new_x"), F.col("new_y"), F.col("old_x"), F.col("old_y")).alias("d")).where("d > 0")
    best = F.max_by(F.struct("dx", "dy", "d"), F.struct("d", (-F.col("feature_id")).alias("first")))
    return moved.groupBy(*FRAME).agg(best.alias("m")).select(*FRAME, "m.dx", "m.dy", "m.d")


def over_threshold(movement: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Movements longer than the threshold (strictly); others are no movement."""
    large = F.col("d") > params.camera_threshold
    return movement.select(*FRAME, *[F.when(large, F.col(c)).otherwise(0.0).alias(c) for c in ("dx", "dy")])


def on_frames(frames: DataFrame, found: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Every frame with its result, or the fill where it has none."""
    return frames.join(found, FRAME, "left").fillna(fill)


def camera_motion(frames: DataFrame, features: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, frame_num, dx, dy of every frame; the first frame has no movement."""
    masked = features.where(in_mask(F.col("old_x"), params) & (F.col("frame_num") > 0))
    return on_frames(frames.select(*FRAME), over_threshold(dominant_movement(masked), params), {"dx": 0.0, "dy": 0.0})


def adjusted(tracks: DataFrame, camera: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``adj_x, adj_y``: the position less its frame's movement (or less all movement up to then). Rows of
    frames without camera movement have none."""
    if params.cumulative_camera:
        upto = Window.partitionBy("match_id").orderBy("frame_num").rowsBetween(Window.unboundedPreceding, 0)
        camera = camera.select(*FRAME, *[F.sum(c).over(upto).alias(c) for c in ("dx", "dy")])
    both = tracks.join(camera.select(*FRAME, "dx", "dy"), FRAME)
    return both.withColumns({"adj_x": F.col("pos_x") - F.col("dx"), "adj_y": F.col("pos_y") - F.col("dy")}).drop("dx", "dy")


def on_pitch(tracks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``world_x, world_y`` in metres, null off the calibrated polygon or without a position."""
    x, y = F.col("adj_x"), F.col("adj_y")
    u, v = g.project(x, y, params.homography)
    known = x.isNotNull() & y.isNotNull() & g.inside_convex(x, y, params.polygon)
    return tracks.withColumns({"world_x": F.when(known, u), "world_y": F.when(known, v)})


def on_pitch_by_calibration(tracks: DataFrame, calibrations: DataFrame, key: str = "calibration_id") -> DataFrame:
    """The same with calibrations that are data: ``tracks`` have the key of their row in ``calibrations(key, src,
    dst)``. Null off the polygon of ``src``, without a calibration, and where one has no solution."""
    both = tracks.join(g.solve_calibrations(calibrations, key), key, "left")
    x, y = F.col("adj_x"), F.col("adj_y")
    u, v = g.project(x, y, [F.element_at("h", k + 1) for k in range(9)])
    known = x.isNotNull() & y.isNotNull() & F.col("h").isNotNull() & g.inside_corners(x, y, F.col("src"))
    return both.withColumns({"world_x": F.when(known, u), "world_y": F.when(known, v)}).drop("h", "src")


def select_corners(corners: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Features to follow among ``corners(match_id, frame_num, x, y, quality)``: within the mask, of at
    least 0.3 of the frame's best quality, best first, none nearer than 3 pixels to a better one, at most
    100 a frame. Ties go to smaller x, then y; corners without a place or quality are none.

    A frame's corners are one sorted array, which a fold goes through with those taken so far: their number is
    bounded, so a frame costs its corners times 100 at most, and no Python runs.
    """
    masked = corners.where(in_mask(F.col("x"), params) & F.col("y").isNotNull() & F.col("quality").isNotNull())
    point = F.struct((-F.col("quality")).alias("order"), "x", "y", "quality")
    found = masked.groupBy(*FRAME).agg(F.max("quality").alias("best"), F.sort_array(F.collect_list(point)).alias("points"))
    good = F.filter("points", lambda p: p["quality"] >= params.corner_quality * F.col("best"))

    def near(p: Column, q: Column) -> Column:
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return dx * dx + dy * dy < params.corner_spacing**2

    def step(taken: Column, p: Column) -> Column:
        free = (F.size(taken) < params.max_corners) & ~F.exists(taken, lambda q: near(p, q))
        return F.when(free, F.concat(taken, F.array(p))).otherwise(taken)

    taken = F.aggregate(good, F.slice("points", 1, 0), step)
    return found.select(*FRAME, F.explode(taken).alias("p")).select(*FRAME, "p.x", "p.y", "p.quality")
