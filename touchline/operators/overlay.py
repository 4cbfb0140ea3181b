"""What to draw where: a table of shapes and captions for a renderer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import FRAME

# Colours are b, g, r (fixed values).
PLAYER, REFEREE, BALL, HOLDER = (0, 0, 255), (0, 255, 255), (0, 255, 0), (0, 255, 255)


def _colour(bgr: tuple[int, int, int]) -> Column:
    return F.array(*[F.lit(float(x)) for x in bgr])


def row_colour() -> Column:
    """The team's colour of a player, or the object's own."""
    return F.when(F.col("object") == "players", F.coalesce("team_color", _colour(PLAYER))).when(F.col("object") == "referees", _colour(REFEREE)).otherwise(_colour(BALL))


def _integer(x) -> Column:
    return g.whole(F.col(x) if isinstance(x, str) else x)


def ellipses(tracks: DataFrame) -> DataFrame:
    """Players and referees: centre, axes, and an arc from -45 to 225 degrees."""
    rows = tracks.where(F.col("object").isin("players", "referees"))
    x, _ = g.centre()
    wide = g.width()
    return rows.select(
        *FRAME,
        "object",
        "track_id",
        x.alias("cx"),
        _integer("y2").alias("cy"),
        g.whole(wide).alias("axis_x"),
        g.whole(wide * 0.35).alias("axis_y"),
        F.lit(-45).cast("long").alias("start_angle"),
        F.lit(225).cast("long").alias("end_angle"),
        row_colour().alias("color"),
    )


def badges(tracks: DataFrame) -> DataFrame:
    """Players: a box of 40 by 20 below the feet with the track's number; long numbers begin further left."""
    rows = tracks.where(F.col("object") == "players")
    x, _ = g.centre()
    y = _integer("y2")
    return rows.select(
        *FRAME,
        "track_id",
        (x - 20).alias("left"),
        (y - 10 + 15).alias("top"),
        (x + 20).alias("right"),
        (y + 10 + 15).alias("bottom"),
        (x - 20 + 12 - F.when(F.col("track_id") > 99, 10).otherwise(0)).alias("text_x"),
        (y - 10 + 15 + 15).alias("text_y"),
        F.col("track_id").cast("string").alias("text"),
        row_colour().alias("color"),
    )


def triangles(tracks: DataFrame) -> DataFrame:
    """Above balls and the player that has the ball: tip and two upper corners."""
    holder = (F.col("object") == "players") & F.col("has_ball")
    rows = tracks.where(((F.col("object") == "balls") | holder) & F.col("x1").isNotNull())
    x, _ = g.centre()
    y = _integer("y1")
    return rows.select(
        *FRAME,
        "object",
        "track_id",
        x.alias("tip_x"),
        y.alias("tip_y"),
        (x - 10).alias("left_x"),
        (x + 10).alias("right_x"),
        (y - 20).alias("top_y"),
        F.when(F.col("object") == "balls", _colour(BALL)).otherwise(_colour(HOLDER)).alias("color"),
    )


def possession_captions(possession: DataFrame) -> DataFrame:
    """Two captions a frame; none before the first possession. ``value`` is what the text rounds."""
    rows = possession.where("share_1 is not null")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("team"), F.lit(1400).alias("x"), F.lit(y).alias("y"), (F.col(f"share_{k}") * 100).alias("value")) for k, y in ((1, 900), (2, 950))]))
    return rows.select(*FRAME, each.alias("c")).select(
        *FRAME, "c.team", F.col("c.x").cast("long").alias("x"), F.col("c.y").cast("long").alias("y"), "c.value", F.format_string("Team %d Ball Control: %.2f%%", "c.team", "c.value").alias("text")
    )


def speed_labels(tracks: DataFrame) -> DataFrame:
    """Players with speed and distance: both below the feet."""
    rows = tracks.where((F.col("object") == "players") & F.col("speed_kmh").isNotNull() & F.col("distance_m").isNotNull())
    x, y = g.foot()
    each = F.array(
        F.struct(F.lit("speed").alias("kind"), x.alias("x"), (y + 40).alias("y"), F.col("speed_kmh").alias("value"), F.format_string("%.2f km/h", "speed_kmh").alias("text")),
        F.struct(F.lit("distance").alias("kind"), x.alias("x"), (y + 60).alias("y"), F.col("distance_m").alias("value"), F.format_string("%.2f m", "distance_m").alias("text")),
    )
    return rows.select(*FRAME, "track_id", F.explode(each).alias("l")).select(*FRAME, "track_id", "l.*")


def camera_captions(camera: DataFrame) -> DataFrame:
    text = F.format_string("Camera Movement: (%.2f, %.2f)", "dx", "dy")
    return camera.select(*FRAME, F.lit(10).cast("long").alias("x"), F.lit(30).cast("long").alias("y"), "dx", "dy", text.alias("text"))


def _shape(z: int, shape: str, x: Column, y: Column, text: Column | None = None, color: Column | None = None, track: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(z).cast("long").alias("z"),
        F.lit(shape).alias("shape"),
        (none if track is None else track).cast("long").alias("track_id"),
        x.cast("long").alias("x"),
        y.cast("long").alias("y"),
        (none if text is None else text).cast("string").alias("text"),
        (none if color is None else color).cast("array<double>").alias("color"),
    )


def display_list(tracks: DataFrame, possession: DataFrame, camera: DataFrame) -> DataFrame:
    """match_id, frame_num, z, shape, track_id, x, y, text, color of everything, to be drawn in order of z.

    ``x, y`` is the shape's anchor: an ellipse's centre, a badge's or caption's text, a triangle's tip.
    Each table is read once: a row makes all its shapes, of which those that apply are kept."""
    player, ball, track = F.col("object") == "players", F.col("object") == "balls", F.col("track_id")
    (middle, _), (x, y), own = g.centre(), g.foot(), row_colour()
    labelled = player & F.col("speed_kmh").isNotNull() & F.col("distance_m").isNotNull()
    tip = F.when(ball, _colour(BALL)).otherwise(_colour(HOLDER))
    of_track = [
        F.when(F.col("object").isin("players", "referees"), _shape(1, "ellipse", middle, _integer("y2"), color=own, track=track)),
        F.when(player, _shape(2, "badge", middle - 20 + 12 - F.when(track > 99, 10).otherwise(0), _integer("y2") + 20, track.cast("string"), own, track)),
        F.when((ball | (player & F.col("has_ball"))) & F.col("x1").isNotNull(), _shape(3, "triangle", middle, _integer("y1"), color=tip, track=track)),
        F.when(labelled, _shape(6, "speed", x, y + 40, F.format_string("%.2f km/h", "speed_kmh"), track=track)),
        F.when(labelled, _shape(6, "speed", x, y + 60, F.format_string("%.2f m", "distance_m"), track=track)),
    ]
    rows = tracks.select(*FRAME, F.inline(F.array_compact(F.array(*of_track))))
    captions = possession_captions(possession).select(*FRAME, _shape(4, "possession", F.col("x"), F.col("y"), F.col("text")).alias("s")).select(*FRAME, "s.*")
    moves = camera_captions(camera).select(*FRAME, _shape(5, "camera", F.col("x"), F.col("y"), F.col("text")).alias("s")).select(*FRAME, "s.*")
    return rows.unionByName(captions).unionByName(moves)


def in_drawing_order(shapes: DataFrame) -> DataFrame:
    """Sorted for a sink that reads frame by frame; the only global sort, and the last step."""
    return shapes.orderBy(*FRAME, "z", "track_id", "x", "y", "text")
