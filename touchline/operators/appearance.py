"""Teams from jersey colours: 2-means over the pixels of crops, and over the colours of a match."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..schema import BOX, FRAME
from ..sources.folder import written

CHANNELS = ("b", "g", "r")
CROP = ("match_id", "frame_num", "track_id")  #: what tells the crops of whole frames apart
Pixels = DataFrame | Callable[[DataFrame], DataFrame]  #: of whole frames: a table, or what makes it for given frames


def cut_boxes(pixels: DataFrame) -> DataFrame:
    """The pixels of ``pixels(..., x, y, x1, y1, x2, y2)`` that lie in their row's box, numbered from its
    corner. Boxes are truncated to whole pixels and end before x2, y2; what they have outside the image,
    before its first pixel or after its last, is left out."""
    x1, y1, x2, y2 = (F.greatest(F.col(c).cast("long"), F.lit(0)) for c in ("x1", "y1", "x2", "y2"))
    inside = pixels.where((F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2))
    return inside.withColumns({"x": F.col("x") - x1, "y": F.col("y") - y1}).drop("x1", "y1", "x2", "y2")


def top_half(pixels: DataFrame, key: Sequence[str] = ("crop_id",)) -> DataFrame:
    """The upper half of each crop's rows; an odd row in the middle goes to the lower half."""
    rows = pixels.groupBy(*key).agg((F.max("y") + 1).alias("rows"))
    return pixels.join(rows, [*key]).where(F.col("y") < F.floor(F.col("rows") / 2)).drop("rows")


def first_boxes(tracks: DataFrame) -> DataFrame:
    """match_id, track_id, frame_num and box of each player's first row: the one its team is decided by."""
    players = tracks.where((F.col("object") == "players") & F.col("x1").isNotNull())
    first = F.min_by(F.struct("frame_num", *BOX), "frame_num").alias("f")
    return players.groupBy("match_id", "track_id").agg(first).select("match_id", "track_id", "f.*")


def crops_from_frames(pixels: Pixels, boxes: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, frame_num, track_id, x, y, b, g, r: the upper half of each box of ``boxes(match_id, frame_num,
    track_id, x1, y1, x2, y2)``, cut from frames ``pixels(match_id, frame_num, x, y, b, g, r)``.

    Boxes are as in :func:`cut_boxes`; a frame ends with its last row of pixels, and so does a box that
    reaches below it. Boxes may overlap: a pixel is in as many crops as hold it. A spatial join: each box is
    listed in the cells of a grid that its upper half touches, pixels meet boxes by frame and cell, and a
    test of the box is left for what has met. So no frame's pixels are paired with all of its boxes, and
    one frame's rows go to as many tasks as it has cells. Frames without boxes are left out first: of a match's
    frames, players are first seen in few. ``pixels`` can also be a source, called with the frames that are asked for
    (match_id, frame_num): one that has work to do for each frame then does it for these only. What is left is written
    once, as it is read for heights and for cells; ``boxes`` are read for frames and for boxes, and should be a table.
    """
    size = params.cell
    x1, y1, x2, y2 = (F.greatest(F.col(c).cast("long"), F.lit(0)) for c in BOX)
    frames = boxes.select(*FRAME).distinct()
    pixels = written(pixels(frames) if callable(pixels) else pixels.join(frames, FRAME, "left_semi"), "first-pixels")
    heights = pixels.groupBy(*FRAME).agg((F.max("y") + 1).alias("height"))
    whole = boxes.select(*FRAME, "track_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).join(heights, FRAME)
    half = F.floor((F.least("y2", "height") - F.col("y1")) / 2)
    upper = whole.select(*FRAME, "track_id", "x1", "y1", "x2", (F.col("y1") + half).alias("y2")).where("x2 > x1 AND y2 > y1")
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))
    cells = upper.withColumn("cell_x", F.explode(span("x1", "x2"))).withColumn("cell_y", F.explode(span("y1", "y2")))
    placed = pixels.select(*FRAME, "x", "y", *CHANNELS, F.floor(F.col("x") / size).alias("cell_x"), F.floor(F.col("y") / size).alias("cell_y"))
    met = placed.join(cells, [*FRAME, "cell_x", "cell_y"])
    inside = met.where("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    return inside.select(*CROP, (F.col("x") - F.col("x1")).alias("x"), (F.col("y") - F.col("y1")).alias("y"), *CHANNELS)


def squared(a: str, b: str) -> Column:
    """Squared distance of two colours, by the prefixes of their columns."""
    parts = [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in CHANNELS]
    return parts[0] + parts[1] + parts[2]


def nearest(point: str = "", first: str = "c0_", second: str = "c1_") -> Column:
    """0 if the first centre is as near as the second, else 1."""
    return F.when(squared(point, first) <= squared(point, second), 0).otherwise(1)


#: The draws of the ten starts: for the first centre, one from each tenth of the pixels; for the second, from fractions
#: of the golden ratio, which spread evenly however they pair with the first.
DRAWS = tuple(((k + 0.5) / 10, (k + 1) * 0.6180339887498949 % 1) for k in range(10))
EXTREMES = ("b + g + r", "b", "g", "r")  #: four more starts: the least and the greatest colour by each


def _apart(a: Column, b: Column) -> Column:
    parts = [(a[c] - b[c]) * (a[c] - b[c]) for c in CHANNELS]
    return parts[0] + parts[1] + parts[2]


def _first_past(weight: Callable[[Column], Column], limit: Column) -> Column:
    """The first of the colours ``p`` with which the sum of weights passes the limit; null if none does."""
    none = F.lit(None).cast("struct<b:double,g:double,r:double>")
    start = F.struct(F.lit(0.0).alias("sum"), none.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + weight(x)
        return F.struct(total.alias("sum"), F.coalesce(acc["hit"], F.when(total > limit, F.struct(*[x[c].alias(c) for c in CHANNELS]))).alias("hit"))

    return F.aggregate("p", start, step, lambda acc: acc["hit"])


def _keyed(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: F.struct(reduce(add, [x[c] for c in names]).alias("key"), F.struct(*[x[c].alias(c) for c in CHANNELS]).alias("c"))


def _seeded() -> Column:
    """Ten pairs of centres by squared-distance draws, and the four of extremes, for the colours ``p`` of a row. Each
    step is a transform of the one before, so that what a start has is worked out once."""
    draws = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in DRAWS])
    first = F.transform(draws, lambda d: F.struct(_first_past(lambda x: x["n"], d["u"] * F.col("total")).alias("c0"), d["v"].alias("v")))
    limited = F.transform(first, lambda d: F.struct(d["c0"].alias("c0"), (d["v"] * F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["n"] * _apart(x, d["c0"]))).alias("limit")))
    seeded = F.transform(limited, lambda d: F.struct(d["c0"].alias("c0"), F.coalesce(_first_past(lambda x: x["n"] * _apart(x, d["c0"]), d["limit"]), d["c0"]).alias("c1")))
    ends = []
    for order in EXTREMES:
        keyed = F.transform("p", _keyed(order.split(" + ")))
        ends.append(F.struct(F.array_min(keyed)["c"].alias("c0"), F.array_max(keyed)["c"].alias("c1")))
    return F.concat(seeded, F.array(*ends))


def two_means(points: DataFrame, *group: str, rounds: int = DEFAULTS.kmeans_rounds) -> DataFrame:
    """The group's columns and the centres c0_b ... c1_r of each group of ``points(group, b, g, r)``.

    Lloyd's rounds until nothing moves, from ten starts drawn in proportion to squared distance (fixed draws, so
    that a group always gets the same) and four of extremes; the start with the least sum of squares counts (to
    1e-6; the first of equals), and centre 0 is the darker one. Ties of a point go to centre 0; an empty
    cluster keeps its centre. Still moving after ``rounds`` is an error. The centres are written once.

    Points are counted by colour before they move. A group is then one row with an array of its colours, as
    many as a crop has at most, and all rounds of all starts are one projection: nothing is shuffled or
    written between them. Groups are dealt to as many tasks as a shuffle has partitions, whatever their bytes: a group is
    little to read and much to work out.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    colour = [F.col(c).cast("double").alias(c) for c in CHANNELS]
    counted = points.select(*group, *colour).groupBy(*group, *CHANNELS).agg(F.count("*").cast("double").alias("n"))
    listed = counted.repartition(tasks, *group).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*CHANNELS, "n"))).alias("p"), F.sum("n").alias("total"))
    zero = F.struct(*[F.lit(0.0).alias(f"s{k}{c}") for k in (0, 1) for c in (*CHANNELS, "n")])

    def lloyd(at: Column) -> Column:
        def add_point(t: Column, x: Column) -> Column:
            own = F.when(_apart(x, at["c0"]) <= _apart(x, at["c1"]), 0).otherwise(1)
            part = lambda k, c: F.when(own == k, x["n"] if c == "n" else x["n"] * x[c]).otherwise(0.0)
            return F.struct(*[(t[f"s{k}{c}"] + part(k, c)).alias(f"s{k}{c}") for k in (0, 1) for c in (*CHANNELS, "n")])

        def centres(t: Column) -> Column:
            mean = lambda k, c: F.coalesce(F.try_divide(t[f"s{k}{c}"], t[f"s{k}n"]), at[f"c{k}"][c])
            new = [F.struct(*[mean(k, c).alias(c) for c in CHANNELS]) for k in (0, 1)]
            return F.struct(new[0].alias("c0"), new[1].alias("c1"), ((new[0] != at["c0"]) | (new[1] != at["c1"])).alias("moved"))

        return F.when(at["moved"], F.aggregate("p", zero, add_point, centres)).otherwise(at)

    def settle(start: Column) -> Column:
        at = F.struct(start["c0"].alias("c0"), start["c1"].alias("c1"), F.lit(True).alias("moved"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at, lambda acc, _: lloyd(acc))

    def priced(s: Column, k: Column) -> Column:
        cost = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["n"] * F.least(_apart(x, s["c0"]), _apart(x, s["c1"])))
        spot = lambda c: F.struct((c["b"] + c["g"] + c["r"]).alias("sum"), *[c[x].alias(x) for x in CHANNELS])
        return F.struct(F.round(cost, 6).alias("cost"), k.alias("k"), F.least(spot(s["c0"]), spot(s["c1"])).alias("c0"), F.greatest(spot(s["c0"]), spot(s["c1"])).alias("c1"), s["moved"].alias("moved"))

    settled = listed.withColumn("found", F.transform(F.transform(_seeded(), settle), priced))
    best = settled.select(*group, F.array_min("found").alias("best"), F.exists("found", lambda s: s["moved"]).alias("late"))
    best = written(best, "centres")
    if not best.where("late").isEmpty():
        raise RuntimeError("2-means still moves after its last round")
    return best.select(*group, *[F.col(f"best.c{k}.{c}").alias(f"c{k}_{c}") for k in (0, 1) for c in CHANNELS])


def corner_vote(pixels: DataFrame, centres: DataFrame, key: Sequence[str] = ("crop_id",)) -> DataFrame:
    """The crop's key and ``player_cluster``: the one that isn't the majority of the crop's four corners (a corner
    pixel of a one-wide crop votes twice; two against two is cluster 0)."""
    size = pixels.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    spots = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("low_x", "high_x") for y in ("low_y", "high_y")])
    corners = size.select(*key, F.explode(spots).alias("at")).select(*key, "at.x", "at.y")
    votes = corners.join(pixels, [*key, "x", "y"]).join(centres, [*key]).groupBy(*key).agg(F.sum(nearest()).alias("ones"))
    return votes.select(*key, F.when(F.col("ones") >= 3, 0).otherwise(1).alias("player_cluster"))


def colours_of(top: DataFrame, key: Sequence[str] = ("crop_id",), params: Params = DEFAULTS) -> DataFrame:
    """The crop's key, b, g, r: the centre of the player's cluster among the crop's pixels, which are its upper
    half. A crop without pixels has no row."""
    top = written(top, "top")
    centres = two_means(top, *key, rounds=params.kmeans_rounds)
    picked = centres.join(corner_vote(top, centres, key), [*key])
    return picked.select(*key, *[F.when(F.col("player_cluster") == 0, F.col(f"c0_{c}")).otherwise(F.col(f"c1_{c}")).alias(c) for c in CHANNELS])


def jersey_colours(pixels: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """crop_id, b, g, r of ready crops."""
    return colours_of(top_half(pixels), params=params)


def team_colours(colours: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, team (1 or 2), b, g, r: 2-means of each match's jersey colours ``(match_id, b, g, r)``; team
    1 is the smaller centre by b, g, r."""
    centres = two_means(colours, "match_id", rounds=params.kmeans_rounds)
    both = F.array_sort(F.array(*[F.struct(*[F.col(f"c{k}_{c}").alias(c) for c in CHANNELS]) for k in (0, 1)]))
    return centres.select("match_id", F.posexplode(both).alias("k", "c")).select("match_id", (F.col("k") + 1).alias("team"), *[F.col(f"c.{c}").alias(c) for c in CHANNELS])


def first_seen(colours: DataFrame) -> DataFrame:
    """match_id, track_id and the colour of its earliest frame: what is decided once for a player."""
    value = F.min_by(F.struct(*CHANNELS), "frame_num").alias("c")
    return colours.groupBy("match_id", "track_id").agg(value).select("match_id", "track_id", *[F.col(f"c.{c}").alias(c) for c in CHANNELS])


def predicted_team(colours: DataFrame, teams: DataFrame) -> DataFrame:
    """match_id, track_id and the team of the nearer centre; ties go to team 1."""
    wide = teams.groupBy("match_id").agg(*[F.max(F.when(F.col("team") == k, F.col(c))).alias(f"c{k - 1}_{c}") for k in (1, 2) for c in CHANNELS])
    return colours.join(wide, "match_id").select("match_id", "track_id", (nearest() + 1).alias("team"))


def overridden(player_team: DataFrame, overrides: DataFrame) -> DataFrame:
    """Teams given by hand in ``overrides(match_id, track_id, team)`` come before the others."""
    by_hand = overrides.select("match_id", "track_id", F.col("team").alias("given"))
    return player_team.join(by_hand, ["match_id", "track_id"], "left").select("match_id", "track_id", F.coalesce("given", "team").alias("team"))


def with_team(tracks: DataFrame, player_team: DataFrame) -> DataFrame:
    """``team`` on every player's row; null for other objects and unknown players. ``team_color`` comes with it where
    ``player_team`` has it (see :func:`with_team_colour`): colours meet players, who are few, and not rows."""
    own = ["team", "team_color"] if "team_color" in player_team.columns else ["team"]
    teams = player_team.select("match_id", F.lit("players").alias("object"), "track_id", *own)
    return tracks.join(teams, ["match_id", "object", "track_id"], "left")


def with_team_colour(tracks: DataFrame, teams: DataFrame) -> DataFrame:
    """``team_color`` (array b, g, r) of the row's team."""
    colours = teams.select("match_id", "team", F.array(*CHANNELS).alias("team_color"))
    return tracks.join(colours, ["match_id", "team"], "left")


def assign_teams(pixels: DataFrame, crops: DataFrame, overrides: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """``player_team(match_id, track_id, team)`` and ``team_colours``: colours of the first frame's crops give
    the two teams, and each player's earliest crop its team."""
    return _by_colours(jersey_colours(pixels, params).join(crops, "crop_id"), overrides, params)


def assign_teams_from_frames(pixels: Pixels, tracks: DataFrame, overrides: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The same from whole frames ``pixels(match_id, frame_num, x, y, b, g, r)`` (a table, or a source as in
    :func:`crops_from_frames`) and tracks: each player's box is
    cut from the frame in which it is first seen. A box without pixels gives its player no team."""
    boxes = written(first_boxes(tracks), "boxes")
    return _by_colours(colours_of(crops_from_frames(pixels, boxes, params), CROP, params), overrides, params)


def _by_colours(colours: DataFrame, overrides: DataFrame | None, params: Params) -> tuple[DataFrame, DataFrame]:
    colours = written(colours, "colours")
    teams = written(team_colours(colours.where("frame_num = 0"), params), "teams")
    player_team = predicted_team(first_seen(colours), teams)
    return (overridden(player_team, overrides) if overrides is not None else player_team), teams
