"""Teams from frames, and maps and polygons that are data, against plain restatements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import Params
from touchline.functions import geometry as g
from touchline.operators import appearance, camera
from touchline.sources.fixtures import Fixtures


@pytest.mark.parametrize("cell", [1, 7, 64])
def test_crops_of_overlapping_boxes(spark, cell):
    """Many boxes a frame, over each other, before the first pixel and past the last one."""
    rng = random.Random(cell)
    pixels = [(m, f, x, y, x, y, m) for m in (1, 2) for f in (0, 3) for x in range(30) for y in range(20 + m) if rng.random() < 0.9]
    boxes = [(m, f, t, x := rng.uniform(-6, 28), y := rng.uniform(-6, 19), x + rng.uniform(0, 14), y + rng.uniform(0, 16)) for m in (1, 2) for f in (0, 3) for t in range(12)]
    want = set()
    for m, f, t, *box in boxes:
        x1, y1, x2, y2 = (max(int(v), 0) for v in box)
        half = y1 + (min(y2, max(p[3] for p in pixels if p[:2] == (m, f)) + 1) - y1) // 2
        want |= {(m, f, t, p[2] - x1, p[3] - y1, *p[4:]) for p in pixels if p[:2] == (m, f) and x1 <= p[2] < x2 and y1 <= p[3] < half}
    got = appearance.crops_from_frames(
        spark.createDataFrame(pixels, "match_id long, frame_num long, x long, y long, b long, g long, r long").withColumn("cell_x", F.lit("clash")),
        spark.createDataFrame(boxes, "match_id long, frame_num long, track_id long, x1 double, y1 double, x2 double, y2 double"),
        Params(cell=cell),
    ).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    per_pixel = {}
    for m, f, _, _, _, x, y, _ in want:
        per_pixel[m, f, x, y] = per_pixel.get((m, f, x, y), 0) + 1
    assert max(per_pixel.values()) > 2


def test_frames_are_not_paired_with_all_their_boxes(spark):
    """The join has the grid's cell among its keys."""
    pixels = spark.range(100).selectExpr("0L AS match_id", "0L AS frame_num", "id AS x", "id AS y", "id AS b", "id AS g", "id AS r")
    boxes = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 50.0, 80.0)], "match_id long, frame_num long, track_id long, x1 double, y1 double, x2 double, y2 double")
    found = appearance.crops_from_frames(pixels, boxes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" in plan and "cell_y" in plan and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40


def test_a_source_of_pixels_is_asked_for_first_frames_only(spark):
    """Crops are those of the whole table, and the source makes pixels of no other frame than one with a box."""
    pixels = spark.range(4000).selectExpr("id % 2 AS match_id", "id DIV 2 % 20 AS frame_num", "id DIV 40 % 10 AS x", "id DIV 400 AS y", "id AS b", "id AS g", "id AS r")
    boxes = spark.createDataFrame([(0, 3, 1, 0.0, 0.0, 5.0, 8.0), (0, 3, 2, 2.0, 1.0, 9.0, 9.0), (1, 7, 1, 1.0, 0.0, 4.0, 5.0)], "match_id long, frame_num long, track_id long, x1 double, y1 double, x2 double, y2 double")
    asked = []

    def source(frames):
        asked.extend(tuple(r) for r in frames.collect())
        return pixels.join(frames, ["match_id", "frame_num"], "left_semi")

    as_rows = lambda df: sorted(map(tuple, df.collect()))
    found = appearance.crops_from_frames(source, boxes)
    assert sorted(asked) == [(0, 3), (1, 7)]
    assert as_rows(found) == as_rows(appearance.crops_from_frames(pixels, boxes)) and found.count() == 20 + 28 + 6


def test_fixture_pixels_of_frames_are_made_after_the_choice(spark):
    """The choice of frames is below the making of pixels, also without broadcasts, and leaves the same pixels."""
    f = Fixtures(spark, "/root/testdata/sf0.001")
    frames = f.frames.where("frame_num % 50 = 3")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = f.pixels_of(frames)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert depth("Aggregate") < depth("Generate") < depth("LeftSemi")
    whole = f.frame_pixels.where("frame_num % 50 = 3")
    assert found.count() > 100 and found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()


def test_groups_are_dealt_over_tasks_whatever_their_bytes(spark):
    points = spark.range(4000).selectExpr("id % 400 AS crop_id", "id % 7 AS b", "id % 11 AS g", "id % 13 AS r")
    found = appearance.two_means(points, "crop_id")
    assert found.count() == 400 and len(found.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def lloyd(points, centres):
    while True:
        near = ((points - centres[0]) ** 2).sum(1) <= ((points - centres[1]) ** 2).sum(1)
        new = np.array([points[near].mean(0) if near.any() else centres[0], points[~near].mean(0) if (~near).any() else centres[1]])
        if (new == centres).all():
            return centres
        centres = new


def cost(points, centres):
    return np.minimum(((points - centres[0]) ** 2).sum(1), ((points - centres[1]) ** 2).sum(1)).sum()


def test_seeded_starts_are_as_good_as_extremes_and_often_better(spark):
    rng = random.Random(2)
    rows = [(k, *(rng.randrange(256) for _ in "bgr")) for k in range(40) for _ in range(rng.randrange(1, 50))]
    rows += [(100, 5, 6, 7)] * 9 + [(101, 0, 0, 0)] * 50 + [(101, 255, 255, 255)]
    better = 0
    for r in appearance.two_means(spark.createDataFrame(rows, "crop_id long, b long, g long, r long"), "crop_id").collect():
        points = np.array([x[1:] for x in rows if x[0] == r["crop_id"]], float)
        found = np.array([[r[f"c{k}_{c}"] for c in "bgr"] for k in (0, 1)])
        assert np.allclose(lloyd(points, found), found)
        orders = [lambda p: (sum(p), *p), lambda p: p, lambda p: (p[1], *p), lambda p: (p[2], *p)]
        four = min(cost(points, lloyd(points, np.array([min(map(tuple, points), key=o), max(map(tuple, points), key=o)]))) for o in orders)
        assert cost(points, found) <= four + 1e-6
        better += cost(points, found) < four - 1e-6
        assert (found[0].sum(), *found[0]) <= (found[1].sum(), *found[1])
    assert better > 5


def test_rounds_shuffle_nothing_and_end_or_fail(spark, monkeypatch):
    rows = [(k % 3, (k * 37) % 256, (k * 91) % 256, (k * 53) % 256) for k in range(120)]
    df = spark.createDataFrame(rows, "crop_id long, b long, g long, r long")
    written, plans = appearance.written, []
    monkeypatch.setattr(appearance, "written", lambda x, name: (plans.append(x._jdf.queryExecution().executedPlan().toString()), written(x, name))[1])
    appearance.two_means(df, "crop_id")
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 2  # counts by colour, and a row for each group
    with pytest.raises(RuntimeError, match="still moves"):
        appearance.two_means(df, "crop_id", rounds=1)
    assert appearance.two_means(df.where("false"), "crop_id").count() == 0


def test_teams_from_frames(spark):
    """Two teams in clear colours over green; a player first seen later, one without pixels, one given by hand."""
    tracks, pixels = [], []
    for t, (frame, x, colour) in enumerate([(0, 0, (250, 0, 0)), (0, 12, (0, 0, 250)), (0, 24, (240, 5, 0)), (2, 36, (5, 0, 240)), (0, 48, (0, 0, 255)), (1, 900, None)], 1):
        tracks += [(7, f, "players", t, x + 0.5, 1.25, x + 10.75, 21.0) for f in (frame, frame + 1)]
        if colour:
            pixels += [(7, frame, x + i, 1 + j, *(colour if 3 <= i < 7 and 2 <= j else (0, 200, 0))) for i in range(10) for j in range(20)]
            pixels += [(7, frame + 1, x + i, 1 + j, *colour[::-1]) for i in range(10) for j in range(20) if frame == 2]
    tracks = spark.createDataFrame(tracks, "match_id long, frame_num long, object string, track_id long, x1 double, y1 double, x2 double, y2 double")
    pixels = spark.createDataFrame(pixels, "match_id long, frame_num long, x long, y long, b long, g long, r long")
    overrides = spark.createDataFrame([(7, 5, 2)], "match_id long, track_id long, team int")
    players, teams = appearance.assign_teams_from_frames(pixels, tracks, overrides)
    assert {r["track_id"]: r["team"] for r in players.collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: 2}
    assert {r["team"]: (r["b"], r["g"], r["r"]) for r in teams.collect()} == {1: (0, 0, 252.5), 2: (245, 2.5, 0)}


QUADS = [
    [(110, 1035), (265, 275), (910, 260), (1640, 915)],
    [(0, 0), (0, 1), (1, 1), (1, 0)],
    [(0, 0), (10, 1), (14, 12), (-3, 9)],
]


def as_points(spark, rows):
    kind = "array<struct<x:double,y:double>>"
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in a] if a is not None else None, [(float(x), float(y)) for x, y in b]) for k, a, b in rows], f"calibration_id long, src {kind}, dst {kind}")


def test_closed_form_equals_the_linear_system(spark):
    rng = random.Random(4)
    quads = QUADS + [[(x + rng.uniform(-90, 90), y + rng.uniform(-90, 90)) for x, y in ((0, 0), (900, 50), (1000, 700), (-100, 600))] for _ in range(30)]
    rows = [(k, q, quads[(k * 7 + 1) % len(quads)]) for k, q in enumerate(quads)]
    for r in g.solve_calibrations(as_points(spark, rows)).collect():
        want = np.array(g.solve_homography(rows[r["calibration_id"]][1], rows[r["calibration_id"]][2]))
        assert np.allclose(r["h"], want, rtol=1e-6, atol=1e-6 * abs(want).max())


def test_calibrations_without_a_solution(spark):
    flat = [(0, 0), (1, 1), (2, 2), (5, 0)]
    rows = [(1, flat, QUADS[1]), (2, QUADS[1], flat), (3, QUADS[1][:3], QUADS[1]), (4, None, QUADS[1]), (5, [(0, 0)] * 4, QUADS[1]), (6, QUADS[0], QUADS[1]), (6, QUADS[0], QUADS[1])]
    got = {r["calibration_id"]: r["h"] for r in g.solve_calibrations(as_points(spark, rows)).collect()}
    assert len(got) == 6 and all((got[k] is None) == (k != 6) for k in got)
    tracks = spark.createDataFrame([(k, 500.0, 700.0) for k in range(1, 8)], "calibration_id long, adj_x double, adj_y double")
    world = {r["calibration_id"]: r["world_x"] for r in camera.on_pitch_by_calibration(tracks, as_points(spark, rows)).collect()}
    assert len(world) == 7 and {k for k, x in world.items() if x is not None} == {6}


def test_polygons_that_are_data(spark):
    """Corners, edges, a notch, coordinates that are cut to whole ones; outside the polygon there is no position."""
    notch = [(0, 0), (0, 10), (5, 5), (10, 10), (10, 0)]
    spots = [(x + d, y + d) for x in range(-2, 13) for y in range(-2, 13) for d in (0.0, 0.75)]
    df = spark.createDataFrame(spots, "x double, y double").withColumn("corners", F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in notch]))
    x, y = F.col("x"), F.col("y")
    rows = df.select("x", "y", g.inside_corners(x, y, F.col("corners")).alias("data"), g.inside(x, y, notch).alias("literal")).collect()
    assert all(r["data"] == r["literal"] for r in rows) and len({r["data"] for r in rows}) == 2
    by = {(r["x"], r["y"]): r["data"] for r in rows}
    assert by[5.0, 5.0] and by[0.0, 10.0] and not by[5.0, 6.0] and by[10.75, 9.75] and not by[11.0, 9.0] and not by[5.0, 10.0]


def test_world_by_match_equals_the_fixed_calibration(spark):
    p = Params()
    rows = [(m, f, 100.0 * f, 90.0 * f + 30 * m) for m in (1, 2) for f in range(18)]
    tracks = spark.createDataFrame(rows, "match_id long, frame_num long, adj_x double, adj_y double")
    same = as_points(spark, [(1, p.polygon, p.pitch), (2, p.polygon, p.pitch)]).withColumnRenamed("calibration_id", "match_id")
    spot = lambda df: {(r["match_id"], r["frame_num"]): (r["world_x"], r["world_y"]) for r in df.collect()}
    one, two = spot(camera.on_pitch(tracks)), spot(camera.on_pitch_by_calibration(tracks, same, "match_id"))
    assert one.keys() == two.keys()
    for k in one:
        assert (one[k][0] is None) == (two[k][0] is None)
        assert one[k][0] is None or np.allclose(one[k], two[k], atol=1e-4)
    assert 0 < sum(v[0] is not None for v in two.values()) < len(two)
