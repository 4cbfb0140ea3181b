"""Tables dealt by match and frame: what joins them by match and frame has no shuffle."""

import pytest
from pyspark.sql import functions as F

from touchline import schema
from touchline.operators import camera, kinematics, possession, tracks
from touchline.operators import appearance
from touchline.sources import folder
from touchline.sources.folder import dealt_by_frame, partitions, written

N_FRAMES = 40


@pytest.fixture(scope="module")
def dealt(spark):
    """Camera, tracks and balls of three matches, of which match 0 has most rows."""
    frames = spark.range(N_FRAMES * 3).selectExpr("CAST(IF(id < 90, 0, 1 + id % 2) AS BIGINT) AS match_id", "IF(id < 90, id, (id - 90) DIV 2) AS frame_num")
    moved = frames.select("*", F.lit(1.0).alias("dx"), F.lit(0.5).alias("dy"))
    each = frames.crossJoin(spark.range(6).select(F.col("id").alias("track_id")))
    place = (F.col("track_id") * 17 + F.col("frame_num")).cast("double")
    boxes = [(place + k).alias(c) for k, c in zip((0, 0, 10, 20), schema.BOX, strict=True)]
    rows = each.select(*schema.FRAME, F.when(F.col("track_id") == 5, "balls").otherwise("players").alias("object"), "track_id", F.col("track_id").alias("first_index"), *boxes)
    rows = tracks.with_position(rows).withColumns({"world_x": F.col("x1") / 10, "world_y": F.col("y1") / 10})
    return {"moved": dealt_by_frame(moved, "camera"), "world": dealt_by_frame(rows, "world"), "balls": dealt_by_frame(rows.where("object = 'balls'"), "balls"), "rows": rows, "camera": moved}


@pytest.fixture
def without_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shuffles(df):
    return plan_of(df).count("Exchange hashpartitioning")


def test_joins_by_frame_have_no_shuffle(dealt, without_broadcasts):
    moved, balls = dealt["moved"], dealt["balls"]
    world = tracks.replaced(dealt["world"], "balls", balls)
    assigned = possession.assign_ball(moved, world, balls)
    assert shuffles(camera.adjusted(dealt["world"], moved)) == 0
    assert shuffles(assigned) == 0
    held = possession.flag_holder(world, dealt_by_frame(assigned, "assigned"))
    assert shuffles(held) == 0
    assert shuffles(camera.adjusted(dealt["rows"], dealt["camera"])) > 0  # the same without dealt tables


def test_what_dealt_tables_say(dealt):
    """Rows, buckets by match and frame, and the same results as from rows that are not dealt."""
    key = [*schema.FRAME, "object", "track_id"]
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_rows(dealt["world"].select(*key, "x1")) == as_rows(dealt["rows"].select(*key, "x1"))
    balls = dealt["rows"].where("object = 'balls'")
    plain = possession.assign_ball(dealt["camera"], dealt["rows"], balls)
    assert as_rows(plain) == as_rows(possession.assign_ball(dealt["moved"], dealt["world"], dealt["balls"]))
    held = possession.flag_holder(dealt["rows"], plain)
    by_frame = held.groupBy(*schema.FRAME).agg(F.count_if("has_ball").alias("n"), F.max_by("track_id", "has_ball").alias("t")).join(plain, schema.FRAME)
    assert by_frame.where("n <> 1 OR t <> player_id").isEmpty() and by_frame.count() == N_FRAMES * 3
    assert held.where("has_ball AND object <> 'players'").isEmpty()


def test_an_empty_table_is_dealt(dealt):
    none = dealt_by_frame(dealt["rows"].limit(0), "none")
    assert none.columns == dealt["rows"].columns and none.isEmpty()
    assert kinematics.interpolate_ball(dealt["moved"].limit(0), none).isEmpty()


def test_partitions_grow_with_the_files_behind_tables(spark, dealt, monkeypatch):
    """So rows a task don't grow with the input; a small table has a shuffle's partitions."""
    least, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), written(dealt["rows"], "rows")
    assert partitions(spark.range(3)) == partitions(rows) == least
    monkeypatch.setattr(folder, "PART_BYTES", 200)
    assert partitions(rows) > least and partitions(rows, rows) == partitions(rows) < partitions(rows, written(dealt["camera"], "camera"))
    seen = rows.select(*schema.FRAME, F.col("track_id").alias("det_index"), F.lit("player").alias("class_name"), "track_id", F.lit(0.5).alias("confidence"), *schema.BOX)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    found = [tracks.build_tracks(seen).rdd.getNumPartitions(), kinematics.interpolate_ball(dealt["moved"], tracks.build_tracks(seen)).rdd.getNumPartitions()]
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert min(found) >= partitions(rows) > least


def test_tracks_dealt_once_meet_teams_and_colours_in_one_join(spark, dealt, without_broadcasts):
    """Ready rows aren't moved again, and joining team and colour moves the rows once."""
    again = dealt_by_frame(dealt["rows"].repartition(4, *schema.FRAME), "ready", 4, ready=True)
    assert shuffles(camera.adjusted(again, dealt["moved"])) == 0
    player_team = spark.createDataFrame([(m, t, 1 + t % 2) for m in (0, 1) for t in range(4)], "match_id long, track_id long, team int")
    teams = spark.createDataFrame([(m, k, 1.0 * m, 2.0 * k, 3.0) for m in (0, 1) for k in (1, 2)], "match_id long, team int, b double, g double, r double")
    found = appearance.with_team(again, appearance.with_team_colour(player_team, teams))
    twice = appearance.with_team_colour(appearance.with_team(again, player_team), teams)
    assert sorted(map(str, found.select(twice.columns).collect())) == sorted(map(str, twice.collect()))
    assert found.where("object = 'players' AND team_color IS NOT NULL").count() > 100 and found.where("object = 'balls' AND team IS NOT NULL").isEmpty()
    assert plan_of(found).count("FileScan parquet spark_catalog") == 1


def test_classes_are_broadcast(spark, without_broadcasts):
    """Detections are not dealt by class, of which there are few."""
    seen = spark.range(200).selectExpr("id AS det_index", "element_at(array('ball', 'player', 'fan'), CAST(id % 3 AS INT) + 1) AS class_name")
    classes = spark.createDataFrame([(0, "ball"), (2, "player"), (5, "player")], "class_id long, name string")
    found = tracks.class_names(tracks.class_ids(seen, classes), classes)
    assert plan_of(found).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan_of(found)
    assert {tuple(r) for r in found.select("class_id", "class_name").distinct().collect()} == {(0, "ball"), (5, "player"), (None, None)}
