"""Scans by blocks of frames: the same as one pass over a match, whatever its length."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline import schema
from touchline.config import DEFAULTS
from touchline.operators import kinematics, possession, scans

SMALL = replace(DEFAULTS, block_frames=7)


def random_matches(spark, seed):
    """Balls and holders in some frames; match 0 has neither, match 1 both in its last frame only, the others gaps of
    several blocks."""
    draw = random.Random(seed)
    frames, balls, assigned = [], [], []
    for m, length in enumerate([9, 30, 1, 7, 8, 40, 63, 100]):
        share = [0.0, 0.0, 1.0, 0.5, 0.3, 0.1, 0.05, 0.02][m]
        for i in range(length):
            frames.append((m, i))
            if draw.random() < share or (m == 1 and i == length - 1):
                balls.append((m, i, *[float(draw.randrange(1000)) for _ in range(4)]))
            held = draw.random() < share or (m == 1 and i == length - 1)
            assigned.append((m, i, draw.choice([1, 2, 3]) if held else None))
    draw.shuffle(frames)
    key = "match_id long, frame_num long"
    return spark.createDataFrame(frames, key), spark.createDataFrame(balls, f"{key}, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(assigned, f"{key}, player_id long")


def teams_of(spark):
    return spark.createDataFrame([(m, t, 1 + t % 2) for m in range(8) for t in (1, 2)], schema.PLAYER_TEAM)  # 3 has none


@pytest.mark.parametrize("seed", range(3))
def test_balls_by_blocks_equal_one_pass(spark, seed):
    frames, balls, _ = random_matches(spark, seed)
    upto = Window.partitionBy("match_id").orderBy("frame_num").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("match_id").orderBy(F.desc("frame_num")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("x1").isNotNull(), F.struct("frame_num", *schema.BOX))
    near = frames.join(balls, schema.FRAME, "left").select(*schema.FRAME, F.last(seen, True).over(upto).alias("p"), F.last(seen, True).over(back).alias("n")).collect()

    def between(r, c):
        p, n = r["p"], r["n"]
        if not p or not n:
            return (p or n)[c] if p or n else None
        gap = n["frame_num"] - p["frame_num"]
        return p[c] + (n[c] - p[c]) * ((r["frame_num"] - p["frame_num"]) / gap) if gap else p[c]

    want = sorted((r["match_id"], r["frame_num"], *[between(r, c) for c in schema.BOX]) for r in near)
    got = kinematics.interpolate_ball(frames, balls, SMALL)
    assert sorted(map(tuple, got.select(*schema.FRAME, *schema.BOX).collect())) == [pytest.approx(r) if None not in r else r for r in want]
    assert got.schema == kinematics.interpolate_ball(frames, balls).schema


@pytest.mark.parametrize("seed", range(3))
def test_possession_by_blocks_equals_one_pass(spark, seed):
    assigned, player_team = random_matches(spark, seed)[2], teams_of(spark)
    team_of = {(r["match_id"], r["track_id"]): r["team"] for r in player_team.collect()}
    want, now, counts = [], {}, {}
    for m, i, player in sorted(map(tuple, assigned.collect()), key=lambda r: r[:2]):
        now[m] = team_of.get((m, player), now.get(m))
        n = counts.setdefault(m, [0, 0])
        if now[m]:
            n[now[m] - 1] += 1
        want.append((m, i, player, now[m], *[x / sum(n) if sum(n) else None for x in n]))
    names = [*schema.FRAME, "player_id", "team", "share_1", "share_2"]
    for found in (possession.timeline(assigned, player_team, SMALL), possession.running_share(possession.carried(assigned, player_team, SMALL), SMALL)):
        assert found.columns == names
        assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want


def test_balls_of_frames_that_are_not_asked_for(spark):
    key = "match_id long, frame_num long"
    frames = spark.createDataFrame([(0, 1), (0, 2)], key)
    balls = spark.createDataFrame([(0, 0, 9.0, 9.0, 9.0, 9.0), (0, 1, 1.0, 1.0, 1.0, 1.0), (5, 1, 7.0, 7.0, 7.0, 7.0), (None, 1, 7.0, 7.0, 7.0, 7.0)], f"{key}, x1 double, y1 double, x2 double, y2 double")
    found = kinematics.interpolate_ball(frames, balls).select(*schema.FRAME, "x1").collect()
    assert sorted(map(tuple, found)) == [(0, 1, 1.0), (0, 2, 1.0)]
    none = kinematics.interpolate_ball(frames.limit(0), balls)
    assert none.count() == 0


def test_five_million_frames_of_one_match(spark):
    """No task holds the match: its blocks are dealt over the partitions, and what goes over a whole match is a row a block."""
    frames = spark.range(5_000_000).selectExpr("CAST(0 AS BIGINT) AS match_id", "id AS frame_num")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few bytes, else put together again
    try:
        held = scans.dealt(frames).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 1 and max(r["n"] for r in held) < 3_000_000 and sum(r["blocks"] for r in held) == 100
    balls = frames.where("frame_num % 200000 = 150000").select("*", *[(F.col("frame_num") + k).cast("double").alias(c) for k, c in enumerate(schema.BOX)])
    found = kinematics.interpolate_ball(frames, balls)
    wrong = F.abs(F.col("x1") - F.least(F.greatest("frame_num", F.lit(150_000)), F.lit(4_950_000))) > 1e-3
    assert found.agg(F.count("*"), F.count_if(wrong)).first() == (5_000_000, 0)
    assigned = frames.select("*", F.when(F.col("frame_num") % 1_000_000 == 0, F.floor(F.col("frame_num") / 1_000_000) % 2 + 1).alias("player_id"))
    teams = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], schema.PLAYER_TEAM)
    last = possession.timeline(assigned, teams).where("frame_num IN (999999, 1500000, 4999999)").orderBy("frame_num").collect()
    assert [(r["team"], r["share_1"]) for r in last] == [(1, 1.0), (2, pytest.approx(1_000_000 / 1_500_001)), (1, pytest.approx(0.6))]
