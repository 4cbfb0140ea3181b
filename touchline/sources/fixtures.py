"""Tables of many matches derived from order and event data, for the registered queries.

A match is 750 consecutive orders, a frame is an order, and its lines are detections.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import camera, tracks
from .folder import partitions

BALL = """
    match_id, frame_num, CAST({index} AS BIGINT) AS det_index, 'ball' AS class_name, CAST(NULL AS BIGINT) AS track_id, {confidence} AS confidence,
    CAST(150.5e0 + (o_custkey*{a}) % 1400 AS DOUBLE) AS x1, CAST(300.5e0 + (o_custkey*{b}) % 600 AS DOUBLE) AS y1,
    CAST(162.5e0 + (o_custkey*{a}) % 1400 AS DOUBLE) AS x2, CAST(312.5e0 + (o_custkey*{b}) % 600 AS DOUBLE) AS y2
"""
DETECTION = """
    match_id, frame_num, det_index,
    CASE WHEN l_linenumber <= 5 THEN 'player' WHEN l_linenumber = 6 THEN 'referee' ELSE 'goalkeeper' END AS class_name,
    CAST(l_linenumber AS BIGINT) AS track_id, l_discount*10 AS confidence,
    CAST(150.25e0 + (l_partkey*37 + frame_num*3) % 1400 AS DOUBLE) AS x1,
    CAST(250.75e0 + (l_suppkey*29 + frame_num*2) % 650 AS DOUBLE) AS y1,
    CAST(170.25e0 + (l_partkey*37 + frame_num*3) % 1400 + l_linenumber*4 AS DOUBLE) AS x2,
    CAST(310.75e0 + (l_suppkey*29 + frame_num*2) % 650 + l_quantity AS DOUBLE) AS y2
"""
#: Boxes packed so densely that many overlap from frame to frame.
DENSE = """
    match_id, frame_num, 'players' AS object, det_index,
    CAST((l_partkey*37) % 200 AS DOUBLE) AS x1, CAST((l_suppkey*29) % 90 AS DOUBLE) AS y1,
    CAST((l_partkey*37) % 200 + 40 AS DOUBLE) AS x2, CAST((l_suppkey*29) % 90 + 60 AS DOUBLE) AS y2
"""
#: The same boxes as detections, three in four of which have no track id; the ids of the others clash at times.
UNNAMED = """
    match_id, frame_num, det_index, CASE WHEN l_linenumber <= 5 THEN 'player' ELSE 'referee' END AS class_name,
    CASE WHEN (l_orderkey * 3 + l_linenumber) % 4 = 0 THEN CAST(l_suppkey % 5 + 1 AS BIGINT) END AS track_id, 0.5e0 AS confidence,
    CAST((l_partkey*37) % 200 AS DOUBLE) AS x1, CAST((l_suppkey*29) % 90 AS DOUBLE) AS y1,
    CAST((l_partkey*37) % 200 + 40 AS DOUBLE) AS x2, CAST((l_suppkey*29) % 90 + 60 AS DOUBLE) AS y2
"""
#: Twelve pixels of each detection's frame, spread over its box; boxes may share a pixel, which is then the least.
FRAME_PIXEL = """
    match_id, frame_num,
    CAST(150 + (l_partkey*37 + frame_num*3) % 1400 + (k % 3) * 6 AS BIGINT) AS x, CAST(250 + (l_suppkey*29 + frame_num*2) % 650 + CAST(floor(k / 3) AS BIGINT) * 13 AS BIGINT) AS y,
    CAST((l_partkey*7 + k*13) % 256 AS BIGINT) AS b, CAST((l_suppkey*11 + k*29) % 256 AS BIGINT) AS g, CAST((l_orderkey + l_linenumber*40 + k*17) % 256 AS BIGINT) AS r
"""


class Fixtures:
    """The tables of one directory, each made when asked for; of ``matches(match_id)`` only, where these are given."""

    def __init__(self, spark: SparkSession, sf_dir: str, matches: DataFrame | None = None):
        self.spark, self.sf_dir, self.matches = spark, sf_dir, matches

    def of(self, matches: DataFrame) -> Fixtures:
        return Fixtures(self.spark, self.sf_dir, matches)

    def _chosen(self, rows: DataFrame) -> DataFrame:
        return rows if self.matches is None else rows.join(self.matches, "match_id", "left_semi")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self._chosen(self.table("orders").selectExpr("CAST(floor(o_orderkey/750) AS BIGINT) AS match_id", "o_orderkey % 750 AS frame_num", "*"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.orders.select("match_id", "frame_num")

    @cached_property
    def unnumbered(self) -> DataFrame:
        return self._chosen(self.table("lineitem").selectExpr("CAST(floor(l_orderkey/750) AS BIGINT) AS match_id", "l_orderkey % 750 AS frame_num", "*"))

    @cached_property
    def lines(self) -> DataFrame:
        """Lines numbered by order, dealt to as many partitions as their size asks for."""
        lines = self.table("lineitem") if self.matches is None else self.unnumbered.drop("match_id", "frame_num")
        index = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS BIGINT) AS det_index"
        return lines.repartition(partitions(lines), "l_orderkey").selectExpr("CAST(floor(l_orderkey/750) AS BIGINT) AS match_id", "l_orderkey % 750 AS frame_num", index, "*")

    @cached_property
    def detections(self) -> DataFrame:
        seen = self.orders.where("o_orderstatus <> 'P'")
        one = seen.selectExpr(*_columns(BALL.format(index=100, confidence="0.5e0", a=53, b=31)))
        two = seen.where("o_orderpriority = '1-URGENT'").selectExpr(*_columns(BALL.format(index=101, confidence="0.3e0", a=59, b=41)))
        return self.lines.selectExpr(*_columns(DETECTION)).unionByName(one).unionByName(two)

    @cached_property
    def dense(self) -> DataFrame:
        return self.lines.selectExpr(*_columns(DENSE))

    @cached_property
    def unnamed(self) -> DataFrame:
        return self.lines.selectExpr(*_columns(UNNAMED))

    @cached_property
    def features(self) -> DataFrame:
        return self.lines.selectExpr(
            "match_id", "frame_num", "det_index AS feature_id", "CAST((l_partkey*7) % 1920 AS DOUBLE) AS old_x", "CAST((l_suppkey*11) % 1080 AS DOUBLE) AS old_y",
            "CAST((l_partkey*7) % 1920 AS DOUBLE) + (l_quantity-25)*0.5e0 AS new_x", "CAST((l_suppkey*11) % 1080 AS DOUBLE) + (l_linenumber-4)*1.5e0 AS new_y",
        )

    @cached_property
    def corners(self) -> DataFrame:
        return self.features.select("match_id", "frame_num", F.col("old_x").alias("x"), F.col("old_y").alias("y"), F.col("feature_id").alias("i")).join(
            self.lines.selectExpr("match_id", "frame_num", "det_index AS i", "l_extendedprice AS quality"), ["match_id", "frame_num", "i"]
        ).drop("i")

    @cached_property
    def pixels(self) -> DataFrame:
        numbered = self.table("embeddings").selectExpr(
            "CAST(label AS BIGINT) AS label", "CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS i",
            *[f"CAST(floor((CAST(embedding[{k}] AS DOUBLE)+1e0)*127.5e0) AS BIGINT) AS {c}" for k, c in enumerate("bgr")],
        )
        return numbered.selectExpr("label + 10 * CAST(floor(i/40) AS BIGINT) AS crop_id", "i % 5 AS x", "CAST(floor(i % 40 / 5) AS BIGINT) AS y", "b", "g", "r")

    @cached_property
    def crops(self) -> DataFrame:
        """Ten crops a match: five players in two frames."""
        crops = self.pixels.select("crop_id").distinct()
        return crops.selectExpr("crop_id", "CAST(floor(crop_id/10) AS BIGINT) AS match_id", "CAST(floor(crop_id % 10 / 5) AS BIGINT) AS frame_num", "crop_id % 5 + 1 AS track_id")

    @cached_property
    def images(self) -> DataFrame:
        """Whole frames for boxes to be cut from: each crop's pixels at an offset that its number gives."""
        return self.pixels.selectExpr("crop_id", "x + crop_id % 7 AS x", "y + crop_id % 3 AS y", "b", "g", "r")

    @cached_property
    def boxes(self) -> DataFrame:
        """A box for each image, with fractions to be truncated, some of it before the image's first pixel."""
        return self.crops.selectExpr("crop_id", "crop_id % 7 - 1.5e0 AS x1", "crop_id % 3 - 0.5e0 AS y1", "crop_id % 7 + 4.75e0 AS x2", "crop_id % 3 + 6.25e0 AS y2")

    @cached_property
    def frame_pixels(self) -> DataFrame:
        """Whole frames, of which only some pixels are given: those that the boxes of detections have."""
        return _pixels(self.unnumbered)

    def pixels_of(self, frames: DataFrame) -> DataFrame:
        """Those of ``frames(match_id, frame_num)``: lines are chosen before pixels are made of them and aggregated."""
        return _pixels(self.unnumbered.join(frames, ["match_id", "frame_num"], "left_semi"))

    @cached_property
    def match_calibrations(self) -> DataFrame:
        return self.calibrations.withColumnRenamed("calibration_id", "match_id")

    @cached_property
    def calibrated(self) -> DataFrame:
        """A calibration for each match."""
        return self.frames.select("match_id").distinct().selectExpr("match_id", "match_id AS calibration_id")

    @cached_property
    def player_team(self) -> DataFrame:
        players = self.tracks.where("object = 'players'").select("match_id", "track_id").distinct()
        return players.selectExpr("match_id", "track_id", "CAST(track_id % 2 + 1 AS INT) AS team")

    @cached_property
    def overrides(self) -> DataFrame:
        first = self.frames.where("match_id = 0 AND frame_num = 0")
        return first.selectExpr("match_id", "CAST(3 AS BIGINT) AS track_id", "CAST(1 AS INT) AS team")

    @cached_property
    def calibrations(self) -> DataFrame:
        """The broadcast calibration for each match, its camera shifted by a number of pixels that the match gives."""
        points = lambda corners, shift: F.array(*[F.struct((F.lit(x) + shift).alias("x"), F.lit(y).alias("y")) for x, y in corners])
        shift = (F.col("calibration_id") % 25).cast("double")
        return self.calibrated.select("calibration_id", points(DEFAULTS.polygon, shift).alias("src"), points(DEFAULTS.pitch, F.lit(0.0)).alias("dst"))

    @cached_property
    def tracks(self) -> DataFrame:
        return tracks.build_tracks(self.detections)

    @cached_property
    def camera(self) -> DataFrame:
        return camera.camera_motion(self.frames, self.features)


def _pixels(lines: DataFrame) -> DataFrame:
    """Of several colours of a pixel the least by b, g, r counts, as one number: numbers are aggregated by hash, structs
    by a sort."""
    each = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).selectExpr(*_columns(FRAME_PIXEL))
    least = F.min(F.col("b") * 65536 + F.col("g") * 256 + F.col("r")).alias("c")
    parts = [F.shiftright("c", 16).alias("b"), (F.shiftright("c", 8) % 256).alias("g"), (F.col("c") % 256).alias("r")]
    return each.groupBy("match_id", "frame_num", "x", "y").agg(least).select("match_id", "frame_num", "x", "y", *parts)


def _columns(text: str) -> list[str]:
    """A select list split at the commas outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:k].strip())
            at = k + 1
    return [*out, text[at:].strip()]
