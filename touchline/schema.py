"""Schemas of the tables; every table is keyed by match."""

from __future__ import annotations

from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

FRAME = ["match_id", "frame_num"]
TRACK = ["match_id", "object", "track_id"]
BOX = ["x1", "y1", "x2", "y2"]

_LONG, _DOUBLE, _INT, _STRING = LongType(), DoubleType(), IntegerType(), StringType()


def _table(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_frame = {"match_id": _LONG, "frame_num": _LONG}
_box = dict.fromkeys(BOX, _DOUBLE)
FRAMES = _table(**_frame)
DETECTIONS = _table(**_frame, det_index=_LONG, class_name=_STRING, track_id=_LONG, confidence=_DOUBLE, **_box)
TRACKS = _table(**_frame, object=_STRING, track_id=_LONG, det_index=_LONG, first_index=_LONG, **_box)
FEATURES = _table(**_frame, feature_id=_LONG, old_x=_DOUBLE, old_y=_DOUBLE, new_x=_DOUBLE, new_y=_DOUBLE)
CAMERA = _table(**_frame, dx=_DOUBLE, dy=_DOUBLE)
PIXELS = _table(crop_id=_LONG, x=_LONG, y=_LONG, b=_LONG, g=_LONG, r=_LONG)
CROPS = _table(crop_id=_LONG, match_id=_LONG, frame_num=_LONG, track_id=_LONG)
PLAYER_TEAM = _table(match_id=_LONG, track_id=_LONG, team=_INT)
