"""Scans and sinks: tracks, camera movement, frames, images and model scores."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from ..config import DEFAULTS, Params
from .folder import dropped, written


def read_table(spark: SparkSession, path: str, kind: StructType) -> DataFrame:
    """A saved stage table with its fixed schema: no inference, columns pruned and filters pushed down."""
    return spark.read.schema(kind).parquet(path)


def write_table(df: DataFrame, path: str, kind: StructType) -> None:
    """Saved by match, so that a query over some matches reads only theirs. Rows are dealt by match first,
    evenly by size, so that a match is a file, or a few where it is large, and not one for each task."""
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in kind])
    rows.hint("rebalance", F.col("match_id")).write.mode("overwrite").partitionBy("match_id").parquet(path)


def load_or_compute(spark: SparkSession, path: str, kind: StructType, compute: Callable[[], DataFrame]) -> DataFrame:
    """The saved table if there is one, else computed, saved and read. A table is saved once its commit has
    left its mark; what a broken write left behind is computed anew."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        write_table(compute(), path, kind)
    return read_table(spark, path, kind)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def committed_matches(spark: SparkSession, path: str) -> DataFrame:
    """match_id, batch of the matches that the table at ``path`` holds whole."""
    kind = StructType([StructField("match_id", LongType()), StructField("batch", StringType())])
    manifest = f"{path}/_matches"
    return spark.read.schema(kind).parquet(manifest) if _exists(spark, manifest) else spark.createDataFrame([], kind)


def load_or_compute_matches(spark: SparkSession, path: str, kind: StructType, matches: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The saved rows of ``matches(match_id)``; ``compute`` makes those of the matches that aren't saved yet.

    Rows are appended under a batch of their own, by match, and a manifest names the matches of the batch once all
    its rows are there: only what it names is read. So a match that is added later costs itself alone, one whose
    writing broke off is computed anew without its pieces ever being seen, and a match without rows is
    known to have none. Of two writers that saved the same match, one batch counts.
    """
    asked = matches.select("match_id").where("match_id IS NOT NULL").distinct()
    missing = written(asked.join(committed_matches(spark, path), "match_id", "left_anti"), "missing-matches")
    rows = StructType([*kind.fields, StructField("batch", StringType())])
    if not missing.isEmpty():
        batch = F.lit(uuid.uuid4().hex).alias("batch")
        made = compute(missing).join(missing, "match_id", "left_semi").select(*[F.col(f.name).cast(f.dataType) for f in kind], batch)
        made.hint("rebalance", F.col("match_id")).write.mode("append").partitionBy("batch", "match_id").parquet(f"{path}/rows")
        missing.select("match_id", batch).write.mode("append").parquet(f"{path}/_matches")
    dropped(missing)
    whole = committed_matches(spark, path).join(asked, "match_id", "left_semi").groupBy("match_id").agg(F.min("batch").alias("batch"))
    saved = spark.read.schema(rows).parquet(f"{path}/rows") if _exists(spark, f"{path}/rows") else spark.createDataFrame([], rows)
    return saved.join(whole, ["batch", "match_id"], "left_semi").select(*kind.names)


def frame_spine(matches: DataFrame) -> DataFrame:
    """match_id, frame_num for every frame of ``matches(match_id, n_frames)``, empty ones too."""
    last = F.col("n_frames") - 1
    return matches.where("n_frames > 0").select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("frame_num"))


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, b, g, r of every pixel of the images below ``path`` (grey ones have b = g = r).

    The image source decodes in the JVM; a pixel is a slice of the image's bytes. Files that are no
    images are left out.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    at = F.col("i") * F.col("nChannels")
    pixels = images.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))

    def byte(k: int):
        place = at + F.least(F.lit(k), F.col("nChannels") - 1) + 1
        return F.conv(F.hex(F.substring("data", place, F.lit(1))), 16, 10).cast("long")

    return pixels.select(
        F.col("origin").alias("path"), (F.col("i") % F.col("width")).cast("long").alias("x"), F.floor(F.col("i") / F.col("width")).alias("y"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r")
    )


def write_crops(pixels: DataFrame, folder: str) -> None:
    """A PNG named after its number for each crop of ``pixels``; one image's rows are one group. Pixels that
    a crop lacks within its width and height are black."""

    def task(batch: pd.DataFrame) -> pd.DataFrame:
        crop, wide, high = int(batch["crop_id"].iloc[0]), int(batch["x"].max()) + 1, int(batch["y"].max()) + 1
        lines = np.zeros((high, wide, 3), "uint8")
        lines[batch["y"], batch["x"]] = batch[["r", "g", "b"]]
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        head = struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)
        raw = b"".join(b"\0" + x.tobytes() for x in lines)
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{crop}.png", compression=None) as out:
            out.write(png)
        return pd.DataFrame({"crop_id": [crop]})

    pixels.groupBy("crop_id").applyInPandas(task, "crop_id long").count()


def score_detections(df: DataFrame, column: str, make_model: Callable[[], Callable], kind: DataType, length: int, params: Params = DEFAULTS) -> DataFrame:
    """``df`` with ``prediction``, a model's output for ``column`` (arrays of ``length`` numbers): the model is
    made once in each worker and called with batches of rows."""
    predict = predict_batch_udf(make_model, return_type=kind, batch_size=params.detection_batch, input_tensor_shapes=[[length]])
    return df.withColumn("prediction", predict(F.col(column)))
