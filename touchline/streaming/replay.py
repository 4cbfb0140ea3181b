"""Batch tables as streams: written to files, read as one batch, and collected in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import shared_folder

SENTINEL_MATCH = -1


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, whose streams keep their state in RocksDB from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def with_sentinel(df: DataFrame, key: dict, years: int = 1) -> DataFrame:
    """``df`` and a row a year after all others, which moves the watermark past them."""
    last = df.agg(F.max("ts").alias("ts")).select(*[(F.lit(key[c]).cast(t) if c in key else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes if c != "ts"], (F.col("ts") + F.make_interval(F.lit(years))).alias("ts"))
    return df.unionByName(last)


def replay(df: DataFrame, key: dict, operator: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What the streaming operator has emitted once it has read all rows of ``df`` and the sentinel
    (``key`` gives its columns), as one batch. As a batch has no order, rows are written by the tasks that made them: they
    don't move, and nothing is computed twice to find ranges of time."""
    spark = with_rocksdb(df.sparkSession)
    folder = shared_folder(spark, "stream")
    df.write.parquet(f"{folder}/in")
    sentinel = with_sentinel(spark.read.parquet(f"{folder}/in"), key).where(F.col("match_id") == SENTINEL_MATCH)
    sentinel.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    found = operator(source)
    if mode == "append":
        query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(found.schema).parquet(f"{folder}/out")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = found.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
