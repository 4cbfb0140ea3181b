"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import FRAME

PART_BYTES = 8 << 20  #: of files behind a partition: a row has more bytes in a task than in a file, ten to twenty times
_own_folder: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (as in tests) gets a temporary folder; on a
    cluster that is an error, for a folder of one machine would not be seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        base = _own_folder[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = files.makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there, and a lost
    executor costs only the tasks that it ran."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(*tables: DataFrame) -> int:
    """How many partitions to deal the rows of ``tables`` to: as many as a shuffle has, or one for each ``PART_BYTES`` of
    the files that they are read from, if that is more. So what one task sorts doesn't grow with the input."""
    spark, found = tables[0].sparkSession, {f for t in tables for f in t.inputFiles()}
    jvm, conf, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for f in found:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def dealt_by_frame(df: DataFrame, name: str, n: int | None = None, ready: bool = False) -> DataFrame:
    """As :func:`written`, in ``n`` buckets of match and frame, as many as a shuffle has partitions by default: joins and
    groups of such tables by match and frame need no shuffle, and a long match is dealt over all buckets. Rows that
    are ``ready`` lie in ``n`` partitions by match and frame, and don't move again. The session's catalog lists the
    table under a name of its own, as an external one: dropping it from there leaves the files."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    n, table = n or int(spark.conf.get("spark.sql.shuffle.partitions")), path.rpartition("/")[2].replace("-", "_")
    (df if ready else df.repartition(n, *FRAME)).write.bucketBy(n, *FRAME).sortBy(*FRAME).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
