"""Shared folder, written tables and the file access of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.folder import dropped, shared_folder, written

__all__ = ["dropped", "held_out", "open_input", "open_output", "shared_folder", "slices", "written"]

def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2 (null counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def open_input(uri: str):
    files, path = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def open_output(uri: str):
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path, compression=None)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in the column each, so that what a task holds
    depends on its longest text and not on the batch's row count."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(past + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
