"""Near-duplicate documents by SimHash fingerprints and an inverted index of their bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42  # of XXH64 (fixed value)
MAX_BITS = 2
KEY = ["doc_id", "text_hash", "row_hash"]  #: of a row, so far as :func:`one_of_each` tells rows apart


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Signed 64-bit SimHash: bit set if set in over half the hashes of the shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < words_each:
        hashes = [digest(joined, SEED)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + 1) - 1
        starts = (ends - length)[: len(words) - words_each + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)]
    found = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(found[a : a + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(found), 65536))
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp and ``others`` (columns of longs) of every row of ``docs(doc_id, text, ...)``; a null
    text has no words: fp zero."""
    names = ["doc_id", *others]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(fps, pa.int64())], [*names, "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others, "text").mapInArrow(scan, ", ".join(f"{x} long" for x in [*names, "fp"]))


def postings(classes: DataFrame) -> DataFrame:
    """The inverted index: a posting is six of the eight byte positions (``without``: the other two, as
    bits) and the bytes there (``bytes``, zero elsewhere).

    Fingerprints that differ in two bits at most share six positional bytes, the guaranteed minimum, so
    they meet in a posting; and all that meet share six. (A posting of one byte would be as long as the
    corpus over 256, and the tally of its pairs grow with the corpus's square.)
    """
    out = [(1 << i) | (1 << j) for i in range(8) for j in range(i)]
    spoilt = [sum(0xFF << (8 * k) for k in range(8) if w >> k & 1) for w in out]
    keys = [F.struct(F.lit(w).alias("without"), F.col("fp").bitwiseAND(F.lit(_signed(~m))).alias("bytes")) for w, m in zip(out, spoilt, strict=True)]
    return classes.select(F.inline(F.array(*keys)), "fp")


def _signed(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def links(classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the distinct fingerprints in ``classes(fp)`` that connect what is linked.

    Only postings that hold several fingerprints give candidates. They aren't paired with each other,
    which would grow with the square of a posting: a fingerprint goes to itself and to the places one
    bit away in the two bytes that the posting leaves open, and those that meet in a place are tied to
    the least of them. Two that differ in two bits at most meet in a place of some posting, so no link
    is lost; and all that meet do, which is verified once more.
    """
    index = postings(classes)
    lists = common.written(index.groupBy("without", "bytes").count().where("count > 1").select("without", "bytes"), "posting-lists")
    shared = index.join(lists, ["without", "bytes"])
    flips = [F.when(F.col("without").bitwiseAND(F.lit(1 << (k // 8))) != 0, F.col("fp").bitwiseXOR(F.lit(_signed(1 << k)))) for k in range(64)]
    places = shared.select(F.explode(F.array_compact(F.array(F.col("fp"), *flips))).alias("place"), "fp")
    met = places.groupBy("place").agg(F.collect_set("fp").alias("fps"))  # 65 at most
    ties = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return ties.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()


def rooted_classes(found: DataFrame, least: Column) -> DataFrame:
    """fp, root of its component and the least ``least`` of its rows, for every distinct fp of ``found``."""
    classes = common.written(found.groupBy("fp").agg(F.min(least).alias("least")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return common.written(rooted, "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links) of every row of ``docs``.

    Documents with equal fingerprints are one class; only distinct fingerprints are indexed and
    linked. Null and empty texts have the fingerprint zero, linked like any other. A null doc_id gets
    the component's smallest, null if all are. Rows that repeat a doc_id keep a row each. An empty
    table gives an empty table; other columns are ignored.
    """
    found = common.written(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    rooted = rooted_classes(found, F.col("doc_id"))
    least = common.written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = common.written(rooted.join(least, "root").select("fp", "component_id"), "class-components")
    return found.join(named, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that with its smallest doc_id; all columns, unchanged.

    A component's rows that share that doc_id are told apart by hashes of the text and of the whole
    row, of which the smallest stays. A row with a null doc_id stays only where its whole component
    has none, one for each such component.
    """
    own = F.col("row.doc_id").cast("long").alias("doc_id")
    hashes = [F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("text_hash"), F.xxhash64("row").alias("row_hash")]
    rows = docs.select(F.struct("*").alias("row")).select("row", own, *hashes)
    found = common.written(fingerprints(rows.select("doc_id", F.col("row.text").alias("text"), "text_hash", "row_hash"), KEY[1:]), "fingerprints")
    rooted = rooted_classes(found, F.struct(F.col("doc_id").isNull().alias("nameless"), *KEY))
    kept = common.written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(*[F.col(f"least.{x}").alias(f"kept_{x}") for x in KEY]), "kept")
    same = [F.col(x).eqNullSafe(F.col(f"kept_{x}")) for x in KEY]
    same = same[0] & same[1] & same[2]
    alike = found.groupBy(*KEY).count().where("count > 1")
    alike = common.written(kept.join(alike, same, "left_semi"), "alike")
    if alike.isEmpty():
        return rows.join(kept, same, "left_semi").select("row.*")
    alone = kept.join(alike.select(*[F.col(f"kept_{x}").alias(x) for x in KEY]), same, "left_anti")
    once = rows.join(alike, same, "left_semi").dropDuplicates(KEY)
    return rows.join(common.written(alone, "alone"), same, "left_semi").unionByName(once).select("row.*")
