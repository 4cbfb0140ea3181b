"""Token ids in seekable Zstandard files.

File layout (little-endian). A file is a series of independent Zstandard frames, each with the ids
of whole documents and a content checksum; then a skippable frame with the document table
(compressed on its own); then the seek table of the public Zstandard seekable format: a skippable
frame with compressed size, decompressed size and checksum of every frame. A plain Zstandard
decoder reads the whole file as the ids in order; :func:`read_documents` seeks to the frames of the
documents asked for and decompresses no others.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Fixed values of the Zstandard seekable format and of the skippable frames.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DOCUMENT_TABLE_MAGIC = 0x184D2A50

FILE_IDS = 1 << 28  #: a task begins a new file once one holds so many ids
FILE_DOCS = 1 << 20  #: or so many documents, whose table is held in memory
FRAME_IDS = 1 << 18  #: a frame is closed once it holds so many ids
MEMO_WORDS = 700_000  #: words whose ids a worker remembers, and as many from before
MEMO_CHARS = 64  #: longer words are not remembered
#: Between a letter and an ASCII mark (not an apostrophe) the tokenizer always splits.
MARK = re.compile(rb"(?<=[a-z])(?=[!-&(-@\[-`{-~])")


#: The letters that stand for bytes in a byte-level vocabulary (fixed values): printable ones for
#: themselves, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


#: How a tokenizer normalizes and splits that lower-cases, drops white space and never merges across it or
#: across the border of letters and ASCII marks (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def special_marks(settings: dict) -> list[str] | None:
    """For a tokenizer's settings (its JSON): what a text holds if it holds one of its added tokens. None if
    its texts can't be encoded word by word, or an added token doesn't begin with ASCII marks."""
    model, sequence = settings["model"], settings.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    split = sequence.get("type") == "Sequence" and sequence.get("pretokenizers") == [SPLIT, BYTE_LEVEL]
    if not plain or not split or settings.get("normalizer") != NORMALIZER or settings.get("truncation") or settings.get("padding"):
        return None
    marks = [re.match(r"[!-/:-@\[-`{-~]*", x["content"])[0] for x in settings.get("added_tokens", [])]
    return sorted(set(marks)) if all(marks) else None


class WordEncoder:
    """Encodes texts by the words between white space, each looked up once and remembered.

    A text's ids are those of its words in a row if the tokenizer's file says that it splits so (see
    :func:`special_marks`). Texts that may hold a special token go to the library whole; so do all of any
    other tokenizer, and all if ``by_word`` is off.
    """

    def __init__(self, path: str, dtype: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.dtype = self.tokenizer.model, dtype
        self.marks = special_marks(json.loads(self.tokenizer.to_str())) if by_word else None
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _part(self, part: bytes) -> bytes:
        ids = self.memo.get(part)
        if ids is None:
            text = part.decode()
            if text.isalpha() and max(text) < "\u0500" and text.lower() == text and unicodedata.is_normalized("NFC", text):
                word = part.decode("latin-1").translate(BYTE_LETTERS)  # a single word to the model
                ids = np.array([x.id for x in self.model.tokenize(word)], dtype=self.dtype).tobytes()
            else:
                ids = self._whole(text)
            if len(part) <= MEMO_CHARS:
                self.memo[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.before.get(word)
            if ids is None:
                ids = b"".join([self._part(x) for x in MARK.sub(b" ", word).split()])
            if len(word) <= MEMO_CHARS:
                self.memo[word] = ids
                if len(self.memo) > MEMO_WORDS:
                    self.memo, self.before = {}, self.memo
        return ids

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = pa.repeat(pa.scalar(self.marks is None), len(texts))
        for mark in self.marks or []:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(whole, "", texts).cast(pa.large_string())))
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        index, word = coded.indices.to_numpy(), self._word
        found = [word(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        ids, first = np.frombuffer(b"".join(found), self.dtype), np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        flat = ids[np.repeat(first[index] - (ends - n), n) + np.arange(len(n) and ends[-1])]
        borders = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        out = np.split(flat, borders[1:-1]) if len(texts) else []
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[k] = np.frombuffer(self._whole(texts[k].as_py()), self.dtype)
        return out


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, dtype: str, by_word: bool) -> WordEncoder:
    """The worker's encoder: later tasks of the same Python worker use its words again."""
    key = (path, dtype, by_word)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


class Writer:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, uri: str, dtype: str, level: int = 3, frame_ids: int = FRAME_IDS):
        self.out = common.open_output(uri)
        self.dtype, self.frame_ids = dtype, frame_ids
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= self.frame_ids * np.dtype(self.dtype).itemsize:
            self._flush()

    def _flush(self) -> None:
        if not self.pending_bytes:
            return
        raw = b"".join(self.pending)
        frame = self.zip.compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.pending_bytes = [], 0

    def close(self) -> int:
        """Returns the number of bytes written."""
        self._flush()
        table = np.array(self.docs, dtype=[("id", "<i8"), ("null", "?"), ("bytes", "<u8")])
        raw = self.dtype.encode().ljust(8) + table.tobytes()
        docs = self.zip.compress(raw)
        seek = b"".join(struct.pack("<III", *f) for f in (*self.frames, (len(docs) + 8, 0, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)))
        seek += struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", DOCUMENT_TABLE_MAGIC, len(docs)) + docs)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)) + seek)
        size = self.out.tell()
        self.out.close()
        return size


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.uri = uri
        self.file = common.open_input(uri)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(-1, 3)
        at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(table[-1, 0]) - 8, int(at[-2]) + 8))
        self._check(raw, table[-1, 2], count - 1)
        self.dtype = raw[:8].decode().strip()
        docs = np.frombuffer(raw[8:], dtype=[("id", "<i8"), ("null", "?"), ("bytes", "<u8")])
        self.ids, self.nulls, self.sizes = docs["id"], docs["null"], docs["bytes"].astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.frames, self.frame_at = table[:-1], at[:-2]
        self.frame_starts = np.concatenate([[0], np.cumsum(self.frames[:, 1], dtype=np.int64)])
        self.cached: tuple[int, bytes] = (-1, b"")

    def _check(self, raw: bytes, checksum: int, frame: int) -> None:
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"{self.uri}: frame {frame} is damaged")

    def _frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.frames[k, 0]), int(self.frame_at[k])))
            self._check(raw, self.frames[k, 2], k)
            self.cached = (k, raw)
        return self.cached[1]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document; a document lies within one frame."""
        start, n = int(self.starts[k]), int(self.sizes[k])
        if not n:
            return np.empty(0, self.dtype)
        frame = int(np.searchsorted(self.frame_starts, start, side="right")) - 1
        return np.frombuffer(self._frame(frame), self.dtype, n // np.dtype(self.dtype).itemsize, start - int(self.frame_starts[frame]))

    def close(self) -> None:
        self.file.close()


MANIFEST = "part int, seq int, path string, bytes long, n_docs long, n_ids long"
MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 1, dtype: str = "<u2", parts: int | None = None, level: int = 3, by_word: bool = True,
    file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS,
) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending doc_id order, a file per range of
    ids, or several of bounded size; returns the manifest, one row per file, ``part`` and within it ``seq``
    ascending with doc_id.

    Null texts count as empty (the end id alone). Null doc_ids come first; rows with the same doc_id
    follow each other by text, and equal rows are written as often as they occur. Other columns
    are ignored. An empty table gives an empty manifest. A task that is tried again writes a new
    file; the manifest, itself a written table, names only files of attempts that succeeded.
    """
    spark = docs.sparkSession
    folder = common.shared_folder(spark, "token-files")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode = np.asarray([end_id], dtype), encoder(tokenizer, dtype, by_word)
        part, seq, writer, row = TaskContext.get().partitionId(), 0, None, {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"bytes": writer.close()}], MANIFEST_ARROW)

        for batch in (x for whole in batches for x in common.slices(whole, "text")):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                if writer is None:
                    row = {"part": part, "seq": seq, "path": f"{folder}/{uuid.uuid4().hex}.ids", "n_docs": 0, "n_ids": 0}
                    writer = Writer(row["path"], dtype, level)
                writer.add(doc_id, np.concatenate([ids, end]).tobytes())
                row["n_docs"] += 1
                row["n_ids"] += len(ids) + 1
                if row["n_ids"] >= file_ids or row["n_docs"] >= file_docs:
                    yield done()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield done()

    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text"))
    )
    return common.written(ranged.mapInArrow(write, MANIFEST), "manifest")


def scan_files(manifest: DataFrame, schema: str, read: Callable[[Reader, int, dict], tuple]) -> DataFrame:
    """Read every document of the manifest's files back; ``read(reader, k, file)`` makes a row of the
    file's k-th document. A task reads a file frame by frame."""
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (x for batch in batches for x in batch.to_pylist()):
            reader = Reader(file["path"])
            for a in range(0, len(reader.ids), 20_000):
                rows = [read(reader, k, file) for k in range(a, min(a + 20_000, len(reader.ids)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
            reader.close()

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks, "path").mapInArrow(scan, schema)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from
    the files. ``start`` of a file is the sum over the files before it: one row per file is summed."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def row(reader: Reader, k: int, file: dict) -> tuple:
        ids = reader.document(k)
        start = file["first"] + int(reader.starts[k]) // ids.itemsize
        return (None if reader.nulls[k] else int(reader.ids[k]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))

    return scan_files(files, "doc_id long, start long, n_tokens long, ids_crc32 long", row)


def fetch(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the documents in ``wanted(path, doc_id)``: only the frames that hold them are read.

    Rows that name no document of their file, no file, or a null doc_id give no row, and rows that repeat give
    one; a doc_id that the file holds more than once gives all of them. Columns besides these aren't read. Groups are files, so a task holds one file's document table and one frame.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        reader = Reader(rows["path"].iloc[0])
        asked = set(rows["doc_id"].dropna().astype("int64").tolist())
        at = [k for k in np.flatnonzero(np.isin(reader.ids, np.array(sorted(asked), dtype=np.int64))) if not reader.nulls[k]]
        out = pd.DataFrame({"doc_id": [int(reader.ids[k]) for k in at], "ids": pd.Series([reader.document(k).tolist() for k in at], dtype=object)})
        reader.close()
        return out

    return wanted.join(manifest.select("path"), "path").groupBy("path").applyInPandas(scan, "doc_id long, ids array<int>")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
