import struct
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from touchline.llm import token_files as t

PATH = t.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_by_word_equals_the_library(library, odd_texts, texts):
    import pyarrow as pa

    every = [x for x in [*odd_texts, *texts.values()] if x is None or len(x) < 60_000]
    got = t.WordEncoder(PATH, "<u2")(pa.array(every, pa.string()))
    assert [x.tolist() for x in got] == [whole(library, x)[:-1] for x in every]
    again = t.WordEncoder(PATH, "<u2", by_word=False)(pa.array(every[:5], pa.string()))
    assert [x.tolist() for x in again] == [whole(library, x)[:-1] for x in every[:5]]


def test_other_tokenizers_take_texts_whole(library, tmp_path):
    import json

    import pyarrow as pa

    settings = json.loads(library.to_str())
    assert t.special_marks(settings) == ["<|"] and t.WordEncoder(PATH, "<u2").marks == ["<|"]
    texts = ["Café au LAIT, 12 o'clock's", "two  words", "", None]
    others = [
        settings | {"normalizer": {"type": "NFC"}},
        settings | {"pre_tokenizer": settings["pre_tokenizer"] | {"pretokenizers": settings["pre_tokenizer"]["pretokenizers"][1:]}},
        settings | {"added_tokens": [*settings["added_tokens"], settings["added_tokens"][0] | {"id": len(library.get_vocab()), "content": "words"}]},
    ]
    for k, other in enumerate(others):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(other))
        encode, exact = t.WordEncoder(str(path), "<u2"), Tokenizer.from_file(str(path))
        assert encode.marks is None
        assert [x.tolist() for x in encode(pa.array(texts, pa.string()))] == [whole(exact, x)[:-1] for x in texts]


def test_memory_of_words_is_bounded(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(t, "MEMO_WORDS", 50)
    encode = t.WordEncoder(PATH, "<u2")
    texts = [f"number{k} word{k % 7} {'q' * k}" for k in range(400)]
    assert [x.tolist() for x in encode(pa.array(texts))] == [whole(library, x)[:-1] for x in texts]
    assert len(encode.memo) + len(encode.before) <= 110


@pytest.mark.parametrize("parts, file_docs", [(1, 10**6), (3, 10**6), (2, 4)])
def test_round_trip(spark, odd_docs, library, parts, file_docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    manifest = t.write_token_files(odd_docs, PATH, parts=parts, file_docs=file_docs)
    got = [tuple(r) for r in t.read_documents(manifest).orderBy("start").collect()]
    want, start = [], 0
    for d, text in rows:
        ids = whole(library, text)
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want


def test_file_is_plain_zstandard_and_seekable(tmp_path):
    uri = f"file://{tmp_path}/x.ids"
    writer = t.Writer(uri, "<u2", frame_ids=100)
    docs = [np.arange(n, dtype="<u2") for n in (0, 7, 250, 60, 60, 1)]
    for k, x in enumerate(docs):
        writer.add(None if k == 1 else k, x.tobytes())
    assert writer.close() == (tmp_path / "x.ids").stat().st_size
    with open(tmp_path / "x.ids", "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read(10**6)
    assert plain == b"".join(x.tobytes() for x in docs)
    reader = t.Reader(uri)
    assert len(reader.frames) == 3 and [reader.document(k).tolist() for k in (5, 2, 0, 4, 3, 1)] == [docs[k].tolist() for k in (5, 2, 0, 4, 3, 1)]
    assert reader.nulls.tolist() == [False, True, False, False, False, False]
    reader.close()


def test_damage_is_noticed(tmp_path):
    uri = f"file://{tmp_path}/x.ids"
    writer = t.Writer(uri, "<u2", level=1)
    writer.add(1, np.random.default_rng(1).integers(0, 60_000, 5000).astype("<u2").tobytes())
    writer.close()
    raw = bytearray((tmp_path / "x.ids").read_bytes())
    raw[3000] ^= 1
    (tmp_path / "x.ids").write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        t.Reader(uri).document(0)


def test_fetch_gives_what_is_asked(spark, documents, texts, library):
    manifest = t.write_token_files(documents, PATH, parts=2)
    wanted = manifest.select("path").crossJoin(spark.createDataFrame([(3,), (77,), (10**9,), (None,)], "doc_id long"))
    got = {r["doc_id"]: list(r["ids"]) for r in t.fetch(manifest, wanted).collect()}
    assert got == {d: whole(library, texts[d]) for d in (3, 77)}


def test_no_documents(no_docs):
    manifest = t.write_token_files(no_docs, PATH)
    assert manifest.count() == 0 and t.read_documents(manifest).collect() == []
