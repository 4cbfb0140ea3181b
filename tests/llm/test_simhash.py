import random

import pytest
import xxhash

from touchline.llm import simhash as s
from touchline.llm.components import components


def by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fps):
    """Smallest id of each id's component: fps is a list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints(odd_texts):
    for text in odd_texts:
        assert s.fingerprint(text) % 2**64 == by_hand(text)


def test_documents(documents, texts):
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in s.near_duplicates(documents).collect()}
    fps = [(d, by_hand(x)) for d, x in texts.items()]
    assert got == {d: (f, c) for (d, f), c in zip(fps, reachable(fps), strict=True)}


@pytest.mark.parametrize("seed", [1, 4, 6])
def test_links_of_clusters(spark, seed):
    """Dense clusters, chains two bits apart, and strangers; posting lists of any length."""
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(60)}
        for _ in range(25):
            seed ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(seed)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = s.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 2 and a < b for a, b in pairs)
    root = {f: f for f in signed}
    for r in components(found).collect():
        root[r["node"]] = r["root"]
    want = reachable(list(zip(range(len(fps)), fps, strict=True)))
    groups = {}
    for f, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(root[f])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(root.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000), (None, 3), (7, 6), (7, 6)] + [(9001 + i % 9, 9000) for i in range(9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1300)} | {k: 9000 for k in range(9000, 9010)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    got = s.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    rows = [(r["doc_id"], by_hand(r["text"])) for r in odd_docs.collect()]
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == sorted((d or -1, c or -1) for (d, _), c in zip(rows, reachable(rows), strict=True))
    kept = s.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    least = {c for c in reachable(rows)}
    assert sorted(ids, key=repr) == sorted(least, key=repr)
    assert s.near_duplicates(no_docs).collect() == [] and s.one_of_each(no_docs).collect() == []


def test_one_row_of_each_component_where_ids_repeat(spark):
    """Unrelated texts under no id or one id all stay, of near or exact copies one, the same each time."""
    rng = random.Random(11)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(9)]
    rows = [(None, prose[0], "a"), (None, prose[1], "a"), (None, prose[1], "b"), (None, prose[2], "a"), (None, prose[2], "a")]
    rows += [(7, prose[3], "a"), (7, prose[4], "a"), (7, prose[4], "a"), (8, prose[5], "a"), (None, prose[5], "a"), (9, prose[5], "a"), (7, prose[5], "b"), (None, None, "a"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 5):
        kept = [tuple(r) for r in s.one_of_each(df.repartition(n)).collect()]
        assert sorted((d or -1, t or "") for d, t, _ in kept) == sorted([(-1, ""), *((-1, prose[k]) for k in (0, 1, 2)), *((7, prose[k]) for k in (3, 4, 5))])
        assert set(kept) <= set(rows)
        assert n == 1 or sorted(kept, key=repr) == first
        first = sorted(kept, key=repr)


def test_postings_share_six_bytes(spark):
    """Fingerprints meet in a posting if and only if six of their bytes or more are equal."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(rng.randrange(256) << (8 * k) for k in rng.sample(range(8), n)) for n in range(5) for _ in range(25)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    lists = {}
    for r in s.postings(spark.createDataFrame([(f,) for f in signed], "fp long")).collect():
        lists.setdefault((r["without"], r["bytes"]), set()).add(r["fp"] % 2**64)
    met = {(a, b) for own in lists.values() for a in own for b in own if a < b}
    shared = lambda a, b: sum((a ^ b) >> (8 * k) & 255 == 0 for k in range(8))
    assert met == {(a, b) for a in fps for b in fps if a < b and shared(a, b) >= 6} and len(lists) > 28
