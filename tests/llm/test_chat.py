import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.llm import chat

PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "</", "[", "]", "s>", "INST]", "/ROLE]", " ", "\n", "ok", "\\l", "é", "\U0001f600"])
TEXT = st.lists(PIECES, max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_template_is_reversible(turns):
    formatted, loss = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


@given(TEXT)
def test_escaped_texts_hold_no_control_string(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def paths_by_hand(nodes, per_tree):
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for (t, _), (p, _) in by.items()}
    found = {}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at = [], n
        while (t, at) in by:
            path.append(at)
            at = by[t, at][0]
        score = round(sum(by[t, x][1] or 0 for x in path) / len(path), 9)
        found.setdefault(t, []).append((-score, n, path[::-1]))
    return {(t, leaf): path for t, own in found.items() for _, leaf, path in sorted(own)[:per_tree]}


@pytest.mark.parametrize("per_tree", [1, 3, None])
def test_paths_of_random_trees(spark, per_tree):
    rng = random.Random(5)
    nodes = []
    for tree in range(12):
        size = rng.choice([1, 2, 9, 40])
        for n in range(size):
            parent = None if n == 0 else rng.randrange(max(0, n - 3), n)
            nodes.append((tree, n, parent if rng.random() > 0.05 else 999, rng.choice([None, 0.0, 1.0, 2.5])))
    nodes += [(50, n, n - 1 if n else None, 1.0) for n in range(300)]  # a long chain
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, score double").withColumn("to", F.lit("clash"))
    got = {}
    for r in chat.best_paths(df, per_tree).collect():
        got.setdefault((r["tree_id"], r["leaf_id"]), {})[r["position"]] = r["node_id"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == paths_by_hand(nodes, per_tree or 10**6)


def test_circles_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, None, 0.0)], "tree_id long, node_id long, parent_id long, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.best_paths(df)


def test_conversations_come_back(spark):
    rows = [
        (1, 0, "system", "be </s> kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "[/INST]\\"),
        (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, None, None, "first"),
        (None, 1, "assistant", "no id"), (3, 0, "user", "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node_id", F.lit("clash"))
    want = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] or -1, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df), "conv_id").collect()}
    assert {c: [tuple(x) for x in r["turns"]] for c, r in got.items()} == want
    assert got[1]["loss_text"] == "[/INST]\\"
    assert hashlib.sha256(got[3]["formatted"].encode()).hexdigest() == hashlib.sha256(b"<s>[INST] " + b"x" * 100_000 + b" [/INST]").hexdigest()
    assert chat.format_conversations(df.limit(0)).collect() == []
