"""Reply trees to chat transcripts: paths by self-joins, ranking, and a reversible template."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Control strings of the template (fixed values). No end of one begins another.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE ", "[/ROLE]")
LETTER = {"<": "l", "[": "b", "\\": "\\", "\n": "n", "]": "e"}
CHARACTER = {v: k for k, v in LETTER.items()}
_UNSAFE = re.compile("|".join(["\\\\", *(re.escape(x[0]) + f"(?={re.escape(x[1:])})" for x in CONTROL)]))
_UNSAFE_ROLE = re.compile(r"[\\\[\]<\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE (?P<role>[^\]]*)\] (?P<other>.*?) \[/ROLE\]|(?P<assistant>.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left; a backslash or the first character of one becomes backslash and letter."""
    return _UNSAFE.sub(lambda m: "\\" + LETTER[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: CHARACTER[m[1]], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as a string, and the spans of characters that the loss covers: the texts of
    the assistant, one span each (empty texts too)."""
    parts, at, loss = ["<s>"], 3, []
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            before, after = "", "</s>"
            loss.append((at, at + len(body)))
        elif role == "user":
            before, after = "[INST] ", " [/INST]"
        else:
            before, after = "[ROLE " + _UNSAFE_ROLE.sub(lambda m: "\\" + LETTER[m[0]], role) + "] ", " [/ROLE]"
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of :func:`format_turns`."""
    turns = []
    for m in _TURN.finditer(formatted, len("<s>")):
        kind = m.lastgroup if m.lastgroup != "other" else unescape(m["role"])
        turns.append((kind, unescape(m[m.lastgroup])))
    return turns


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables of the ancestors 1, 2, 4, ... steps up: tree_id, node_id, to, steps and the sum of the
    scores passed, that of ``to`` included.

    Each round joins the last table with itself, so a path of a thousand turns takes ten. Rows carry
    ids, counts and sums, no texts; a table has a row for each node that has such an ancestor.
    """
    largest = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    parents = nodes.select("tree_id", F.col("node_id").alias("to"), F.col("score").alias("sum"))
    children = nodes.select("tree_id", "node_id", F.col("parent_id").alias("to"))
    up = children.join(parents, ["tree_id", "to"]).select("tree_id", "node_id", "to", F.lit(1).cast("long").alias("steps"), "sum")
    up, tables = common.written(up, "ancestors"), []
    while not up.isEmpty():
        if 2 ** len(tables) >= largest:
            raise ValueError("replies go round in a circle")
        tables.append(up)
        further = up.select("tree_id", F.col("node_id").alias("to"), F.col("to").alias("end"), F.col("steps").alias("s"), F.col("sum").alias("m"))
        up = up.join(further, ["tree_id", "to"]).select("tree_id", "node_id", F.col("end").alias("to"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("sum") + F.col("m")).alias("sum"))
        up = common.written(up, "ancestors")
    return tables


def _branches(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """tree_id, leaf_id, length and path_score of every branch: from the largest step down, a leaf goes
    up wherever it can, which are the binary digits of its depth."""
    inner = nodes.select("tree_id", F.col("parent_id").alias("node_id")).where("node_id is not null")
    found = nodes.join(inner, ["tree_id", "node_id"], "left_anti")
    found = found.select("tree_id", F.col("node_id").alias("leaf_id"), F.col("node_id").alias("top"), F.lit(1).cast("long").alias("length"), F.col("score").alias("sum"))
    for table in reversed(tables):
        step = table.select("tree_id", F.col("node_id").alias("top"), "to", "steps", F.col("sum").alias("passed"))
        found = found.join(step, ["tree_id", "top"], "left").select(
            "tree_id",
            "leaf_id",
            F.coalesce("to", "top").alias("top"),
            (F.col("length") + F.coalesce("steps", F.lit(0))).alias("length"),
            (F.col("sum") + F.coalesce("passed", F.lit(0.0))).alias("sum"),
        )
    return found.select("tree_id", "leaf_id", "length", F.round(F.col("sum") / F.col("length"), 9).alias("path_score"))


def _first(branches: DataFrame, per_tree: int) -> DataFrame:
    """The best branches of each tree, ranked; of a tree's salted parts first, so that a tree with most
    of the branches isn't sorted by one task."""
    best = (F.desc("path_score"), F.asc("leaf_id"))
    part = Window.partitionBy("tree_id", "salt").orderBy(*best)
    salted = branches.withColumn("salt", F.pmod(F.xxhash64("leaf_id"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= per_tree).drop("salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(*best))).where(F.col("rank") <= per_tree)


def best_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """tree_id, leaf_id, rank, path_score, position and node_id of every node on the chosen paths of
    ``nodes(tree_id, node_id, parent_id, score)``; position 0 is the root.

    Every root-to-leaf path is a branch, scored by the mean of its nodes' scores (null counts as 0),
    ties by smaller leaf_id; the best ``per_tree`` of each tree are kept, or all (rank null). Nodes
    without a known parent are roots. (tree_id, node_id) must be unique; rows with a null in it are
    no nodes. A circle of replies raises an error. An empty table has no paths.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    nodes = common.written(nodes.where("tree_id is not null and node_id is not null").select("tree_id", "node_id", "parent_id", score), "nodes")
    tables = _ancestors(nodes)
    chosen = _branches(nodes, tables)
    chosen = _first(chosen, per_tree) if per_tree else chosen.withColumn("rank", F.lit(None).cast("int"))
    paths = common.written(chosen.withColumns({"node_id": F.col("leaf_id"), "up": F.lit(0).cast("long")}), "paths")
    for table in tables:  # steps up from the leaf that are listed: 0; 0 and 1; 0 to 3; ...
        step = table.select("tree_id", "node_id", "to", "steps")
        further = paths.join(step, ["tree_id", "node_id"]).withColumns({"node_id": F.col("to"), "up": F.col("up") + F.col("steps")}).drop("to", "steps")
        paths = common.written(paths.unionByName(further), "paths")
    return paths.select("tree_id", "leaf_id", "rank", "path_score", (F.col("length") - 1 - F.col("up")).alias("position"), "node_id")


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """tree_id, leaf_id, rank, path_score, n_turns, formatted and loss_spans: one conversation for each
    path, from ``texts(tree_id, node_id, role, text)``; null roles and texts are empty.

    Columns of ``texts`` other than these are not read. A node that ``texts`` lacks is left out of its path, one that it has
    twice is said twice, in order of role and text. A null rank is a rank. No paths, no conversations.
    """
    rows = paths.join(texts.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    turn = F.struct("position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("tree_id", "leaf_id", "rank", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.drop("turns").schema)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [format_turns([(t["role"], t["text"]) for t in x]) for x in batch.column("turns").to_pylist()]
            out = batch.drop_columns(["turns"])
            out = out.append_column("n_turns", pc.list_value_length(batch.column("turns")).cast(pa.int64()))
            out = out.append_column("formatted", pa.array([x for x, _ in found], pa.string()))
            yield out.append_column("loss_spans", pa.array([[{"start": a, "end": b} for a, b in x] for _, x in found], span))

    return whole.mapInArrow(task, fields + ", n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """``key``, turns (role, text), loss_text and formatted, parsed from the formatted strings and their spans: a
    row for each of ``formatted``, whatever its other columns, null and repeated keys included. A conversation without
    turns is an empty string and gives an empty list. The strings are those of :func:`format_paths`: not null.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, spans = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse_turns(x)] for x in texts]
            loss = ["".join(unescape(x[s["start"] : s["end"]]) for s in own) for x, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(turns, turn), pa.array(loss, pa.string()), batch.column("formatted")], [key, "turns", "loss_text", "formatted"])

    kind = dict(formatted.dtypes)[key]
    return formatted.select(key, "formatted", "loss_spans").mapInArrow(task, f"{key} {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted string")


def chains(messages: DataFrame) -> DataFrame:
    """Trees without branches from ``messages(conv_id, turn, role, text)``: a turn replies to the one
    before it; turns that repeat follow each other by role and text. A null conv_id is a conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    tree: Column = F.struct("conv_id")
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select(tree.alias("tree_id"), "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted and loss_spans of every conversation, by way of its reply tree."""
    trees = common.written(chains(messages), "trees")
    done = format_paths(best_paths(trees), trees)
    return done.select(F.col("tree_id.conv_id").alias("conv_id"), "n_turns", "formatted", "loss_spans")
