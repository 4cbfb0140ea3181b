"""From detections to tracks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import geometry as g
from ..schema import BOX, FRAME
from ..sources.folder import partitions, written

OBJECT_OF: Mapping[str, str] = {"player": "players", "referee": "referees", "ball": "balls"}


def _lookup(names: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key]


def class_names(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """``class_name`` for ``class_id``, from the dimension ``classes(class_id, name)``; unknown ids: null. Classes are few
    and detections many: dealt by class, they would all go to a few tasks, so the classes are broadcast."""
    named = classes.select("class_id", F.col("name").alias("class_name"))
    return detections.drop("class_name").join(F.broadcast(named), "class_id", "left")


def class_ids(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """The inverse; a name that has several ids gets the largest."""
    ids = classes.groupBy(F.col("name").alias("class_name")).agg(F.max("class_id").alias("class_id"))
    return detections.drop("class_id").join(F.broadcast(ids), "class_name", "left")


def confident(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Detections surer than the threshold (strictly); a null confidence is none."""
    return detections.where(F.col("confidence") > params.min_confidence)


def relabelled(detections: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Goalkeepers are players."""
    names = names or {"goalkeeper": "player"}
    return detections.withColumn("class_name", F.coalesce(_lookup(names, F.col("class_name")), F.col("class_name")))


def with_object(detections: DataFrame, objects: Mapping[str, str] = OBJECT_OF) -> DataFrame:
    """``object`` by class; other classes are dropped. Balls have no identity: their track is 1. Other
    objects can be without a track id (see :func:`identified`)."""
    named = detections.withColumn("object", _lookup(objects, F.col("class_name"))).where("object is not null")
    ball = F.col("object") == "balls"
    return named.withColumn("track_id", F.when(ball, F.lit(1).cast("long")).otherwise(F.col("track_id")))


def keep_last(detections: DataFrame) -> DataFrame:
    """One row per match, frame, object and track: the box of the last detection, and the index of the
    first, which orders the tracks of a frame. Top-1 by aggregation: no sort, partial sums first."""
    box = F.max_by(F.struct(*BOX), "det_index").alias("box")
    found = detections.groupBy(*FRAME, "object", "track_id").agg(F.max("det_index").alias("det_index"), F.min("det_index").alias("first_index"), box)
    return found.select(*FRAME, "object", "track_id", "det_index", "first_index", *[F.col(f"box.{c}").alias(c) for c in BOX])


def keep_best(detections: DataFrame) -> DataFrame:
    """Like :func:`keep_last`, but the box is that of the surest detection (ties: the last)."""
    box = F.max_by(F.struct("det_index", *BOX), F.struct("confidence", "det_index")).alias("box")
    found = detections.groupBy(*FRAME, "object", "track_id").agg(F.min("det_index").alias("first_index"), box)
    return found.select(*FRAME, "object", "track_id", "box.det_index", "first_index", *[F.col(f"box.{c}").alias(c) for c in BOX])


def with_ordinal(detections: DataFrame) -> DataFrame:
    """``det_index`` within each frame, where the source has no order of its own: by class and box."""
    order = Window.partitionBy(*FRAME).orderBy("class_name", *BOX, "confidence", "track_id")
    return detections.withColumn("det_index", F.row_number().over(order).cast("long") - 1)


def build_tracks(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Tracks (:data:`touchline.schema.TRACKS`) from detections: sure ones, by object, last one of each key.
    Where any lacks a track id, ids are found by overlap first (:func:`identified`).

    Detections are dealt out by frame before they are reduced: hardly any repeat, so sums before the
    shuffle would save little, and the joins by frame that follow find the tracks in place. There are as many partitions
    as the size of the detections asks for.
    """
    seen = with_object(relabelled(confident(detections, params)))
    if not seen.where("track_id is null").isEmpty():
        seen = identified(seen, params)
    return keep_last(seen.repartition(partitions(detections), *FRAME))


def with_position(tracks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``pos_x, pos_y``: the foot of the box, or its centre for the objects of ``centre_classes``; null
    where the box is."""
    (cx, cy), (fx, fy) = g.centre(), g.foot()
    if not params.centre_classes:
        return tracks.withColumns({"pos_x": fx, "pos_y": fy})
    central = F.col("object").isin(*params.centre_classes)
    return tracks.withColumns({"pos_x": F.when(central, cx).otherwise(fx), "pos_y": F.when(central, cy).otherwise(fy)})


def together(*collections: DataFrame) -> DataFrame:
    """Collections of different objects as one table; columns that one lacks are null there."""
    out = collections[0]
    for x in collections[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def replaced(tracks: DataFrame, name: str, collection: DataFrame) -> DataFrame:
    """``collection`` in place of the rows of object ``name``."""
    return together(tracks.where(F.col("object") != name), collection)


def block_heads(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, object, block, frame_num, det_index, track_id, head_frame, head_index: chains (see :func:`chains`) as far as a
    block of ``block_frames`` frames shows them. A block sees the last frame before it as well: a head of that frame
    stands for one that the blocks before know.

    Rows are dealt by block once, and all steps find them in place. Frames are arrays, and a frame meets the one before
    it by a window; pairs that overlap enough are ranked from both sides. A block's rows are then an array in order,
    each with the place of the one that it continues, and places are followed twice as far in each round.
    """
    key, n = ["match_id", "object", "frame_num", "det_index"], params.block_frames
    track_id = F.col("track_id") if "track_id" in detections.columns else F.lit(None).cast("long").alias("track_id")
    rows = detections.select(*key, track_id, *BOX).where(" AND ".join(f"{c} IS NOT NULL" for c in key))
    own = F.floor(F.col("frame_num") / n)
    seen_by = F.when(F.pmod("frame_num", F.lit(n)) == n - 1, F.array(own, own + 1)).otherwise(F.array(own))
    block = ["match_id", "object", "block"]
    dealt = rows.withColumn("block", F.explode(seen_by)).repartition(partitions(detections), "match_id", "block")
    order = Window.partitionBy(*block).orderBy("frame_num")
    frames = dealt.groupBy(*block, "frame_num").agg(F.sort_array(F.collect_list(F.struct("det_index", "track_id", *BOX))).alias("now"))
    frames = frames.withColumn("now", F.filter("now", lambda x, i: (i == 0) | (x["det_index"] != F.get("now", i - 1)["det_index"])))
    start = F.coalesce(F.sum(F.size("now")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.when(F.lag("frame_num").over(order) == F.col("frame_num") - 1, F.lag("now").over(order))
    frames = frames.select(*block, "frame_num", "now", start.alias("start"), before.alias("before"))
    each = frames.select(*block, "frame_num", "start", "before", F.posexplode("now").alias("k", "d"))
    # A row meets nothing, and so stays, and every row of the frame before.
    met = each.select(*block, "frame_num", (F.col("start") + F.col("k")).alias("i"), "d", (F.col("start") - F.size("before")).alias("start"), F.posexplode(F.concat(F.array(F.lit(None)), F.coalesce("before", F.array()))).alias("k", "p"))
    one = F.coalesce(F.col("d.track_id") == F.col("p.track_id"), F.lit(True))
    overlap = g.iou([F.col(f"d.{c}") for c in BOX], [F.col(f"p.{c}") for c in BOX])
    pairs = met.select(*block, "frame_num", "i", "d.det_index", "d.track_id", F.when(F.col("p").isNotNull(), F.col("start") + F.col("k") - 1).alias("j"), one.alias("one"), overlap.alias("iou"))
    pairs = pairs.where(F.col("j").isNull() | (F.col("one") & (F.col("iou") >= params.min_iou)))
    of_now = F.row_number().over(Window.partitionBy(*block, "i").orderBy(F.col("j").isNull(), F.desc("iou"), "j"))
    of_before = F.row_number().over(Window.partitionBy(*block, "j").orderBy(F.desc("iou"), "i"))
    pairs = pairs.withColumn("of_now", of_now).withColumn("of_before", of_before)
    back = F.max(F.when((F.col("of_now") == 1) & (F.col("of_before") == 1), F.col("j")))
    found = pairs.groupBy(*block, "i", "frame_num", "det_index", "track_id").agg(back.alias("j"))
    places = found.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("i", "frame_num", "det_index", "track_id", F.coalesce("j", "i").alias("j")))).alias("rows"))
    longest = F.element_at("rows", -1)["frame_num"] - F.get("rows", F.lit(0))["frame_num"] + 1
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(longest)).cast("int"))
    heads = F.aggregate(rounds, F.transform("rows", lambda x: x["j"].cast("int")), lambda h, _: F.transform(h, lambda x: F.get(h, x)))
    named = places.withColumn("heads", heads).select(*block, F.posexplode("rows").alias("k", "d"), "rows", "heads")
    head = F.get("rows", F.get("heads", F.col("k")))
    named = named.select(*block, "d.frame_num", "d.det_index", "d.track_id", head["frame_num"].alias("head_frame"), head["det_index"].alias("head_index"))
    return named.where(F.col("frame_num") >= F.col("block") * n)


def chains(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, object, frame_num, det_index, track_id, head_frame, head_index: the first detection of each one's chain. Of
    several rows with one key the least counts, by track id (null first) and box; rows that lack a part of it have no chain.

    A detection continues the one of the frame before, of the same object, that it overlaps best, if
    that one's best is it, too, and the overlap is large enough; ties go to the smaller index, and two
    track ids that differ are never tied. There is no motion model, no memory of tracks lost, and no
    second pass for unsure detections.

    Heads are found within blocks of frames (:func:`block_heads`) and written. Chains that come over a block's edge take the
    heads of the frame before it: these few rows find theirs by pointer doubling. A round looks up the head of each row's head
    and takes twice the steps of the one before (rounds: the logarithm of the blocks of the longest chain).
    """
    key, n = ["match_id", "object", "frame_num", "det_index"], params.block_frames
    columns = [*key, "track_id", "head_frame", "head_index"]
    found = written(block_heads(detections, params), "heads")
    over = F.col("head_frame") < F.col("block") * n  # the edge before the block
    if found.where(over).isEmpty():
        return found.select(*columns)
    edge = found.where(F.pmod("frame_num", F.lit(n)) == n - 1)
    done, todo = edge.where(~over).select(*columns), edge.where(over).select(*columns)
    as_heads = lambda df, *also: df.select("match_id", "object", F.col("frame_num").alias("head_frame"), F.col("det_index").alias("head_index"), F.col("head_frame").alias("f"), F.col("head_index").alias("i"), *also)
    while not todo.isEmpty():
        known = as_heads(done, F.lit(True).alias("settled")).unionByName(as_heads(todo, F.lit(False).alias("settled")))
        step = todo.join(known, ["match_id", "object", "head_frame", "head_index"])
        step = written(step.select(*key, "track_id", F.col("f").alias("head_frame"), F.col("i").alias("head_index"), "settled"), "heads")
        done, todo = done.unionByName(step.where("settled").select(*columns)), step.where("not settled").select(*columns)
    settled = found.where(over).select(*columns).join(as_heads(done), ["match_id", "object", "head_frame", "head_index"])
    return found.where(~over).select(*columns).unionByName(settled.select(*key, "track_id", F.col("f").alias("head_frame"), F.col("i").alias("head_index")))


def numbered(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """match_id, object, frame_num, det_index, track_id of ``detections(match_id, frame_num, object, det_index, box)``: identity
    from frame to frame by overlap (:func:`chains`). Heads are numbered by match from 1, by object, frame and index."""
    found = chains(detections.drop("track_id"), params).drop("track_id")
    head = ["match_id", "object", "head_frame", "head_index"]
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("object", "head_frame", "head_index"))
    named = found.where("frame_num = head_frame and det_index = head_index").select(*head, number.cast("long").alias("track_id"))  # one row a track
    return found.join(named, head).drop("head_frame", "head_index")


def link(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """All columns of ``detections`` with the ``track_id`` of :func:`numbered`."""
    anonymous = detections.drop("track_id")
    return anonymous.join(numbered(anonymous, params), ["match_id", "object", "frame_num", "det_index"])


def identified(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``detections(match_id, frame_num, object, det_index, track_id, box)``, each with a ``track_id``.

    Given ids stand. Detections are chained by overlap (:func:`chains`); one without an id claims that of its chain's
    nearest detection before it that has one, else of the nearest after it. In a frame an id goes to one claim
    at most: to none if it is given there, else to that nearest to its source in frames (ties: smaller index).
    Who has no claim, or loses it, goes by a number of the chain's own, counted by match beyond the largest id
    given there, in order of object and first detection. Only objects of which a match lacks ids are chained.
    Rows with one key (match, object, frame, index) are one detection.
    """
    key = ["match_id", "object", "frame_num", "det_index"]
    head = ["match_id", "object", "head_frame", "head_index"]
    detections = written(detections, "detections")  # read four times
    lacking = written(detections.where("track_id is null").select("match_id", "object").distinct(), "lacking")  # its size is known then
    chained = chains(detections.join(lacking, ["match_id", "object"], "left_semi"), params)
    chain = Window.partitionBy(*head).orderBy("frame_num")
    source = F.when(F.col("track_id").isNotNull(), F.struct("frame_num", "track_id"))
    earlier = F.last(source, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(source, ignorenulls=True).over(chain.rowsBetween(1, Window.unboundedFollowing))
    claims = chained.withColumn("source", F.coalesce(source, earlier, later))
    claims = claims.select(*key, *head[2:], "track_id", F.col("source.track_id").alias("claim"), F.abs(F.col("frame_num") - F.col("source.frame_num")).alias("away"))
    rivals = Window.partitionBy("match_id", "object", "frame_num", "claim").orderBy(F.col("track_id").isNull(), "away", "det_index")
    wins = F.col("claim").isNotNull() & (F.row_number().over(rivals) == 1)
    settled = written(claims.withColumn("found", F.coalesce("track_id", F.when(wins, F.col("claim")))).select(*key, *head[2:], "found"), "claims")
    largest = detections.groupBy("match_id").agg(F.coalesce(F.max("track_id"), F.lit(0)).alias("largest"))
    order = Window.partitionBy("match_id").orderBy("object", "head_frame", "head_index")
    own = settled.where("found is null").select(*head).distinct().withColumn("number", F.row_number().over(order)).join(largest, "match_id")
    named = settled.join(own.select(*head, (F.col("number") + F.col("largest")).alias("own")), head, "left")
    named = named.select(*key, F.coalesce("found", "own").alias("named"))
    both = detections.join(named, key, "left")
    return both.withColumn("track_id", F.coalesce("track_id", "named")).select(*detections.columns)
