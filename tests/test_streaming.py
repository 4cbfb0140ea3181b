"""Streams in several batches: late rows, long pauses, state that goes when a match ends."""

import pytest

from touchline.sources.folder import shared_folder
from touchline.streaming import operators as streams
from touchline.streaming.replay import replay, with_rocksdb

ASSIGNED = "match_id long, frame_num long, team int"
SEEN = "match_id long, track_id long, frame_num long, team int"
WINDOWS = "match_id long, object string, track_id long, start long, metres double"


@pytest.fixture
def batches(spark):
    """Runs the operator over one batch after another; its rows, and the rows of state after each batch."""

    def run(operator, schema, *found):
        folder = shared_folder(with_rocksdb(spark), "batches")
        for batch in found:
            rows = spark.createDataFrame(batch, schema)
            rows = rows if "frame_num" in rows.columns else rows.withColumn("frame_num", rows["start"])
            timed = streams.with_event_time(rows)
            timed.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = operator(source)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()], state

    return run


@pytest.fixture
def counts(spark):
    return spark.createDataFrame([(1, 6), (2, 900_000), (3, 900_000)], "match_id long, n_frames long")


def test_possession_goes_on_after_a_pause(batches, counts):
    first = [(3, f, 1 if f < 4 else None) for f in (2, 0, 3, 1, 4)]
    found, _ = batches(lambda s: streams.stream_possession(s, counts), ASSIGNED, first, [(2, 500_000, 2)], [(3, 3, 2), (3, 600_000, 2), (3, 600_001, None)], [(2, 899_999, 1)])
    assert sorted(r for r in found if r[0] == 3) == [(3, f, 1, 1.0, 0.0) for f in range(5)] + [(3, 600_000, 2, 5 / 6, 1 / 6), (3, 600_001, 2, 5 / 7, 2 / 7)]


def test_possession_waits_for_frames_out_of_order(batches, counts):
    found, _ = batches(lambda s: streams.stream_possession(s, counts, delay="2 seconds"), ASSIGNED, [(2, 40, 1), (2, 10, 2)], [(2, 30, 2), (2, 50, None)], [(2, 500_000, 1)], [(2, 800_000, 1)])
    assert sorted(found)[:4] == [(2, 10, 2, 0.0, 1.0), (2, 30, 2, 0.0, 1.0), (2, 40, 1, 1 / 3, 2 / 3), (2, 50, 1, 0.5, 0.5)]


def test_state_of_ended_matches_goes(batches, counts):
    match = [(1, f, 1) for f in range(6)]
    found, state = batches(lambda s: streams.stream_possession(s, counts), ASSIGNED, match, [(2, 500_000, 2)], [(1, 5, 2), (2, 500_100, 2)])
    assert sorted(r for r in found if r[0] == 1) == [(1, f, 1, 1.0, 0.0) for f in range(6)]  # nothing of the late row
    _, kept = batches(streams.stream_possession, ASSIGNED, match, [(2, 500_000, 2)], [(1, 5, 2), (2, 500_100, 2)])
    assert state[-1] < kept[-1] and state[-1] < max(state)  # a list counts as a row


def test_a_player_is_first_seen_once(batches, counts):
    early = [(1, 4, 3, 2), (1, 4, 2, 2), (1, 4, 2, 1), (2, 4, 1, 1)]
    found, state = batches(lambda s: streams.stream_first_team(s, counts), SEEN, early, [(2, 9, 500_000, 2)], [(2, 4, 600_000, 2), (1, 4, 1, 2)], [(2, 9, 700_000, 1)])
    assert sorted(found) == [(1, 4, 1, 2), (2, 4, 1, 1), (2, 9, 2, 500_000)]
    assert state[-1] < max(state)  # that of match 1, which has ended


def test_distance_runs_and_is_final_once(batches, counts):
    first = [(1, "players", 7, 0, 2.5), (2, "players", 7, 0, 1.0)]
    found, state = batches(lambda s: streams.stream_distance(s, counts), WINDOWS, first, [(1, "players", 7, 5, 0.5), (1, "referees", 7, 0, 4.0)], [(2, "players", 7, 500_000, 2.0)], [(1, "players", 7, 0, 9.0), (2, "players", 7, 500_005, 3.0)])
    assert sorted(r for r in found if r[0] == 1) == [(1, "players", 7, 2.5, 0, False), (1, "players", 7, 3.0, 5, False), (1, "players", 7, 3.0, 5, True), (1, "referees", 7, 4.0, 0, False), (1, "referees", 7, 4.0, 0, True)]
    assert sorted(r[3] for r in found if r[0] == 2) == [1.0, 3.0, 6.0]
    assert state[-1] < max(state)


def test_a_match_has_one_state_of_distances(batches, counts):
    """Keys, and calls of Python, are as many as matches, and not as tracks."""
    first = [(1, "players", t, 0, 1.0 * t) for t in range(30)]
    found, state = batches(lambda s: streams.stream_distance(s, counts), WINDOWS, first, [(2, "players", 7, 500_000, 2.0)], [(2, "players", 7, 500_005, 2.0)])
    assert sorted(r for r in found if r[0] == 1) == sorted((1, "players", t, 1.0 * t, 0, final) for t in range(30) for final in (False, True))
    assert max(state) < 30


def test_frames_of_a_batch_wait_as_one_value():
    import pandas as pd

    class State:
        values = []
        exists = lambda self: False
        update = appendList = lambda self, x: None
        registerTimer = getCurrentWatermarkInMs = lambda self, *x: 0
        appendValue = lambda self, x: self.values.append(x)

    keyed, state = streams._Possession(), State()
    keyed.handle = keyed.past = keyed.waiting = state
    pdf = pd.DataFrame({"ts": pd.to_datetime(range(750), unit="s"), "frame_num": range(750), "team": [1.0, None, 2.0] * 250, "ends": 9})
    assert list(keyed.handleInputRows((1,), iter([pdf]), state)) == [] and len(state.values) == 1


def test_replay_makes_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def note(parts):
        for pdf in parts:
            made.add(len(pdf))
            yield pdf

    rows = streams.with_event_time(spark.range(500).selectExpr("id % 3 AS match_id", "id AS frame_num", "CAST(1 AS INT) AS team").mapInPandas(note, ASSIGNED))
    assert replay(rows, {"match_id": -1, "frame_num": 0}, streams.stream_possession).count() == 500 and made.value == 500
