"""Frame-by-frame loops as Structured Streaming operators.

Event time ``ts`` is the match's start plus frame_num / frame_rate seconds. Rows later than the
watermark are dropped. What lies behind the watermark at the end of input stays unemitted.

The operators with state of their own (distance, possession, first team) need the RocksDB state store: see
:func:`touchline.streaming.replay.with_rocksdb`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import DEFAULTS, Params
from ..functions import geometry as g
from ..schema import TRACK

EPOCH = dt.datetime(2024, 1, 1)
NO_TEAM = -(1 << 31)  #: in place of null


def with_event_time(df: DataFrame, params: Params = DEFAULTS, start: dt.datetime = EPOCH) -> DataFrame:
    """``ts`` by frame; microseconds, so that frames of any rate keep apart."""
    step = round(1_000_000 / params.frame_rate)
    base = int(start.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    return df.withColumn("ts", F.timestamp_micros(F.lit(base) + F.col("frame_num") * step))


def stream_windows(world: DataFrame, counts: DataFrame, delay: str = "1 second", params: Params = DEFAULTS) -> DataFrame:
    """match_id, object, track_id, start, metres, speed_kmh of all windows, in append mode.

    ``world`` is a stream with ts and world positions; ``counts(match_id, n_frames)`` a static table, by
    which the match's last frame ends its short window (a match without a row has full windows only). A
    frame that begins a window also ends the one before: a copy of it goes there, a microsecond earlier.
    A tumbling window of five frames then sees both ends.
    """
    n, step = params.window_frames, round(1_000_000 / params.frame_rate)
    begins, final = F.col("frame_num") % n == 0, F.col("n_frames") - 1
    rows = world.where(~F.col("object").isin(*params.no_speed) & F.col("world_x").isNotNull())
    rows = rows.join(counts.select("match_id", "n_frames"), "match_id", "left").where(begins | (F.col("frame_num") == final))
    spot = F.struct("frame_num", F.col("world_x").alias("x"), F.col("world_y").alias("y"), final.alias("final"))
    earlier = F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")
    own = F.when(begins, F.array(F.col("ts"), earlier)).otherwise(F.array("ts"))
    both = rows.select(*TRACK, spot.alias("at"), F.explode(own).alias("ts")).withWatermark("ts", delay)
    length = f"{n * step} microseconds"
    ends = both.groupBy(F.window("ts", length), *TRACK).agg(F.min_by("at", "at.frame_num").alias("a"), F.max_by("at", "at.frame_num").alias("z"))
    a, z = F.col("a.frame_num"), F.col("z.frame_num")
    full = ends.where((a % n == 0) & (z > a) & ((z == a + n) | (z == F.col("a.final"))))
    metres = g.distance(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y"))
    found = full.select("window", *TRACK, a.alias("start"), (z - a).alias("frames"), metres.alias("metres"))
    return found.select(*TRACK, "start", "metres", g.kmh(F.col("metres"), F.col("frames"), params.frame_rate).alias("speed_kmh"))


def _with_end(rows: DataFrame, counts: DataFrame | None, params: Params) -> DataFrame:
    """``ends``: event time of the last frame of the row's match, in milliseconds; null where that isn't known."""
    if counts is None:
        return rows.withColumn("ends", F.lit(None).cast("long"))
    last = with_event_time(counts.select("match_id", (F.col("n_frames") - 1).alias("frame_num")), params)
    return rows.join(last.select("match_id", (F.unix_micros("ts") / 1000).cast("long").alias("ends")), "match_id", "left")


class _Keyed(StatefulProcessor):
    """A key's state until its match has ended. A row of the match that comes after that is later than the
    watermark, and goes, so nothing of the state is missed."""

    def _timely(self, batches: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        """The rows that aren't late, with ``time`` in milliseconds. Spark's own filter has the watermark of the
        batch before; state goes by this batch's."""
        passed = timers.getCurrentWatermarkInMs()
        for pdf in batches:
            pdf["time"] = pdf["ts"].astype("datetime64[us]").astype("int64") // 1000
            timely = pdf[pdf["time"] >= passed]
            if len(timely):
                yield timely

    def _ends(self, pdf: pd.DataFrame) -> int | None:
        ends = pdf["ends"].iloc[0]
        return None if pd.isna(ends) else int(ends)


class _Distance(_Keyed):
    """Keyed by match: calling Python and its state costs far more than adding up, so a match's tracks share a call."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getListState("totals", "object string, track_id long, metres double, last long")
        self.ends = handle.getValueState("ends", "ends long")

    def _rows(self, key: tuple, totals: dict, final: bool) -> pd.DataFrame:
        out = [(*key, *track, *total, final) for track, total in totals.items()]
        return pd.DataFrame(out, columns=[*TRACK, "total_m", "last_start", "final"]).astype({"track_id": "Int64"})

    def _known(self) -> dict:
        return {(o, t): (m, last) for o, t, m, last in self.totals.get()} if self.totals.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        ends, added = None, {}
        for pdf in self._timely(rows, timerValues):
            ends = self._ends(pdf)
            found = pdf.groupby(["object", "track_id"], dropna=False).agg({"metres": "sum", "start": "max"})
            for (o, t), m, last in zip(found.index, found["metres"], found["start"], strict=True):
                track = (None if pd.isna(o) else o), (None if pd.isna(t) else int(t))
                before = added.get(track, (0.0, -1))
                added[track] = before[0] + float(m), max(before[1], int(last))
        if not added:
            return
        known, changed = self._known(), {}
        for track, (m, last) in added.items():
            before = known.get(track, (0.0, -1))
            if (total := (before[0] + m, max(before[1], last))) != before:
                changed[track] = total
        if ends is not None and not self.ends.exists():
            self.ends.update((ends,))
            self.handle.registerTimer(ends + 1)
        if changed:
            self.totals.put([(*track, *total) for track, total in (known | changed).items()])
            yield self._rows(key, changed, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if totals := self._known():
            yield self._rows(key, totals, True)
        self.totals.clear()
        self.ends.clear()


def stream_distance(window_rows: DataFrame, counts: DataFrame | None = None, delay: str = "1 second", params: Params = DEFAULTS) -> DataFrame:
    """match_id, object, track_id, total_m, last_start, final over a stream of windows (match_id, object, track_id,
    start, metres, ts), in append mode: after each batch the running metres of every track that got windows,
    not final; and once its match has ended, the track's total, final.

    State of a match: its tracks' sums, until the match's last frame (by ``counts(match_id, n_frames)``) is behind the
    watermark. Without that row nothing is final, and the sums stay.
    """
    out = "match_id long, object string, track_id long, total_m double, last_start long, final boolean"
    timed = _with_end(window_rows.select(*TRACK, "start", "metres", "ts"), counts, params).withWatermark("ts", delay)
    return timed.groupBy("match_id").transformWithStateInPandas(_Distance(), out, "append", "EventTime")


class _Possession(_Keyed):
    """Frames that wait are kept as bytes, one value a batch (time, frame and team as longs): rows of state cost far more
    than the frames are worth."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "team int, n_1 long, n_2 long, ends long")
        self.waiting = handle.getListState("waiting", "frames binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found, ends = [], None
        for pdf in self._timely(rows, timerValues):
            ends = self._ends(pdf)
            found.append(np.column_stack([pdf["time"], pdf["frame_num"], pdf["team"].fillna(NO_TEAM)]).astype("int64"))
        if found:
            if not self.past.exists():
                self.past.update((None, 0, 0, ends))
            frames = np.concatenate(found)
            self.waiting.appendValue((frames.tobytes(),))
            self.handle.registerTimer(int(frames[:, 0].min()) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        frames = np.concatenate([np.frombuffer(x[0], "int64").reshape(-1, 3) for x in self.waiting.get()])
        frames = frames[np.lexsort((np.where(frames[:, 2] == NO_TEAM, 0, frames[:, 2]), frames[:, 1], frames[:, 0]))]
        done = int(np.searchsorted(frames[:, 0], passed))
        team, n_1, n_2, ends = self.past.get()
        if done:
            teams = np.concatenate([[NO_TEAM if team is None else team], frames[:done, 2]])
            teams = teams[np.maximum.accumulate(np.where(teams == NO_TEAM, 0, np.arange(done + 1)))][1:]
            ones, twos = n_1 + np.cumsum(teams == 1), n_2 + np.cumsum(teams == 2)
            total = np.where(ones + twos, ones + twos, np.nan)
            own = pd.array(teams, dtype="Int64")
            own[teams == NO_TEAM] = pd.NA
            yield pd.DataFrame({"match_id": key[0], "frame_num": frames[:done, 1], "team": own.astype("Int32"), "share_1": ones / total, "share_2": twos / total})
            team, n_1, n_2 = None if teams[-1] == NO_TEAM else int(teams[-1]), int(ones[-1]), int(twos[-1])
        self.past.update((team, n_1, n_2, ends))
        if done < len(frames):
            self.waiting.put([(frames[done:].tobytes(),)])
            self.handle.registerTimer(int(frames[done, 0]) + 1)
        else:
            self.waiting.clear()
            if ends is not None and ends < passed:
                self.past.clear()


def stream_possession(assigned: DataFrame, counts: DataFrame | None = None, delay: str = "1 second", params: Params = DEFAULTS) -> DataFrame:
    """match_id, frame_num, team, share_1, share_2 of every frame of a stream (match_id, frame_num, team or
    null, ts), in append mode: teams carried over frames without, and shares up to each frame. A match can pause
    for any time.

    State of a match: the last team and two counters, until its last frame (by ``counts(match_id, n_frames)``) is
    out; without that row these stay. And the frames that the watermark hasn't passed, which wait for earlier
    ones: a batch appends its own, and those that have passed go.
    """
    out = "match_id long, frame_num long, team int, share_1 double, share_2 double"
    timed = _with_end(assigned.select("match_id", "frame_num", "team", "ts"), counts, params).withWatermark("ts", delay)
    return timed.groupBy("match_id").transformWithStateInPandas(_Possession(), out, "append", "EventTime")


class _FirstTeam(_Keyed):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "frame long, team int, time long, ends long, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get() if self.first.exists() else None
        if known is None or not known[4]:
            for pdf in self._timely(rows, timerValues):
                row = pdf.sort_values(["frame_num", "team"]).iloc[0]
                if known is None or row["frame_num"] < known[0]:
                    known = (int(row["frame_num"]), int(row["team"]), int(row["time"]), self._ends(pdf), False)
            if known is not None:
                self.first.update(known)
                self.handle.registerTimer(known[2] + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.first.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        frame, team, time, ends, done = self.first.get()
        if not done and time < passed:
            yield pd.DataFrame([(*key, team, frame)], columns=["match_id", "track_id", "team", "frame_num"])
            done = True
            self.first.update((frame, team, time, ends, True))
        if done and ends is not None:
            if ends < passed:
                self.first.clear()
            else:
                self.handle.registerTimer(ends + 1)


def stream_first_team(seen: DataFrame, counts: DataFrame | None = None, delay: str = "1 second", params: Params = DEFAULTS) -> DataFrame:
    """match_id, track_id, team, frame_num of each player's earliest frame in a stream (match_id, track_id,
    frame_num, team, ts), once it can't be preceded any more; later rows of the player change nothing, however
    long it was away. Two rows of that frame: the smaller team.

    State of a player: one small row, until the match's last frame (by ``counts(match_id, n_frames)``) is behind
    the watermark; without that row it stays.
    """
    out = "match_id long, track_id long, team int, frame_num long"
    timed = _with_end(seen.select("match_id", "track_id", "frame_num", "team", "ts"), counts, params).withWatermark("ts", delay)
    return timed.groupBy("match_id", "track_id").transformWithStateInPandas(_FirstTeam(), out, "append", "EventTime")
