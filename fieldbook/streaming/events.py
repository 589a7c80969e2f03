"""Streams: events delivered at least once into a keyed snapshot, and a rate limiter with bounded state."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldbook.operators.keyed import KeyedStore

COLUMNS = ("event_id", "cents", "status", "first_at", "last_at")


def fold_events(rows: DataFrame) -> DataFrame:
    """One row per event_id: the first delivery's amount, the last one's status; `first_at` and `last_at` tell which those are."""
    return rows.groupBy("event_id").agg(F.min_by("cents", "first_at").alias("cents"), F.max_by("status", "last_at").alias("status"),
                                        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def delivered(deliveries: DataFrame) -> DataFrame:
    """deliveries (event_id, cents, status, at) as rows of the snapshot."""
    return deliveries.select("event_id", "cents", "status", F.col("at").alias("first_at"), F.col("at").alias("last_at"))


def event_store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedStore:
    return KeyedStore(spark, path, ["event_id"], fold_events, buckets)


def upsert_stream(deliveries: DataFrame, path: str, buckets: int = 64):
    """A stream writer that merges each micro-batch into the snapshot under `path`; a micro-batch that is repeated changes nothing."""
    store = event_store(deliveries.sparkSession, path, buckets)
    return delivered(deliveries).writeStream.foreachBatch(lambda batch, number: store.apply(batch, number))


#: Most rows of a key that wait in one piece of its state; a fuller one is cut by time into pieces that have a part in SPANS free.
PIECE = 128
SPANS = 4
#: The piece of a key's earliest rows; the others are known by the time at which they begin.
FIRST = (-(2**63),)


class Limiter(StatefulProcessor):
    """Accepts an attempt if fewer than `most` were accepted in the window before it.

    Attempts come in any order, so they wait until the watermark has passed the newest that came with them; then a timer,
    one for each micro-batch of a key, has all that the watermark has passed decided in order.  The state of a key is the
    accepted times of the window, `most` at most, and its waiting pieces, of which the first also says where the others
    begin: a key of few rows is read and written once a micro-batch, however far apart they are.  No more than a piece,
    or a frame of new rows, is in memory.
    """

    def __init__(self, seconds: int, most: int):
        self.width, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "at long")
        self.waiting = handle.getMapState("waiting", "begins long", "at array<long>, id array<long>, starts array<long>")

    def _get(self, begins: tuple[int]) -> tuple[list[tuple[int, int]], list[int]]:
        at, ids, starts = self.waiting.getValue(begins)
        return list(zip(at, ids)), list(starts)

    def _put(self, begins: tuple[int], rows: list[tuple[int, int]], starts: list[int]) -> None:
        self.waiting.updateValue(begins, ([t for t, _ in rows], [i for _, i in rows], starts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, starts = self._get(FIRST) if self.waiting.containsKey(FIRST) else ([], [])
        newest = None
        for frame in rows:
            fresh: dict[int, list[tuple[int, int]]] = {}
            for row in zip(frame["micros"].tolist(), frame["id"].tolist()):
                fresh.setdefault(bisect_right(starts, row[0]), []).append(row)
                newest = row[0] if newest is None else max(newest, row[0])
            for k in sorted(fresh, reverse=True):  # the last first, as a cut puts starts behind its piece
                piece = [*(self._get((starts[k - 1],))[0] if k else first), *fresh[k]]
                parts = [piece]
                if len(piece) > PIECE:
                    piece.sort()
                    at, step = [t for t, _ in piece], PIECE - PIECE // SPANS
                    cuts = sorted({bisect_left(at, at[i]) for i in range(step, len(piece), step)} - {0})  # rows of one time stay together
                    parts = [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])]
                begins = [starts[k - 1] if k else FIRST[0], *[part[0][0] for part in parts[1:]]]
                if not k:
                    first = parts[0]
                for start, part in list(zip(begins, parts))[0 if k else 1 :]:
                    self._put((start,), part, [])
                starts[k:k] = begins[1:]
        if newest is not None:
            self._put(FIRST, first, starts)
            self.handle.registerTimer(newest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.containsKey(FIRST):
            return
        rows, starts = self._get(FIRST)
        live = [r[0] for r in self.live.get()] if self.live.exists() else []
        passed = expiredTimerInfo.getExpiryTimeInMs()
        if timerValues is not None:
            passed = max(passed, timerValues.getCurrentWatermarkInMs())
        while True:
            rows.sort()
            n = bisect_left(rows, (passed * 1000,))
            accepted = []
            for t, _ in rows[:n]:
                live = [x for x in live if x > t - self.width]
                accepted.append(len(live) < self.most)
                if accepted[-1]:
                    live.append(t)
            if n:
                yield pd.DataFrame({"id": [i for _, i in rows[:n]], "key": key[0], "accepted": accepted})
            rows = rows[n:]
            if rows or not starts:
                break
            begins = (starts.pop(0),)
            rows = self._get(begins)[0]
            self.waiting.removeKey(begins)
        if rows:
            self._put(FIRST, rows, starts)
        else:
            self.waiting.removeKey(FIRST)
        self.live.put([(t,) for t in live])

    def close(self) -> None:
        pass


@contextmanager
def stateful(spark: SparkSession):
    """The state store that this kind of state needs; a stream keeps the one it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def limited(attempts: DataFrame, seconds: int, most: int, late: str) -> DataFrame:
    """A stream of attempts (id long, key long, ts) with `accepted`, for attempts that are at most `late` behind the newest.

    Attempts without a key or a time are left out.  An attempt is decided when the watermark passes the newest of its key's
    that came in its micro-batch.
    """
    rows = attempts.withWatermark("ts", late).where("ts is not null and key is not null").select("key", "id", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(seconds, most), "id long, key long, accepted boolean", "Append", "EventTime")
