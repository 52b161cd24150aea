"""Structured Streaming forms: each equals its batch form over the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.analytics import percent, topic_breakdown, topic_mastery
from lectern.operators.review import review_key


def ingest_pages(pages: DataFrame, table: str, checkpoint: str):
    """T1. Appends pages with new (document, page, hash) to a Parquet table; what came before is skipped, in this run or an earlier one of the same checkpoint.

    What came before is keyed state of the stream, so a batch reads its own rows and their keys, however large the table has become (for
    very many keys, set the RocksDB state store). Each batch has a folder of its own, which a repeated batch replaces.
    """

    def add(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    new = pages.withColumn("hash", F.sha2("text", 256)).dropDuplicates(["document_id", "page_number", "hash"])
    return new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_accuracy(attempts: DataFrame, late: str = "1 day") -> DataFrame:
    """T2. Accuracy of each UTC day; rows later than the watermark are dropped."""
    per = attempts.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("attempted"), F.count_if("is_correct").alias("correct"))
    return per.select(F.to_date("window.start").alias("day"), "attempted", "correct", percent(F.col("correct"), F.col("attempted")).alias("accuracy"))


def running_mastery(attempts: DataFrame) -> DataFrame:
    """T3. Mastery by learner and topic as attempts arrive; for update or complete mode."""
    return topic_mastery(topic_breakdown(attempts, "user_id"))


SCHEDULE = "user_id long, key string, repetitions int, interval_days double, easiness double, last timestamp"


class _Schedule(StatefulProcessor):
    """State of one learner and question, which rows can be added to in any order: the number of misses, the last of them, and the right answers behind it.

    Of these, answers older than the watermark are but a number, as no miss can come before them any more; only younger ones are held one by one. A timer
    counts them when the watermark has passed them. With ``expiry``, a timer ends the state so long after its last answer.
    """

    def __init__(self, expiry: timedelta | None = None):
        self.expiry = expiry

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "misses long, miss_at long, miss_id long, settled long, last long")
        self.young = handle.getListState("young", "at long, id long")

    def _set(self, misses: int, miss: tuple, settled: int, last: int, young: list[tuple], passed: int) -> int:
        """Stores the state, with what the watermark has passed counted, and returns the right answers since the last miss."""
        young = sorted(t for t in young if t > miss)
        old = sum(at <= passed for at, _ in young)
        self.sums.update((misses, *miss, settled + old, last))
        if len(young) > old:
            self.young.put(young[old:])
        else:
            self.young.clear()
        return settled + len(young)

    def _state(self) -> tuple[int, tuple, int, int, list[tuple]]:
        if not self.sums.exists():
            return 0, (MICROS_LEAST, 0), 0, MICROS_LEAST, []
        misses, at, i, settled, last = self.sums.get()
        return misses, (at, i), settled, last, [tuple(t) for t in self.young.get()] if self.young.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        misses, miss, settled, last, young = self._state()
        for r in rows:
            at = (r.at, r.id)
            last = max(last, r.at)
            if r.is_correct:
                young.append(at)
            else:
                misses += 1
                if at > miss:
                    # Answers already counted are older than the watermark, so than this miss.
                    miss, settled = at, 0
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        streak = self._set(misses, miss, settled, last, young, passed)
        self.handle.registerTimer(last // 1000 + 1)
        if self.expiry:
            self.handle.registerTimer(last // 1000 + self.expiry // timedelta(milliseconds=1))
        ease = max(1.3, 2.5 - 0.2 * misses)
        days = 1.0 if streak <= 1 else 6.0 if streak == 2 else 6 * ease ** (streak - 2)
        yield Row(user_id=key[0], key=key[1], repetitions=streak, interval_days=days, easiness=ease, last=EPOCH + timedelta(microseconds=last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        misses, miss, settled, last, young = self._state()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.expiry and now >= last // 1000 + self.expiry // timedelta(milliseconds=1):
            self.sums.clear()
            self.young.clear()
        elif self.sums.exists():
            self._set(misses, miss, settled, last, young, timerValues.getCurrentWatermarkInMs() * 1000)
        yield from ()

    def close(self) -> None:
        pass


EPOCH, MICROS_LEAST = datetime(1970, 1, 1), -(1 << 62)


def review_schedule(attempts: DataFrame, late: str = "1 day", expiry: timedelta | None = None) -> DataFrame:
    """T4. Review schedule by learner and question, as W6: rows may come in any order within the watermark, in whatever batch. Needs the RocksDB state store. Rows without a time are left out."""
    rows = review_key(attempts).filter("created_at is not null").withWatermark("created_at", late)
    rows = rows.select("user_id", "key", "id", "created_at", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "is_correct")
    return rows.groupBy("user_id", "key").transformWithState(_Schedule(expiry), SCHEDULE, "Update", "EventTime")


def throttle(events: DataFrame, key: str, limit: int, seconds: float, late: str = "1 day") -> DataFrame:
    """T5. Whether each event is allowed; state holds the accepted times of the last window and goes when it has passed."""

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        flags = []
        for at in rows.created_at:
            now = at.timestamp()
            held = [t for t in held if now - t < seconds]
            flags.append(len(held) < limit)
            if flags[-1]:
                held.append(now)
        state.update((held,))
        newest = int(rows.created_at.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + int(seconds * 1000) + 1)
        yield pd.DataFrame({"id": rows.id.values, "key": [k[0]] * len(rows), "allowed": flags})

    rows = events.select("id", F.col(key).alias("key"), "created_at").withWatermark("created_at", late)
    return rows.groupBy("key").applyInPandasWithState(fold, "id long, key long, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def without_repeats(attempts: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """T6. Drops rows whose keys came before within the watermark."""
    return attempts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(list(keys))
