"""Blacklists, caches, due reviews and ingest on streams: keyed state with event-time timers, and a sink that a replay leaves as it is.

All need the RocksDB state store. Rows of a key are taken in order of time within a batch; what comes later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from scrivana.functions.text import REVIEW_DAYS, windows
from scrivana.streaming.stateful import NEGATIVE_S

DAY_US = 86_400_000_000


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, na_position="first", kind="stable")


class _Blacklist(StatefulProcessor):
    """A token's latest end of denial; an event-time timer clears it when the watermark has passed it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = self.until.get()[0] if self.until.exists() else 0
        before, out = until, []
        for at, seq, ends in _in_order(rows, ["at", "seq"])[["at", "seq", "until"]].itertuples(index=False):
            if pd.isna(seq):  # an entry of the blacklist
                until = max(until, int(ends))
            else:
                left = max(until - int(at), 0)
                out.append((key[0], int(at), int(seq), left > 0, left))
        if until > before:
            if before:
                self.handle.deleteTimer(before * 1000)
            self.handle.registerTimer(until * 1000)
            self.until.update((until,))
        if out:
            yield pd.DataFrame(out, columns=["token", "at", "seq", "denied", "ttl_left"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


def blacklisted_stream(requests: DataFrame, blacklist: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``blacklisted`` on two streams: requests (token, at, seq) and entries (token, at, ttl_s), tagged and met in one keyed state."""
    kind = requests.schema["token"].dataType.simpleString()
    asked = requests.select("token", "at", "seq", F.lit(None).cast("long").alias("until"))
    entries = blacklist.select("token", "at", F.lit(None).cast("long").alias("seq"), (F.col("at") + F.col("ttl_s")).cast("long").alias("until"))
    both = asked.unionByName(entries).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    return both.groupBy("token").transformWithStateInPandas(_Blacklist(), f"token {kind}, at long, seq long, denied boolean, ttl_left long", "Append", "EventTime")


class _Cache(StatefulProcessor):
    """A key's kept value and its end, found or missing; an event-time timer clears it."""

    def __init__(self, ttl_s: int, negative_s: int):
        self.ttl_s, self.negative_s = ttl_s, negative_s

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "until long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, held = self.held.get() if self.held.exists() else (0, None)
        before, out = until, []
        for at, seq, value in _in_order(rows, ["at", "seq"])[["at", "seq", "value"]].itertuples(index=False):
            hit = at < until
            if not hit:
                held = None if pd.isna(value) else value
                until = int(at) + (self.negative_s if held is None else self.ttl_s)
            out.append((key[0], int(at), int(seq), bool(hit), held))
        if until != before:
            if before:
                self.handle.deleteTimer(before * 1000)
            self.handle.registerTimer(until * 1000)
            self.held.update((until, held))
        yield pd.DataFrame(out, columns=["key", "at", "seq", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_aside_stream(reads: DataFrame, ttl_s: int, negative_s: int = NEGATIVE_S, late: str = "10 seconds") -> DataFrame:
    """``cache_aside`` on a stream of reads (key, at, seq, value)."""
    kind = reads.schema["key"].dataType.simpleString()
    timed = reads.select("key", "at", "seq", F.col("value").cast("string").alias("value"), F.timestamp_seconds("at").alias("time")).withWatermark("time", late)
    return timed.groupBy("key").transformWithStateInPandas(_Cache(ttl_s, negative_s), f"key {kind}, at long, seq long, hit boolean, value string", "Append", "EventTime")


class _Reviews(StatefulProcessor):
    """A note's reviews so far and its next date; a timer at that date says once that it is due, unless another review came first."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reviews", "count int, next_us long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, next_us, told = self.state.get() if self.state.exists() else (0, 0, True)
        if not told:
            self.handle.deleteTimer(-(-next_us // 1000))
        out = []
        for at in _in_order(rows, ["at_us"])["at_us"]:
            if not told and at > next_us:  # it fell due before this review, though both came in one batch
                out.append((*key, count, next_us))
            count += 1
            next_us, told = int(at) + REVIEW_DAYS[min(count, len(REVIEW_DAYS) - 1)] * DAY_US, False
        self.handle.registerTimer(-(-next_us // 1000))
        self.state.update((count, next_us, told))
        yield pd.DataFrame(out, columns=["user_id", "note_id", "review_count", "next_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, next_us, _ = self.state.get()
        self.state.update((count, next_us, True))
        yield pd.DataFrame([(*key, count, next_us)], columns=["user_id", "note_id", "review_count", "next_us"])

    def close(self) -> None:
        pass


def due_stream(reviews: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``user_id, note_id, review_count, next_us`` once for each time a note falls due (see ``notes.due_history``), from reviews (user_id, note_id, at timestamp)."""
    kinds = [reviews.schema[c].dataType.simpleString() for c in ("user_id", "note_id")]
    timed = reviews.select("user_id", "note_id", "at", F.unix_micros("at").alias("at_us")).withWatermark("at", late)
    return timed.groupBy("user_id", "note_id").transformWithStateInPandas(_Reviews(), f"user_id {kinds[0]}, note_id {kinds[1]}, review_count int, next_us long", "Append", "EventTime")


REGISTRY = "user_id string, md5 string, id long, batch long"


def put_batch(batch: DataFrame, number: int, store: str) -> None:
    """One batch of files (user_id, md5, id, content) into the registry and the chunks of ``store``, under the batch's number.

    Files that other batches registered are left out, and a batch replaces its own part of both tables, so a replay leaves the store as it is.
    """
    spark = batch.sparkSession
    known = spark.read.schema(REGISTRY).parquet(f"{store}/registry").where(F.col("batch") != number).select("user_id", "md5")
    first = batch.groupBy("user_id", "md5").agg(F.min_by(F.struct("id", "content"), "id").alias("f")).select("user_id", "md5", "f.*")
    new = first.join(known, ["user_id", "md5"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
    chunks = new.select("batch", "user_id", "md5", "id", F.posexplode(windows(F.col("content"))).alias("chunk_index", "content"))
    for name, rows in (("chunks", chunks), ("registry", new.drop("content"))):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")


def ingest_stream(files: DataFrame, store: str, late: str = "1 hour") -> DataStreamWriter:
    """A writer of uploads (user_id, id, content, at) into ``store``: one file of each content and tenant.

    Repeats within the watermark are dropped by state (which of a batch's repeats stays is not defined), older ones by the registry. Start it with a checkpoint location.
    """
    spark = files.sparkSession
    spark.createDataFrame([], REGISTRY).write.mode("append").partitionBy("batch").parquet(f"{store}/registry")  # so that there is one to read
    keyed = files.withColumn("md5", F.md5("content")).withWatermark("at", late).dropDuplicatesWithinWatermark(["user_id", "md5"])
    return keyed.writeStream.foreachBatch(lambda batch, number: put_batch(batch, number, store))
