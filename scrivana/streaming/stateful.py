"""Keyed state: windows anchored at a key's first request (rate limits, caches), blacklists with a time to live, debouncing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Fixed value: seconds for which a missing value is kept.
NEGATIVE_S = 60


def anchored_windows(requests: DataFrame, window_s: int, limit: int | None = None) -> DataFrame:
    """``key, at, seq, opened, allowed, first`` for requests (key, at in seconds, seq); ``first`` marks the request that opens a window.

    A key's window opens at its first request and lasts window_s seconds; the next request at or
    after its end opens another. Of a window's requests the first ``limit`` are allowed; denied ones do not count.
    Rows stream through in order of key and time: a task holds one batch and one key's open window, so the work is
    linear in the requests. (A key's requests depend on each other in order, so one key is one task's.)
    """
    kind = requests.schema["key"].dataType
    dealt = requests.select("key", "at", "seq").repartition("key").sortWithinPartitions("key", "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, used = object(), 0, 0
        for b in batches:
            starts, ok, new = [], [], []
            for k, at in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                new.append(k != key or at >= opened + window_s)
                if new[-1]:
                    key, opened, used = k, at, 0
                allowed = limit is None or used < limit
                used += allowed
                starts.append(opened)
                ok.append(allowed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64()), pa.array(ok, pa.bool_()), pa.array(new, pa.bool_())], names=[*b.schema.names, "opened", "allowed", "first"])

    return dealt.mapInArrow(run, f"key {kind.simpleString()}, at long, seq long, opened long, allowed boolean, first boolean")


def rate_limit(requests: DataFrame, limit: int, window_s: int) -> DataFrame:
    """``key, at, seq, allowed`` for requests (key, at in seconds, seq): see :func:`anchored_windows`."""
    return anchored_windows(requests, window_s, limit).drop("opened", "first")


def shared_rate_limit(requests: DataFrame) -> DataFrame:
    """``key, at, seq, opened, allowed`` for requests (key, at, seq, limit, window_s) of several endpoints on one counter.

    The request that opens a window sets its length, each is allowed while fewer than its own limit have been, and only allowed ones count;
    so a strict endpoint is denied by what a lenient one has used. One pass over each key's requests in order.
    """
    kind = requests.schema["key"].dataType
    cols = ["key", "at", "seq", F.col("limit").cast("long").alias("limit"), F.col("window_s").cast("long").alias("window_s")]
    dealt = requests.select(*cols).repartition("key").sortWithinPartitions("key", "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, until, used = object(), 0, 0, 0
        for b in batches:
            starts, ok = [], []
            for k, at, limit, window in zip(*(b.column(c).to_pylist() for c in ("key", "at", "limit", "window_s")), strict=True):
                if k != key or at >= until:
                    key, until, used = k, at, 0  # nothing is counted until a request is allowed
                allowed = used < limit
                if allowed and not used:
                    opened, until = at, at + window
                used += allowed
                starts.append(opened if used else None)
                ok.append(allowed)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(starts, pa.int64()), pa.array(ok, pa.bool_())], names=["key", "at", "seq", "opened", "allowed"])

    return dealt.mapInArrow(run, f"key {kind.simpleString()}, at long, seq long, opened long, allowed boolean")


def cache_reads(reads: DataFrame, ttl_s: int) -> DataFrame:
    """``key, at, seq, hit`` of reads through a cache: a miss stores the value for ttl_s seconds, which a hit does not renew."""
    return anchored_windows(reads, ttl_s).select("key", "at", "seq", (~F.col("first")).alias("hit"))


def cache_aside(reads: DataFrame, ttl_s: int, negative_s: int = NEGATIVE_S) -> DataFrame:
    """``key, at, seq, hit, value`` of reads (key, at in seconds, seq, value): a miss loads the row's value and keeps it for ttl_s seconds, a
    missing one (null) for negative_s; a hit gives what is kept and renews nothing. One pass over each key's reads in order."""
    kind = reads.schema["key"].dataType
    dealt = reads.select("key", "at", "seq", F.col("value").cast("string").alias("value")).repartition("key").sortWithinPartitions("key", "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until, held = object(), 0, None
        for b in batches:
            hits, values = [], []
            for k, at, value in zip(*(b.column(c).to_pylist() for c in ("key", "at", "value")), strict=True):
                hits.append(k == key and at < until)
                if not hits[-1]:
                    key, until, held = k, at + (negative_s if value is None else ttl_s), value
                values.append(held)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hits, pa.bool_()), pa.array(values, pa.string())], names=["key", "at", "seq", "hit", "value"])

    return dealt.mapInArrow(run, f"key {kind.simpleString()}, at long, seq long, hit boolean, value string")


def cache_delete(keys: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The keys that a glob pattern (``*`` and ``?``) leaves, and a row with the number of those it deletes."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return keys.where(~F.col("key").like(like)), keys.where(F.col("key").like(like)).agg(F.count("*").alias("deleted"))


def blacklisted(requests: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Requests (token, at, seq) with ``denied`` and ``ttl_left`` (seconds, 0 where not): an entry (token, at, ttl_s) holds from its time
    until its ttl has passed. One sort of both by token and time; no pairs are formed."""
    end = F.col("at") + F.col("ttl_s")
    both = requests.select("token", "at", "seq", F.lit(None).cast("long").alias("until")).unionByName(blacklist.select("token", "at", F.lit(None).cast("long").alias("seq"), end.cast("long").alias("until")))
    so_far = Window.partitionBy("token").orderBy("at", F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    left = F.greatest(F.coalesce(F.max("until").over(so_far), F.lit(0)) - F.col("at"), F.lit(0))
    return both.withColumn("ttl_left", left).where(F.col("seq").isNotNull()).select("token", "at", "seq", (F.col("ttl_left") > 0).alias("denied"), "ttl_left")


class _Limiter(StatefulProcessor):
    """A key's open window as value state, which Spark clears when it has been still for a window's length."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def init(self, handle) -> None:
        self.window = handle.getValueState("window", "opened long, used int", ttlDurationMs=1000 * self.window_s)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values(["at", "seq"])
        ok = []
        for at in pdf["at"]:
            if opened is None or at >= opened + self.window_s:
                opened, used = int(at), 0
            ok.append(used < self.limit)
            used += ok[-1]
        self.window.update((int(opened), int(used)))
        yield pdf.assign(key=key[0], allowed=ok)[["key", "at", "seq", "allowed"]]

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int, window_s: int) -> DataFrame:
    """:func:`rate_limit` on a stream (needs the RocksDB state store); requests of a key are taken in order within a batch."""
    kind = requests.schema["key"].dataType.simpleString()
    return requests.groupBy("key").transformWithStateInPandas(_Limiter(limit, window_s), f"key {kind}, at long, seq long, allowed boolean", "Append", "ProcessingTime")


def debounce(events: DataFrame, gap_ms: int) -> DataFrame:
    """The last event (key, at timestamp) of each burst: those that no event of the key follows within the gap."""
    nxt = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    quiet = F.unix_millis(nxt) - F.unix_millis("at") > gap_ms
    return events.withColumn("quiet", F.coalesce(quiet, F.lit(True))).where("quiet").drop("quiet")


def debounce_stream(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The same on a stream: session windows of the gap, closed by the watermark; ``events`` is how many events the burst had."""
    others = [c for c in events.columns if c not in ("key", "at")]
    last = F.max(F.struct("at", *others)).alias("last")
    bursts = events.withWatermark("at", late).groupBy("key", F.session_window("at", gap).alias("burst")).agg(last, F.count("*").alias("events"))
    return bursts.select("key", "last.*", "events")
