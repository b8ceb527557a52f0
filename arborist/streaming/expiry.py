"""Keyed entries that expire, over a stream: which requests find an entry that is still live.

A request that finds none makes one. Requests of a key wait in its state until the watermark has passed them;
an event-time timer then takes them in order of time, so that the order in which micro-batches bring them
does not matter. An entry's own end is a timer too, which removes it from the state. Needs the RocksDB state store.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FOUND = "key string, id long, ts timestamp, hit boolean"
#: after: an entry of age ttl is still live; at: it is not.
RULES = ("after", "at")


def is_live(age_us: int, ttl_us: int, rule: str) -> bool:
    return age_us <= ttl_us if rule == "after" else age_us < ttl_us


class Lookups(StatefulProcessor):
    """State of a key: the requests that wait, and when the live entry was made (microseconds).

    A key has one timer for all that wait, at the earliest of them; it answers what the watermark has passed.
    """

    def __init__(self, ttl_s: float, rule: str):
        self.ttl, self.rule = int(round(ttl_s * 1e6)), rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.made = handle.getValueState("made", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        new = [(r.us, r.id) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(ms, timerValues.getCurrentWatermarkInMs() - 1)
        held = self.made.get()
        made = held[0] if held is not None else None
        before, out = made, []
        waiting = sorted(map(tuple, self.waiting.get()))
        ripe = bisect_left(waiting, ((passed + 1) * 1000,))
        for us, i in waiting[:ripe]:
            hit = made is not None and is_live(us - made, self.ttl, self.rule)
            made = made if hit else us
            out.append((key[0], i, us, hit))
        if ripe and ripe < len(waiting):
            self.waiting.put(waiting[ripe:])
        elif ripe:
            self.waiting.clear()
        if ripe < len(waiting):
            self.handle.registerTimer(waiting[ripe][0] // 1000)
        if made != before:
            self.made.update((made,))
            self.handle.registerTimer((made + self.ttl) // 1000 + 2)
        elif made is not None and not is_live(ms * 1000 - made, self.ttl, "after"):
            self.made.clear()
        return iter([Row(key=k, id=i, us=us, hit=h) for k, i, us, h in out])

    def close(self) -> None:
        pass


def expiring_hits(requests: DataFrame, ttl_s: float, rule: str = "after", late: str = "10 minutes") -> DataFrame:
    """FOUND for a stream of (key, id, ts): whether each request finds the entry that the last one without made no more than ttl_s before.

    A hit does not prolong an entry. Rows without key or time are left out, ones later than `late` behind the
    newest are dropped by the watermark. A request is answered once the watermark has passed it.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    own = requests.where("key is not null and ts is not null").select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    own = own.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    found = own.groupBy("key").transformWithState(Lookups(ttl_s, rule), "key string, id long, us long, hit boolean", "append", "EventTime")
    return found.select("key", "id", F.timestamp_micros("us").alias("ts"), "hit")


def with_rocks(spark: SparkSession) -> SparkSession:
    """The session, its streams from now on with the RocksDB state store."""
    spark.conf.set(PROVIDER, ROCKS)
    return spark


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, appended to Parquet files at `path`; goes on where `checkpoint` says that an earlier run ended."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
