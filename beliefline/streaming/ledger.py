"""Evidence events as a stream: watermarked windows of event counts, a ledger with state of every key, and citations
appended to a ledger table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed(events: DataFrame, *, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total of tumbling windows; rows later than the watermark are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    by = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_citations(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each event's citation key to a Parquet ledger, exactly once."""
    keys = events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")).alias("key"), "ts")
    return keys.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a batch says of a key: its entries so far, the one that stands (the latest by time, then by id), whether it was
#: replayed from state and how many entries were repeats or came late.
KEY_ROWS = "key string, event_id long, ts timestamp, value double, entries long, repeats long, late long, state string"
KEY_STATE = "event_id long, ts timestamp, value double, entries long, repeats long, late long"
#: Fixed names of a key's row: an entry made it, an entry changed it, it answered from state, it expired.
NEW, CHANGED, REPLAYED, EXPIRED = "new", "changed", "replayed", "expired"
#: The provider of state that keyed processors need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LedgerKeys(StatefulProcessor):
    """Per key: the entry that stands, the ids seen (a map in the state store, each by itself), and counts. An id that was
    seen is a repeat and changes nothing; an entry older than the newest of its key by more than ``late`` is counted, not
    taken. A key without entries for ``expire`` of event time goes, and its last row says so."""

    def __init__(self, late: timedelta, expire: timedelta):
        self.allowed, self.expire = late, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", KEY_STATE)
        self.seen = handle.getMapState("seen", "event_id long", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        event_id, ts, value, entries, repeats, late = self.standing.get() if self.standing.exists() else (None, None, None, 0, 0, 0)
        state, before, taken = (NEW if event_id is None else REPLAYED), ts, []
        for batch in rows:
            taken += batch[["ts", "event_id", "value"]].itertuples(index=False, name=None)
        for when, id_, what in sorted((pd.Timestamp(t).to_pydatetime(), int(i), v) for t, i, v in taken):
            if self.seen.containsKey((id_,)):
                repeats += 1
            elif before is not None and when < before - self.allowed:
                late += 1
            else:
                self.seen.updateValue((id_,), (when,))
                entries += 1
                if ts is None or (when, id_) > (ts, event_id):
                    event_id, ts, value = id_, when, None if pd.isna(what) else float(what)
                    state = CHANGED if state == REPLAYED else state
        if ts is None:
            return
        self.standing.update((event_id, ts, value, entries, repeats, late))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((ts + self.expire - datetime(1970, 1, 1)).total_seconds() * 1000))
        yield self.row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.standing.exists():
            row = self.row(key, EXPIRED)
            self.standing.clear()
            self.seen.clear()
            yield row

    def row(self, key, state: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *self.standing.get(), state)], columns=["key", "event_id", "ts", "value", "entries", "repeats", "late", "state"])

    def close(self) -> None:
        pass


def keyed_ledger(events: DataFrame, *, late: timedelta = timedelta(days=2), expire: timedelta = timedelta(days=7), watermark: str = "30 days") -> DataFrame:
    """A row for each key (user and kind of event) and batch that touches it, by KEY_ROWS: exactly one entry counts for
    each id, whatever the batches, restarts and repeats. Entries without a time, an id or a user have no key and are left
    out. ``watermark`` bounds what may come at all, ``late`` what a key takes back after its newest entry."""
    clean = events.where("ts is not null and event_id is not null and user_id is not null").withWatermark("ts", watermark)
    keyed = clean.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", "ts", "value")
    return keyed.groupBy("key").transformWithStateInPandas(LedgerKeys(late, expire), KEY_ROWS, "Update", "EventTime")


def replayed(rows: DataFrame, key: str) -> DataFrame:
    """The rows of one key, as stored: a pass is answered again without its agents."""
    return rows.where(F.col("key") == key)
