"""The same folds over streams of files: each is checked against its batch form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convlens.lineage import stored
from convlens.operators import model
from convlens.sources import tables


def append_once(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows once per key; a row delivered again within ``late`` is dropped, and older state is forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sittings(stream: DataFrame, keys: list[str], at: str, gap_minutes: int, late: str) -> DataFrame:
    """Sessions per key: started, ended, events. A silence of exactly the gap parts sessions, so the window is a microsecond shorter."""
    seconds = gap_minutes * 60 - 1
    window = F.session_window(at, f"{seconds} seconds 999 milliseconds 999 microseconds")
    return stream.withWatermark(at, late).groupBy(*keys, window).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events")).drop("session_window")


def census(stream: DataFrame, at: str, source: str, late: str, offset: str = "0 hours") -> DataFrame:
    """Events by day and source; ``offset`` moves where days begin."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day", "1 day", offset).alias("w"), source).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), source, "n")


def latest_state(stream: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The newest event of every key by (order), whatever the order of arrival; an update for each batch that changes it.

    fields: the columns kept; keys and order are among them. Of events equal by order any may stand.
    """
    newest = F.max_by(F.struct(*fields), F.struct(*order))
    return stream.groupBy(*keys).agg(newest.alias("__newest")).select("__newest.*")


class _Latest(StatefulProcessor):
    """One value for a key: its newest row, until the watermark passes its time by the time to live."""

    def __init__(self, keys: list[str], order: list[str], fields: dict[str, str], at: str, ttl_ms: int):
        self.keys, self.order, self.fields, self.at, self.ttl_ms = keys, order, fields, at, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", ", ".join(f"{c} {t}" for c, t in self.fields.items()) + ", __expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = list(self.fields)
        place = [columns.index(c) for c in self.order]
        ranked = lambda r: tuple(r[i] for i in place)
        held = self.newest.get() if self.newest.exists() else None
        best = old = None if held is None else tuple(held[: len(columns)])
        for frame in rows:
            for row, at in zip(frame[columns].itertuples(index=False, name=None), frame[self.at]):
                row = tuple(x.item() if hasattr(x, "item") else x for x in row)
                if best is None or ranked(row) > ranked(best):
                    best, moment = row, at
        if best is not None and best != old:
            expires = int(moment.timestamp() * 1000) + self.ttl_ms
            if held is not None and held[-1] != expires:
                self.handle.deleteTimer(held[-1])
            self.newest.update((*best, expires))
            self.handle.registerTimer(expires)
            yield pd.DataFrame([best], columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_live(stream: DataFrame, keys: list[str], order: list[str], fields: dict[str, str], at: str, late: str, ttl_ms: int) -> DataFrame:
    """As latest_state, with bounded state: a key that is silent for ``ttl_ms`` of event time beyond its newest row is forgotten.

    fields: name to type of the columns kept, keys and order among them. Rows older than the watermark are dropped and counted, see
    ``late_rows``. Needs the state store that keeps state on disk, which is set for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = ", ".join(f"{c} {t}" for c, t in fields.items())
    rows = stream.withWatermark(at, late).groupBy(*keys)
    return rows.transformWithStateInPandas(_Latest(keys, order, fields, at, ttl_ms), schema, "Update", "eventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them and were dropped, over the run of a query."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch."""
    return [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, reader: Callable, files_at_once: int = 1000, buckets: int = 64, ledger: str = "ingest") -> int:
    """Takes in the transcript files that have come since the last run; the number of batches that changed the tables.

    reader: (spark, paths) to (conversations, messages), one of sources.transcripts. Each batch of files is read as a whole, and its rows take the
    place of what the tables held of these files, in one commit with the batch's number: a batch that is replayed after a failure, or a
    file that is delivered again, changes nothing. Files that only grow are delivered again under their name.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(source).select("path")
    done = []

    def into(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.distinct().collect())  # no more than files_at_once
        if paths:
            done.append(take_in(spark, paths, path, reader, ledger, number, buckets))

    each_batch(stream, into, checkpoint, "append")
    return sum(done)


def take_in(spark: SparkSession, paths: list[str], path: str, reader: Callable, ledger: str, number: int, buckets: int = 64) -> bool:
    """One batch of files into the tables; False if its number was taken in before."""
    if number <= tables.pointer(spark, path)["ledger"].get(ledger, -1):
        return False
    conversations, messages = reader(spark, paths)
    return tables.upsert(spark, path, {"conversation": stored(conversations, "conversations"), "message": stored(messages, "messages")}, ledger, number, buckets=buckets)


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What was taken in, merged as a batch merges it: the first row of each message id by file and place, and of a conversation each column's first value."""
    told = tables.pointer(spark, path)
    heads, messages = tables.load(spark, path, "conversation", told), tables.load(spark, path, "message", told)
    columns = [c for c in heads.columns if c not in ("conv_id", "file")]
    return model.merge_conversations(heads, ["file"], columns, "conv_id"), model.merge_messages(messages, ["file", "seq"])


def absorbed(stream: DataFrame, key: str, late: str, unread_ms: int) -> DataFrame:
    """Searches that no next event absorbs: one pending search per user is held until the next event or a timer.

    stream: key, id, at (timestamp), ts_ms, q, source. Events within a batch are taken by time; the timer fires when the watermark has
    passed the pending search by ``unread_ms``. A null text is an empty one, which nothing goes on from. An event that comes in a later
    batch than one of a later time is compared with that one alone.
    """
    schema = f"{key} long, id long, ts_ms long, q string, source string"
    columns = [key, "id", "ts_ms", "q", "source"]

    def goes_on(one: tuple, then: tuple) -> bool:
        return then[2] - one[2] <= unread_ms and one[4] == then[4] and one[3].strip() != "" and then[3].startswith(one[3])

    def hold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([pending], columns=columns)
            return
        rows = sorted((r for f in frames for r in f[["ts_ms", "id", "q", "source"]].itertuples(index=False, name=None)), key=lambda r: r[:2])
        for ts, own, q, source in rows:
            now = (int(group[0]), int(own), int(ts), q or "", source)
            if pending is not None and now[2] < pending[2]:
                # An event of an earlier time than the one held: it is let go unless the one held goes on from it.
                if not goes_on(now, pending):
                    out.append(now)
                continue
            if pending is not None and not goes_on(pending, now):
                out.append(pending)
            pending = now
        state.update(pending)
        state.setTimeoutTimestamp(max(pending[2] + unread_ms + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    return stream.withWatermark("at", late).groupBy(key).applyInPandasWithState(hold, schema, schema, "append", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what there is, then stops; the checkpoint remembers what was read, so a rerun adds only what is new. The ended query tells of late rows."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    query = stream.writeStream.outputMode(mode).foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
