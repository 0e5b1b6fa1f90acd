"""The selection as a log of clicks: each adds a key to a session's selection, or takes it out, or clears it.

What is selected in the end is told by the last click on each key, and by the last clearing
before it; so clicks may come in any order and more than once, as in a replay after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ADD, REMOVE, CLEAR = "add", "remove", "clear"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def selected(clicks: DataFrame) -> DataFrame:
    """(session, key, at): what is selected after all clicks, and since when it was last added.

    `clicks` has session, at (a number that tells the clicks of a session apart and orders them), action
    and key; a clearing has no key. Clicks without session or place, with another action, or an
    addition without key change nothing.
    """
    known = clicks.where(_usable())
    last = known.where(F.col("action") != CLEAR).groupBy("session", "key").agg(
        F.max("at").alias("at"), F.max_by("action", "at").alias("action")
    )
    cleared = known.where(F.col("action") == CLEAR).groupBy("session").agg(F.max("at").alias("cleared"))
    found = last.where(F.col("action") == ADD).join(cleared, "session", "left")
    return found.where(F.col("cleared").isNull() | (F.col("at") > F.col("cleared"))).select("session", "key", "at")


def _usable() -> Column:
    told = F.col("key").isNotNull() & F.col("action").isin(ADD, REMOVE)
    return F.col("session").isNotNull() & F.col("at").isNotNull() & ((F.col("action") == CLEAR) | told)


class _LastClick(StatefulProcessor):
    """The last click on a key of a session; or, without a key, the session's last clearing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint, action string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()[0] if self.last.exists() else None
        newest = max(((r["at"], r["action"]) for r in rows), key=lambda click: click[0])
        if before is None or newest[0] > before:
            self.last.update(newest)
            yield Row(session=key[0], at=newest[0], action=newest[1], key=key[1])

    def close(self) -> None:
        pass


def watch_clicks(clicks: DataFrame, table: str, progress: str, once: bool = False) -> StreamingQuery:
    """Follow a stream of clicks; each batch's last click per key goes to the folder `table`, for `selected` to read.

    `table` and `progress` are on shared storage. Whatever was seen before or comes again after a
    failure changes nothing: only a later click does, and a batch that is done again writes the same
    place anew. The state is a row per session and key, so a busy session is spread over tasks. It is
    Spark's own (RocksDB): set `spark.sql.streaming.stateStore.providerClass` as README says.
    """
    known = clicks.where(_usable()).select("session", "at", "action", F.when(F.col("action") != CLEAR, F.col("key")).alias("key"))
    changes = known.groupBy("session", "key").transformWithState(
        _LastClick(), "session string, at bigint, action string, key string", outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
