"""Structured Streaming: capture sessions with their states, leases and buffered items, as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# States of a session, and items in a batch.
OPEN = ("awaiting_browser", "capturing", "paused")
TERMINAL = ("completed", "failed", "cancelled")
BATCH = 20
ENDS = {"complete": "completed", "fail": "failed", "cancel": "cancelled"}

EVENT = "session_id long, platform string, seq long, at timestamp, kind string, item string"
OUT = "session_id long, what string, number long, items array<string>, status string, at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(status: str, kind: str) -> str | None:
    """The state after an event, or None where it is refused. An ended session takes the event that ended it again, and no other."""
    if status in TERMINAL:
        return status if ENDS.get(kind) == status else None
    if kind == "claim":
        return "capturing"
    if kind in ("item", "renew", "complete"):
        return ENDS.get(kind, status) if status == "capturing" else None
    if kind == "pause":
        return "paused"
    return ENDS.get(kind)


class Sessions(StatefulProcessor):
    """State of a session: where it stands, when its lease ends, batches sent, and the items held back.

    A platform without scopes sends every 20 items; one with scopes holds its items until the session completes, as an item may come again from another
    folder. ``fail`` and ``cancel`` forget what is held, a pause keeps it.
    """

    def __init__(self, lease: int, scoped: tuple[str, ...]):
        self.lease, self.scoped = lease, scoped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "status string, lease long, sent long")
        self.held = handle.getListState("held", "item string")

    def _load(self) -> tuple[str, int, int]:
        return tuple(self.session.get()) if self.session.exists() else ("awaiting_browser", 0, 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (sid,) = key
        status, lease, sent = self._load()
        old_lease, begun = lease, lease
        fresh: list[str] = []
        waiting = None  # items held from earlier batches, counted when first needed
        # A session's events of one micro-batch, by time: a lease orders them, not their arrival.
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            now = int(r["at"].replace(tzinfo=UTC).timestamp() * 1000) if r["at"].tzinfo is None else int(r["at"].timestamp() * 1000)
            if status == "capturing" and lease <= now:
                status = "paused"
                yield Row(session_id=sid, what="expired", number=None, items=None, status=status, at=datetime.fromtimestamp(lease / 1000, UTC))
            after = step(status, r["kind"])
            if after is None:
                yield Row(session_id=sid, what="refused", number=r["seq"], items=None, status=status, at=r["at"])
                continue
            if r["kind"] in ("claim", "item", "renew"):
                lease = now + self.lease * 1000
            if r["kind"] == "item":
                fresh.append(r["item"])
                if r["platform"] not in self.scoped:
                    waiting = len(list(self.held.get())) if waiting is None else waiting
                    if waiting + len(fresh) >= BATCH:
                        yield from self._send(sid, sent, [x[0] for x in self.held.get()] + fresh, status, r["at"])
                        self.held.clear()
                        sent, waiting, fresh = sent + 1, 0, []
            if after != status and after in TERMINAL:
                whole = [x[0] for x in self.held.get()] + fresh if after == "completed" else []
                for at in range(0, len(whole), BATCH):
                    yield from self._send(sid, sent, whole[at : at + BATCH], status, r["at"])
                    sent += 1
                self.held.clear()
                fresh, waiting = [], 0
            if after != status:
                yield Row(session_id=sid, what="status", number=r["seq"], items=None, status=after, at=r["at"])
            status = after
        if fresh:
            self.held.appendList([(x,) for x in fresh])
        self.session.update((status, lease, sent))
        if begun:
            self.handle.deleteTimer(old_lease)
        if status == "capturing":
            self.handle.registerTimer(lease)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, lease, sent = self._load()
        if status == "capturing" and lease <= expiredTimerInfo.getExpiryTimeInMs():
            self.session.update(("paused", lease, sent))
            yield Row(session_id=key[0], what="expired", number=None, items=None, status="paused", at=datetime.fromtimestamp(lease / 1000, UTC))

    def _send(self, sid: int, number: int, items: list[str], status: str, at) -> Iterator[Row]:
        yield Row(session_id=sid, what="batch", number=number, items=items, status=status, at=at)

    def close(self) -> None:
        pass


def sessions(events: DataFrame, lease: int = 180, scoped: tuple[str, ...] = ("bilibili", "zhihu"), late: str = "0 seconds") -> DataFrame:
    """What the sessions of a stream of events (``EVENT``) put out: batches of items, changes of state, expired leases and refused events.

    ``kind`` is claim, renew, item, pause, complete, fail or cancel. A lease ends ``lease`` seconds after the last claim, renewal or item; it is
    checked against the next event's time, and a timer on the watermark reports it where no event comes. The state store must be RocksDB (``STORE``).
    """
    got = events.withWatermark("at", late).groupBy("session_id")
    return got.transformWithState(statefulProcessor=Sessions(lease, scoped), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def run(spark, source: str, sink: str, checkpoint: str, lease: int = 180, files: int = 100) -> StreamingQuery:
    """Run the sessions of Parquet files (``EVENT``) under ``source`` that have come since the last run into Parquet files under ``sink``, then stop.

    The sink's log and the checkpoint make a restarted run lose and repeat nothing.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(source)
        return sessions(stream, lease).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
