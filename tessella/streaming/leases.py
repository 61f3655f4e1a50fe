"""Leases on work items: who may work on what, and when a claim has gone stale.

``Leases`` is a stream of its own state: of each item who holds it and until
when, in a value state with a timer in processing time.  A heartbeat moves the
timer, a release clears it, and a holder that falls silent loses the lease when
it fires: ``expired`` is emitted then, whether or not anybody else claims the
item.  The timers are part of the state, so they survive a restart.

``grants`` decides by the times that the events carry, in order of time, and
``current_leases`` and ``sessions`` do so for a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALE_MINUTES = 120
STATE = "node string, heartbeat timestamp"
OUT = "item string, node string, granted boolean, at timestamp"


LEASE = "node string, until_ms bigint"
EVENTS = "item string, node string, event string, at timestamp"
#: The state store that timers and state with a time to live need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def lease_events(claims: DataFrame, seconds: float = 60.0 * STALE_MINUTES) -> DataFrame:
    """(item, node, event, at) for a stream of (item, node, kind, at), kind being claim, heartbeat or release.

    ``event`` is granted (a free item is claimed), renewed (its holder claims
    it again or sends a heartbeat), refused (somebody else holds it, or a
    heartbeat of nobody's lease), released, or expired: ``seconds`` went by
    without a sign of the holder.  Events of one item in one batch are taken in
    order of time, then node; what the holder sends at a claim's own time comes
    first.  Rows without an item or a node are left out, other kinds are
    refused.  The session needs ``STORE``.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    ms = round(1000 * seconds)

    class Leases(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # should a timer ever be lost, the state goes by itself
            self.lease = handle.getValueState("lease", LEASE, ttlDurationMs=4 * ms + 60_000)

        def hold(self, node: str, until: int) -> None:
            self.clear_timers()
            self.lease.update((node, until))
            self.handle.registerTimer(until)

        def clear_timers(self) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentProcessingTimeInMs()
            held = self.lease.get() if self.lease.exists() else None
            holder = held[0] if held and held[1] > now else None
            found: list[tuple] = []
            if held and holder is None:  # past its time, but its timer comes after the rows of this batch
                self.clear_timers()
                found.append((key[0], held[0], "expired", moment(held[1])))
            some = pd.concat(list(rows)).sort_values(["at", "node", "kind"], kind="stable")
            for node, kind, at in zip(some["node"], some["kind"], some["at"], strict=True):
                event = decided(holder, node, kind)
                if event in ("granted", "renewed"):
                    holder = node
                elif event == "released":
                    holder = None
                found.append((key[0], node, event, at))
            touched = any(event in ("granted", "renewed") for _, _, event, _ in found)
            if holder is None and held:
                self.clear_timers()
                self.lease.clear()
            elif holder is not None and touched:
                self.hold(holder, now + ms)
            yield pd.DataFrame(found, columns=["item", "node", "event", "at"])

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            held = self.lease.get() if self.lease.exists() else None
            if held and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
                self.lease.clear()
                yield pd.DataFrame([(key[0], held[0], "expired", moment(held[1]))], columns=["item", "node", "event", "at"])

        def close(self) -> None:
            pass

    rows = claims.where("item is not null and node is not null")
    return rows.groupBy("item").transformWithStateInPandas(statefulProcessor=Leases(), outputStructType=EVENTS, outputMode="append", timeMode="processingTime")


def moment(ms: int) -> pd.Timestamp:
    return pd.Timestamp(datetime.fromtimestamp(ms / 1000, timezone.utc)).tz_localize(None)


def decided(holder: str | None, node: str, kind: str) -> str:
    """What comes of an event while ``holder`` has the lease (None: nobody)."""
    if kind == "claim":
        return "granted" if holder is None else "renewed" if holder == node else "refused"
    if holder != node:
        return "refused"
    return {"heartbeat": "renewed", "release": "released"}.get(kind, "refused")


def is_stale(heartbeat: Column, now: Column, minutes: int = STALE_MINUTES) -> Column:
    """A claim without a readable heartbeat, or with one ``minutes`` old or more."""
    return F.coalesce(F.timestamp_diff("MINUTE", heartbeat, now) >= minutes, F.lit(True))


def decide(holder: str | None, heartbeat: pd.Timestamp | None, node: str, at: pd.Timestamp, minutes: int = STALE_MINUTES) -> bool:
    """Whether ``node`` gets or keeps the lease at ``at``."""
    return holder is None or holder == node or heartbeat is None or (at - heartbeat).total_seconds() >= 60 * minutes


def grants(events: DataFrame, minutes: int = STALE_MINUTES) -> DataFrame:
    """(item, node, granted, at) for a stream of (item, node, at): custom state per item."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder, heartbeat = state.get if state.exists else (None, None)
        heartbeat = pd.Timestamp(heartbeat) if heartbeat is not None else None
        rows = pd.concat(list(batches)).sort_values(["at", "node"])
        out = []
        for node, at in zip(rows["node"], rows["at"], strict=True):
            ok = decide(holder, heartbeat, node, at, minutes)
            if ok:
                holder, heartbeat = node, at
            out.append((key[0], node, ok, at))
        state.update((holder, heartbeat.to_pydatetime() if heartbeat is not None else None))
        yield pd.DataFrame(out, columns=["item", "node", "granted", "at"])

    return events.groupBy("item").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def current_leases(heartbeats: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """The last heartbeat of every item and whether its lease is stale."""
    last = heartbeats.groupBy("item").agg(F.max(F.struct("at", "node")).alias("h")).select("item", F.col("h.node").alias("node"), F.col("h.at").alias("at"))
    return last.withColumn("stale", is_stale(F.col("at"), now, minutes))


def sessions(events: DataFrame, item: str, at: str, gap_minutes: int = STALE_MINUTES) -> DataFrame:
    """Runs of heartbeats without a gap of ``gap_minutes``: (item, start, end, n)."""
    w = Window.partitionBy(item).orderBy(at)
    marked = events.withColumn("_new", F.coalesce((F.timestamp_diff("MINUTE", F.lag(at).over(w), F.col(at)) >= gap_minutes).cast("int"), F.lit(0)))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(item, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_run")
