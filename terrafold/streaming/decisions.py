"""Exact ordered decisions per key, as a batch and as a stream.

A decision looks at the requests of its key that were allowed before it, in the order of time and id. The stream gives
the same rows as the batch however its input is shuffled: a request waits in the state until the watermark has passed
its time, then an event-time timer handles all that are due, in order. A second timer forgets what no later request can
depend on, so a key that falls silent leaves no state. State and timers are in the checkpoint, so a restart goes on where
the query ended. Rows later than the watermark's delay are dropped by Spark, as by every stateful operator.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructType

SECOND = 1_000_000  # times are microseconds
MINUTE = 60 * SECOND
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule(Protocol):
    """``held`` has the times that later decisions can depend on, oldest first."""

    def decide(self, held: deque[int], now: int) -> tuple[bool, int]:
        """Whether a request at ``now`` is allowed, and the seconds to wait if not; updates ``held``."""

    def until(self, time: int) -> int:
        """The moment from which the held ``time`` doesn't matter any more."""


@dataclass(frozen=True)
class TrailingQuota:
    """At most ``limit`` allowed requests in the ``seconds`` up to a request; denied ones don't count."""

    limit: int = 20
    seconds: int = 3600

    def decide(self, held: deque[int], now: int) -> tuple[bool, int]:
        while held and held[0] + self.seconds * SECOND <= now:
            held.popleft()
        if len(held) < self.limit:
            held.append(now)
            return True, 0
        return False, -((now - held[0]) // SECOND - self.seconds) if held else self.seconds

    def until(self, time: int) -> int:
        return time + self.seconds * SECOND


@dataclass(frozen=True)
class Cooldown:
    """An alert goes out if the last one that went out is older than ``seconds``."""

    seconds: int = 86_400

    def decide(self, held: deque[int], now: int) -> tuple[bool, int]:
        if held and now - held[-1] <= self.seconds * SECOND:
            return False, self.seconds - (now - held[-1]) // SECOND
        held.clear()
        held.append(now)
        return True, 0

    def until(self, time: int) -> int:
        return time + self.seconds * SECOND


@dataclass(frozen=True)
class MinuteQuota:
    """At most ``limit`` requests in a minute of the clock; denied ones count too."""

    limit: int = 100

    def decide(self, held: deque[int], now: int) -> tuple[bool, int]:
        while held and held[0] // MINUTE != now // MINUTE:
            held.popleft()
        if len(held) < self.limit:
            held.append(now)
            return True, 0
        return False, 60 - now % MINUTE // SECOND

    def until(self, time: int) -> int:
        return (time // MINUTE + 1) * MINUTE


def _kinds(requests: DataFrame, keys: list[str], row_id: str) -> str:
    return ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in [*keys, row_id])


def decided(requests: DataFrame, rule: Rule, *, keys: list[str], time: str = "time", row_id: str = "id") -> DataFrame:
    """The batch form: ``keys``, ``row_id``, ``time``, ``allowed`` and ``retry_after`` of every request with a time.

    A key's requests are one group, since each decision needs the one before; the task keeps what the rule holds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", row_id])
        held: deque[int] = deque()
        pairs = [rule.decide(held, at) for at in pdf["at"].tolist()]
        return pdf.drop(columns="at").assign(allowed=[p[0] for p in pairs], retry_after=[p[1] for p in pairs])

    rows = requests.where(F.col(time).isNotNull()).select(*keys, row_id, F.col(time).alias("time"), F.unix_micros(time).alias("at"))
    return rows.groupBy(*keys).applyInPandas(run, f"{_kinds(requests, keys, row_id)}, time timestamp, allowed boolean, retry_after long")


#: Requests in one entry of the state: each entry costs Spark a call and a conversion.
PACK = 4096


def packed(requests: list[tuple]) -> list[tuple[list, list]]:
    """Times and ids of requests, ``PACK`` to an entry."""
    return [tuple(map(list, zip(*requests[k : k + PACK], strict=True))) for k in range(0, len(requests), PACK)]


class _Ordered(StatefulProcessor):
    """Requests wait in ``pending`` for the watermark, many to an entry; ``held`` is the rule's memory."""

    def __init__(self, rule: Rule, keys: list[str], row_id: str, id_kind: StructType) -> None:
        self.rule, self.keys, self.row_id, self.id_kind = rule, keys, row_id, id_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.id_kind)
        self.held = handle.getListState("held", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        new = [(r["at"], r[self.row_id]) for r in rows]
        if new:
            self.pending.appendList(packed(new))
            self.handle.registerTimer(-(-min(x[0] for x in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, before = sorted(x for pack in self.pending.get() for x in zip(*pack, strict=True)), [x[0] for x in self.held.get()]
        due = [x for x in waiting if x[0] <= passed]
        left, held = waiting[len(due) :], deque(before)
        decided_row = Row(*self.keys, self.row_id, "at", "allowed", "retry_after")
        out = [decided_row(*key, row, at, *self.rule.decide(held, at)) for at, row in due]
        while held and self.rule.until(held[0]) <= passed:
            held.popleft()
        for state, changed, values in ((self.pending, bool(due), packed(left)), (self.held, before != list(held), [(x,) for x in held])):
            if changed and values:
                state.put(values)
            elif changed:
                state.clear()
        wake = [x[0] for x in left[:1]] + ([self.rule.until(held[0])] if held else [])
        if wake:
            self.handle.registerTimer(-(-min(wake) // 1000))
        return iter(out)

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, rule: Rule, *, keys: list[str], time: str = "time", row_id: str = "id", late: str = "10 minutes") -> DataFrame:
    """The stream form of ``decided``, in append mode: a decision comes out once the watermark has passed its request.

    Needs the RocksDB state store (``with_timers``).
    """
    marked = requests.where(F.col(time).isNotNull()).select(*keys, row_id, F.col(time).alias("time"), F.unix_micros(time).alias("at")).withWatermark("time", late)
    id_kind = StructType().add("at", ArrayType(LongType())).add(row_id, ArrayType(requests.schema[row_id].dataType))
    schema = f"{_kinds(requests, keys, row_id)}, at long, allowed boolean, retry_after long"
    out = marked.groupBy(*keys).transformWithState(_Ordered(rule, keys, row_id, id_kind), schema, "Append", "EventTime")
    return out.select(*keys, row_id, F.timestamp_micros("at").alias("time"), "allowed", "retry_after")


def with_timers(spark) -> None:
    """Set the state store that list state and timers need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
