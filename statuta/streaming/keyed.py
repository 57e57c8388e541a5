"""Keyed state with event time: rows wait until the watermark has passed them, then count in their own order.

Each key holds the rows that may still be overtaken and the last status before them. A timer at the earliest held row
fires when the watermark passes it: all rows up to the watermark are sorted, compared in turn and forgotten but for the
last. The result is that of the same table read at once, whatever the size of micro-batches and the order of arrival
within the lateness; later rows are dropped by the watermark, which starts at 1970: times before that are late. A key that has had no row for `forget` is dropped, too: its
next row has nothing before it.

What a key costs is calls to its state, so rows come as JSON that Spark writes and are held as such, up to HELD in an entry: a
call appends a key's rows of a batch, another reads them. Checkpoints of before, with an entry a row, can't be gone on with.

State of this kind needs the RocksDB state store; `run_available` starts a stream with it.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = Row("_key", "_at", "_old", "_new")


#: Rows in an entry of a key's list at most.
HELD = 1000


class _Held(StatefulProcessor):
    """Rows (JSON arrays of microseconds, tie, value) wait in a list; `passed` is called with those the watermark has passed, in order."""

    def __init__(self, forget: int | None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows string")
        self.last = handle.getValueState("last", "at bigint, value string, seen boolean")

    def before(self) -> tuple[int, str | None, bool]:
        return self.last.get() or (0, None, False)

    def wake(self, at: int) -> None:
        """A timer for when the watermark (in milliseconds) is past a time."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = None
        texts = (r[2] for r in rows)
        while some := list(itertools.islice(texts, HELD)):
            self.held.appendValue((",".join(some),))
            least = min(int(t[2 : t.index('"', 2)]) for t in some)
            first = least if first is None else min(first, least)
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = [(int(at), tie, value) for (text,) in self.held.get() for at, tie, value in json.loads(f"[{text}]")]
        due = sorted((r for r in every if r[0] < now), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
        rest = [r for r in every if r[0] >= now]
        out = self.passed(due) if due else []
        if due:
            if rest:
                texts = [json.dumps([str(at), tie, value]) for at, tie, value in rest]
                self.held.put([(",".join(texts[i : i + HELD]),) for i in range(0, len(texts), HELD)])
            else:
                self.held.clear()
        if rest:
            self.wake(min(r[0] for r in rest))
        if self.forget is not None:
            at, _, seen = self.before()
            if seen and not rest and at + self.forget < now:
                self.last.clear()
            elif seen:
                self.wake(at + self.forget)
        return iter([OUT(key[0], *row) for row in out])

    def passed(self, due: list[tuple]) -> list[tuple]:
        """Rows to emit; the state before them becomes the last of them."""
        at, old, seen = self.before()
        out = []
        for now, _, new in due:
            if self.forget is not None and seen and now - at > self.forget:
                old, seen = None, False
            if told := self.told(seen, old, new):
                out.append((now, *told))
            at, old, seen = now, new, True
        self.last.update((at, old, True))
        return out

    def told(self, seen: bool, old: str | None, new: str | None) -> tuple | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Changes(_Held):
    """Rows whose value differs from that of the key's row before; nulls are no value but come between."""

    def told(self, seen: bool, old: str | None, new: str | None) -> tuple | None:
        return (old, new) if old is not None and new is not None and new != old else None


class _Arrivals(_Held):
    """Rows that are new (no row of the key before) or whose digest has changed since; equal ones are none."""

    def told(self, seen: bool, old: str | None, new: str | None) -> tuple | None:
        return ("changed" if seen else "new", new) if not seen or new != old else None


def _microseconds(duration: str | None) -> int | None:
    return None if duration is None else int(pd.Timedelta(duration).total_seconds() * 1_000_000)


def _processed(stream: DataFrame, kind: type[_Held], key: str, at: str, value: str, tie: str | None, lateness: str, forget: str | None, names: tuple[str, str]) -> DataFrame:
    time, order = F.col(at).cast("timestamp"), F.coalesce((F.col(tie) if tie else F.lit("")).cast("string"), F.lit(""))
    row = F.to_json(F.array(F.unix_micros(time).cast("string"), order, F.col(value).cast("string")))
    rows = stream.select(F.col(key).alias("_key"), time.alias("_at"), row.alias("_row")).where("_at IS NOT NULL").withWatermark("_at", lateness)
    type_ = rows.schema["_key"].dataType.simpleString()
    done = rows.groupBy("_key").transformWithState(
        statefulProcessor=kind(_microseconds(forget)), outputStructType=f"_key {type_}, _at long, _old string, _new string", outputMode="append", timeMode="eventTime"
    )
    return done.select(F.col("_key").alias(key), F.timestamp_micros("_at").alias(at), F.col("_old").alias(names[0]), F.col("_new").alias(names[1]))


def status_changes(stream: DataFrame, key: str, at: str, status: str, tie: str | None = None, lateness: str = "45 days", forget: str | None = None) -> DataFrame:
    """(key, at, old_status, new_status) of a stream: the rows whose status differs from that of the key's row before, in
    order of at, tie (as text) and status. Rows without a time are left out."""
    return _processed(stream, _Changes, key, at, status, tie, lateness, forget, ("old_status", "new_status"))


def arrivals(stream: DataFrame, key: str, at: str, digest: str, tie: str | None = None, lateness: str = "45 days", forget: str | None = None) -> DataFrame:
    """(key, at, kind, digest) of a stream: kind is new for a key's first row, changed for one whose digest isn't that
    of the row before; rows that bring nothing are left out."""
    return _processed(stream, _Arrivals, key, at, digest, tie, lateness, forget, ("kind", digest))


def high_water(stream: DataFrame, source: str, at: str) -> DataFrame:
    """(source, high_water): the largest time of every source so far; for output mode update or complete. It never moves
    back, for a maximum only grows."""
    return stream.groupBy(source).agg(F.max(at).alias("high_water"))
