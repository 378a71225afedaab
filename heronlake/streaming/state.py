"""Keyed state with timers: retries with a rest, and the life of a story.

The rules are plain functions of a state and a time, so that they can be tested alone; the
processors keep one small state per key, those of neighbouring keys together, and ask for a
timer at their next deadline: so Python is called once for a block of keys, not for each.
Times are microseconds of event time.  Rows of a key are taken in their order within a
micro-batch; what a deadline brings is the same whether a later row or a timer reaches it.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

HOUR = 3_600_000_000
DAY = 24 * HOUR
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need this state store."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


@dataclass
class Retry:
    """Attempts of a piece of work: three at most, a day apart; success clears them."""

    attempts: int = 0
    last: int = 0
    due: bool = True

    MOST, REST = 3, DAY

    def row(self, at: int, failed: bool) -> None:
        self.advance(at)
        if not failed:
            self.attempts, self.last, self.due = 0, 0, True
        elif self.due:
            self.attempts, self.last, self.due = self.attempts + 1, at, False

    def advance(self, now: int) -> None:
        """After its rest the work is due again."""
        if not self.due and self.attempts < self.MOST and now >= self.last + self.REST:
            self.due = True

    def deadline(self) -> int | None:
        return self.last + self.REST if not self.due and self.attempts < self.MOST else None


@dataclass
class Life:
    """A story: takes articles until it freezes, seven days after its first or above a hundred; is
    demoted when frozen and quiet for two days, promoted again by four articles within two
    days; is archived when nothing came for ten days."""

    taken: int = 0
    offered: int = 0
    first: int = 0
    last: int = 0
    frozen: int = 0
    archived: int = 0
    priority: int = 0
    recent: str = ""

    FREEZE, MOST, QUIET, BURST, ARCHIVE = 7 * DAY, 100, 2 * DAY, 4, 10 * DAY

    def row(self, at: int, failed: bool = False) -> None:
        self.advance(at)
        self.offered += 1
        self.first = self.first or at
        self.last = at
        times = [*map(int, self.recent.split()), at][-self.BURST :]
        self.recent = " ".join(map(str, times))
        if not self.frozen:
            self.taken += 1
            if self.taken > self.MOST:
                self.frozen = at
        if len(times) == self.BURST and at - times[0] <= self.QUIET:
            self.priority = 0

    def advance(self, now: int) -> None:
        if self.first and not self.frozen and now >= self.first + self.FREEZE:
            self.frozen = self.first + self.FREEZE
        if self.frozen and now >= max(self.last + self.QUIET, self.frozen):
            self.priority = -50
        if self.last and not self.archived and now >= self.last + self.ARCHIVE:
            self.archived = self.last + self.ARCHIVE

    def deadline(self) -> int | None:
        ahead = [] if self.frozen else [self.first + self.FREEZE]
        if self.priority == 0:
            ahead.append(max(self.last + self.QUIET, self.frozen or self.first + self.FREEZE))
        if not self.archived:
            ahead.append(self.last + self.ARCHIVE)
        return min(ahead, default=None)


#: Neighbouring whole numbers (a power of two) whose states are kept together.
BLOCK = 256
WHOLE = ("tinyint", "smallint", "int", "bigint")


def schema_of(kind: type) -> str:
    return ", ".join(f"{f.name} {dict(int='long', bool='boolean', str='string')[f.type]}" for f in fields(kind))


def come(block: dict, keys: list, times: list[int], failed: list[bool]) -> list:
    """Take rows, in order, into the states of a *block* by key; the keys that they changed."""
    for key, at, bad in zip(keys, times, failed, strict=True):
        block[key].row(at, bad)
    return list(dict.fromkeys(keys))


def passed(block: dict, now: int) -> list:
    """Bring what deadlines up to *now* bring; the keys that they changed."""
    changed = []
    for key, state in block.items():
        while (then := state.deadline()) is not None and then <= now:
            state.advance(then)
            changed.append(key)
    return list(dict.fromkeys(changed))


def processor(kind: type, by: str, key_type: str, at: str, failed: str) -> StatefulProcessor:
    """Keeps a *kind* per key in the value of the key's block; gives the fields of those that rows or a timer have changed."""
    names = [f.name for f in fields(kind)]
    lists = ", ".join(f"{x.split()[0]} array<{x.split()[1]}>" for x in [f"keys {key_type}", *schema_of(kind).split(", ")])

    class Keeper(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.value = handle.getValueState("states", lists)

        def _block(self):
            found = defaultdict(kind)
            if self.value.exists():
                keys, *columns = self.value.get()
                found |= {key: kind(*x) for key, *x in zip(keys, *columns, strict=True)}
            return found

        def _done(self, block, changed):
            import pandas as pd

            self.value.update((list(block), *map(list, zip(*map(astuple, block.values()), strict=True))))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if (then := min((d for s in block.values() if (d := s.deadline()) is not None), default=None)) is not None:
                self.handle.registerTimer(-(-then // 1000))
            return pd.DataFrame({by: pd.Series(changed, dtype=object), **{x: [getattr(block[key], x) for key in changed] for x in names}})

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            block, these = self._block(), pd.concat(list(rows)).sort_values([at, "event_id"])
            # beside a null key, whole numbers come as floats: exactly, as they are of block 0
            keys = [None if pd.isna(k) else int(k) if isinstance(k, float) and key_type in WHOLE else k for k in these[by].tolist()]
            yield self._done(block, come(block, keys, these[at].tolist(), these[failed].tolist()))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            block = self._block()
            now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
            yield self._done(block, passed(block, now))

        def close(self) -> None:
            pass

    return Keeper()


def kept(stream: DataFrame, kind: type, by: str, at: str, failed: str) -> DataFrame:
    """The states of *stream*'s keys (column *by*) as they change; *stream* has a watermark, ``event_id``, *at* (microseconds) and *failed*.

    Keys that are whole numbers go by blocks of BLOCK neighbours, others one by one.
    """
    key_type = dict(stream.dtypes)[by]
    block = F.shiftright(F.col(by).cast("long"), BLOCK.bit_length() - 1) if key_type in WHOLE else F.col(by).cast("string")
    # Spark takes a null group's rows for a group each
    block = F.coalesce(block, F.lit(0 if key_type in WHOLE else ""))
    rows = stream.withColumn("_block", block).groupBy("_block")
    return rows.transformWithStateInPandas(processor(kind, by, key_type, at, failed), f"{by} {key_type}, {schema_of(kind)}", "Update", "EventTime")
