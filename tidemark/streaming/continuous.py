"""The batch operators that have a continuous form: newest versions, first contents, sessions and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_contents(stream: DataFrame, keys: list[str], instant: str, late: str = "7 days") -> DataFrame:
    """The first row of each key; what is seen again within the watermark is left out."""
    return stream.withWatermark(instant, late).dropDuplicatesWithinWatermark(keys)


def newest(stream: DataFrame, keys: list[str], instant: str, unique: str, values: list[str]) -> DataFrame:
    """The newest version of each key; for update or complete output."""
    last = F.max(F.struct(instant, unique, *values)).alias("m")
    return stream.groupBy(*keys).agg(last).select(*keys, f"m.{instant}", f"m.{unique}", *(f"m.{v}" for v in values))


def windowed(stream: DataFrame, instant: str, width: str, late: str, key: str, value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and key, windows beginning every ``slide`` (every width, if None); late rows within the watermark count."""
    w = F.window(instant, width, slide or width)
    return stream.withWatermark(instant, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


class _Pending:
    """A key's state: the open session and the instants that the watermark hasn't passed, each with its number of rows.

    Sessions are made of instants before the watermark only, in their order, so
    they don't depend on the order of arrival.
    """

    def __init__(self, held: tuple | None) -> None:
        self.first, self.last, self.items, instants, counts = held or (None, None, 0, [], [])
        self.waiting = dict(zip(instants or [], counts or [], strict=True))

    def add(self, instants: list[int]) -> None:
        for t in instants:
            self.waiting[t] = self.waiting.get(t, 0) + 1

    def passed(self, until: int, gap: int, span: int) -> Iterator[tuple[int, int, int]]:
        """The sessions that no row can change once the watermark is at ``until``."""
        ready = sorted(t for t in self.waiting if t < until)
        for t in ready:
            if self.items and (t - self.last > gap or t - self.first > span):
                yield self.first, self.last, self.items
                self.items = 0
            self.first = t if not self.items else self.first
            self.last, self.items = t, self.items + self.waiting.pop(t)
        if self.items and until > self.end(gap, span):  # whatever comes is beyond it
            yield self.first, self.last, self.items
            self.items = 0

    def end(self, gap: int, span: int) -> int:
        return min(self.last + gap, self.first + span)

    def next(self, gap: int, span: int) -> int | None:
        """The instant that the watermark must pass for anything to happen."""
        waits = [min(self.waiting)] if self.waiting else []
        return min([*waits, self.end(gap, span)] if self.items else waits, default=None)

    def state(self) -> tuple:
        order = sorted(self.waiting)
        open_ = (self.first, self.last) if self.items else (None, None)
        return (*open_, self.items, order, [self.waiting[t] for t in order])


def sessions(stream: DataFrame, key: str, instant: str, gap: int, span: int, late: str = "1 hour") -> DataFrame:
    """(key, opened, closed, items) of sessions, each emitted once no row can change it any more.

    ``instant`` is a timestamp, limits are in seconds, the instants returned in
    microseconds.  However rows are split into batches and in whatever order
    they come, as long as none is later than the watermark allows, the sessions
    are those of the batch operator.  A key's state is its open session and the
    instants of the last ``late``, each once; timers wake it when the watermark
    passes them.  Rows without an instant are left out.
    """
    gap_us, span_us = gap * 1_000_000, span * 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, mark = _Pending(state.getOption), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for f in frames:
                pending.add(f["__us"].tolist())
        out = [(*k, *s) for s in pending.passed(mark * 1000, gap_us, span_us)]
        wake = pending.next(gap_us, span_us)
        if wake is None:
            state.remove()
        else:
            state.update(pending.state())
            state.setTimeoutTimestamp(max(wake // 1000 + 1, mark + 1))
        yield pd.DataFrame(out, columns=[key, "opened", "closed", "items"])

    kind = stream.schema[key].dataType.simpleString()
    marked = stream.where(F.col(instant).isNotNull()).withWatermark(instant, late).select(key, instant, F.unix_micros(instant).alias("__us"))
    return marked.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, opened long, closed long, items long", "first long, last long, items long, instants array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def batch_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a batch that comes again replaces what its number wrote before, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
