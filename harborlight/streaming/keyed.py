"""Order-sensitive logic per supplier in Spark's keyed state: health, alert suppression, causes.

Events may arrive in any order within ``horizon``. A supplier's events wait in its state until the watermark has passed
them; a timer then hands them over in order of time, so the result does not depend on the order of arrival or on how the
stream is cut into batches. Events behind the watermark are dropped by Spark and counted in the query's progress.

A source that is idle or has ended sends clock events (``event_type`` CLOCK): they carry a time and nothing else and move the watermark.

State lies in RocksDB and is checkpointed with the query. It holds the events of the horizon and a few numbers for each supplier.
One supplier's events go through one task, in order, a few microseconds each; ``stateful.health_path`` works a hot supplier's
history out in slices where a table of it is at hand.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

CLOCK = "CLOCK"
HORIZON = "24 hours"
DAY, SECOND = 86_400_000_000, 1_000_000  # microseconds
MAX_ALERTS = 5

Rows = list[tuple]


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them and works through them by (at, event_id).

    ``EVENT`` is what is kept of a row, beginning with ``at`` (microseconds) and ``event_id``.
    """

    EVENT = "at long, event_id long"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.EVENT)

    def arrived(self, rows: Rows) -> Rows:
        """What of new rows has to wait."""
        return rows

    def due(self, key: str, rows: Rows) -> Rows:
        """Results of the rows that are due, in order."""
        raise NotImplementedError

    def passed(self, mark: int) -> int | None:
        """Drop state that is not needed behind the watermark; when to look again, if there is more."""
        return None

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: Rows = []
        for part in rows:
            part = part[part["event_type"] != CLOCK]
            fresh += list(zip(*(part[c.split()[0]].tolist() for c in self.EVENT.split(", ")), strict=True))
        fresh = self.arrived(fresh)
        if fresh:
            self.waiting.appendList(fresh)
            self._timer(min(fresh)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        split = bisect_left(rows, (mark + 1,))
        out = self.due(key[0], rows[:split]) if split else []
        if split and split < len(rows):
            self.waiting.put(rows[split:])
        elif split:
            self.waiting.clear()
        again = [t for t in (rows[split][0] if split < len(rows) else None, self.passed(mark)) if t is not None]
        if again:
            self._timer(max(min(again), mark + 1000))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)


class Health(InOrder):
    """Anomaly count and health after each event: an anomaly adds one, a clean event takes one off.

    NORMAL turns DEGRADING at 2 and CRITICAL at 5; CRITICAL falls back to DEGRADING under 3 and DEGRADING to NORMAL at 0.
    """

    EVENT = "at long, event_id long, bad boolean"
    COLUMNS = ["event_id", "at", "supplier_id", "anomaly_count", "health"]

    def init(self, handle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "anomaly_count long, health string")

    def due(self, key, rows):
        count, health = self.now.get() if self.now.exists() else (0, "NORMAL")
        out = []
        for at, event, bad in rows:
            count = count + 1 if bad else max(0, count - 1)
            if count == 0:
                health = "NORMAL"
            elif count >= 5:
                health = "CRITICAL"
            elif count == 2:
                health = "DEGRADING"
            out.append((event, at, key, count, health))
        self.now.update((count, health))
        return out


class Suppress(InOrder):
    """Lets an alert pass while under five were accepted in the day before it, in whole seconds.

    Of the waiting alerts of one second only the first five can pass, so no more are kept. Accepted times expire one
    day behind the watermark.
    """

    COLUMNS = ["supplier_id", "event_id", "at"]

    def init(self, handle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "at long")

    def due(self, key, rows):
        kept, out = [t for (t,) in self.accepted.get()], []
        for at, event in sorted((at // SECOND, event) for at, event in rows):
            kept = [t for t in kept if t >= at - DAY // SECOND]
            if len(kept) < MAX_ALERTS:
                kept.append(at)
                out.append((key, event, at))
        if kept:
            self.accepted.put([(t,) for t in kept])
        return out

    def passed(self, mark):
        kept = [t for (t,) in self.accepted.get()]
        held = [t for t in kept if t * SECOND + DAY >= mark]
        if not held:
            self.accepted.clear()
            return None
        if len(held) < len(kept):
            self.accepted.put([(t,) for t in held])
        return held[0] * SECOND + DAY + SECOND


class Causes(InOrder):
    """Each stock-out with the last long delay of its supplier before it, if at most two hours old.

    Delays are kept apart, sorted, until no stock-out that may still come can be caused by them, so a stock-out is looked up as of its own time.
    """

    EVENT = "at long, event_id long"
    COLUMNS = ["event_id", "at", "supplier_id", "delay_event"]
    SPAN = 7200

    def init(self, handle) -> None:
        super().init(handle)
        self.delays = handle.getListState("delays", self.EVENT)

    def handleInputRows(self, key, rows, timerValues):
        late, empty = [], []
        for part in rows:
            part = part[part["event_type"] != CLOCK]
            each = list(zip(part["at"].tolist(), part["event_id"].tolist(), part["late"].tolist(), part["empty"].tolist(), strict=True))
            late += [(at, event) for at, event, is_late, _ in each if is_late]
            empty += [(at, event) for at, event, _, is_empty in each if is_empty]
        if late:
            self.delays.appendList(late)
        if empty:
            self.waiting.appendList(empty)
        if late or empty:
            self._timer(min(late + empty)[0])
        return iter(())

    def due(self, key, rows):
        delays, out = sorted(self.delays.get()), []
        for at, event in rows:
            before = bisect_left(delays, (at, event)) - 1
            # whole seconds, as the reports count
            if before >= 0 and at // SECOND - delays[before][0] // SECOND <= self.SPAN:
                out.append((event, at, key, delays[before][1]))
        return out

    def passed(self, mark):
        delays = sorted(self.delays.get())
        held = [d for d in delays if d[0] >= mark - (self.SPAN + 1) * SECOND]
        if held and len(held) < len(delays):
            self.delays.put(held)
        elif delays and not held:
            self.delays.clear()
        return held[-1][0] + (self.SPAN + 1) * SECOND if held else None


def _run(events: DataFrame, processor: StatefulProcessor, columns: list, schema: str, horizon: str) -> DataFrame:
    rows = events.withWatermark("event_time", horizon).select(
        F.coalesce("supplier_id", F.lit("")).alias("supplier_id"), "event_time", "event_type",
        F.unix_micros("event_time").alias("at"), "event_id", *columns)
    return rows.groupBy("supplier_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def with_clock(events: DataFrame, rows: Column) -> DataFrame:
    """The rows that hold, and the clock events of the stream."""
    return events.filter(rows | (F.col("event_type") == CLOCK))


def anomaly() -> Column:
    """An order event that counts against its supplier."""
    return F.coalesce((F.col("delay_days") > 14) | (F.col("inventory_level") < 5), F.lit(False))


def health(events: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Streaming: event_id, event_time, supplier_id, anomaly_count, health after each event."""
    rows = _run(events, Health(), [anomaly().alias("bad")],
                "event_id long, at long, supplier_id string, anomaly_count long, health string", horizon)
    return rows.select("event_id", F.timestamp_micros("at").alias("event_time"), "supplier_id", "anomaly_count", "health")


def accepted_alerts(criticals: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Streaming: supplier_id, event_id, at (seconds) of the alerts that pass."""
    return _run(criticals, Suppress(), [], "supplier_id string, event_id long, at long", horizon)


def causes(events: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Streaming: stock-outs with the delay that came before them."""
    late, empty = F.col("delay_days") > 7, F.col("inventory_level") < 10
    rows = _run(
        with_clock(events, late | empty), Causes(),
        [F.coalesce(late, F.lit(False)).alias("late"), F.coalesce(empty, F.lit(False)).alias("empty")],
        "event_id long, at long, supplier_id string, delay_event long", horizon)
    return rows.select(
        "event_id", "supplier_id", F.timestamp_micros("at").alias("event_time"), "delay_event",
        F.concat(F.lit("DELAY→STOCKOUT (supplier "), "supplier_id", F.lit(")")).alias("causality_chain"))
