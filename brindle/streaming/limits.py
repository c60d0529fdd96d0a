"""Rules that see each key's events one by one, on tables and on streams: call limits and usage meters.

A rule is a state, a step over one event, and the time until which the state
matters. Tables are folded in order (``live.fold_in_order``). On a stream the
same step runs in ``transformWithState``: each key's state is stored until a
timer of event time says that nothing depends on it any more, so keys that fall
silent leave nothing behind.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.live import fold_in_order

SECOND = 1_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rule:
    """``step(state, values)`` gives the next state and the answer; ``pack`` and ``unpack`` turn a state into a row of ``kept`` and back; ``until`` is the last microsecond at which the state can matter (None: it doesn't)."""

    start: Callable[[], object]
    step: Callable[[object, tuple], tuple[object, bool]]
    kept: str
    pack: Callable[[object], tuple]
    unpack: Callable[[tuple], object]
    until: Callable[[object], int | None]


def sliding(most: int, seconds: int) -> Rule:
    """At most ``most`` accepted calls in any ``seconds`` seconds; values: (time in microseconds,). Refused calls don't count."""
    def step(recent: deque, row: tuple) -> tuple[deque, bool]:
        (t,) = row
        while recent and recent[0] <= t - seconds * SECOND:
            recent.popleft()
        fits = len(recent) < most
        if fits:
            recent.append(t)
        return recent, fits

    return Rule(deque, step, "times array<long>", lambda s: (list(s),), lambda r: deque(r[0]), lambda s: s[-1] + seconds * SECOND if s else None)


def caps(day: int, month: int) -> Rule:
    """At most ``day`` units on a day and ``month`` in a month; values: (date, units). A charge that would pass a cap is refused and costs nothing."""
    def step(state: tuple, row: tuple) -> tuple[tuple, bool]:
        last, used_day, used_month = state
        now, units = row
        used_day = used_day if last == now else 0
        used_month = used_month if last is not None and (last.year, last.month) == (now.year, now.month) else 0
        fits = used_day + units <= day and used_month + units <= month
        return (now, used_day + units * fits, used_month + units * fits), fits

    def month_end(state: tuple) -> int | None:
        if state[0] is None:
            return None
        after = (state[0].replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        return int(dt.datetime(after.year, after.month, 1, tzinfo=dt.UTC).timestamp()) * SECOND

    return Rule(lambda: (None, 0, 0), step, "day date, used_day long, used_month long", tuple, tuple, month_end)


def sliding_limit(events: DataFrame, key: str, at: str, most: int, seconds: int, tie: str = "event_id") -> DataFrame:
    """Adds allowed by the rule ``sliding``; events of one time follow ``tie``. State is ``most`` times at most."""
    timed = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    rule = sliding(most, seconds)
    return fold_in_order(timed, [key], ["_t", tie], "allowed", rule.start, rule.step, ["_t"]).drop("_t")


def metered(usage: DataFrame, cap_day: int, cap_month: int, key: str = "user_id", order: str = "seq") -> DataFrame:
    """Adds charged by the rule ``caps`` to (key, order, day, calls), in order."""
    rule = caps(cap_day, cap_month)
    return fold_in_order(usage, [key], [order], "charged", rule.start, rule.step, ["day", "calls"])


# ---------------------------------------------------------------- streams
#: Columns that are added on the way; the worker renames those that begin with an underscore.
MICROS, DAY = "brindle_micros", "brindle_day"


class _Keyed(StatefulProcessor):
    """Runs a rule over a key's events of each micro-batch in order, and forgets the key when its timer fires."""

    def __init__(self, rule: Rule, order: list[str], reads: list[str], returns: list[str], result: str):
        self.rule, self.order, self.reads, self.returns, self.result = rule, order, reads, returns, result

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.rule.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.rule.unpack(tuple(self.state.get())) if self.state.exists() else self.rule.start()
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        said = []
        for values in zip(*[events[c].tolist() for c in self.reads], strict=True):
            state, answer = self.rule.step(state, values)
            said.append(answer)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        until = self.rule.until(state)
        if until is None:
            self.state.clear()
        else:
            self.state.update(self.rule.pack(state))
            self.handle.registerTimer(max(-(-until // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield events[self.returns].assign(**{self.result: said})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _on_stream(events: DataFrame, key: str, at: str, rule: Rule, order: list[str], reads: list[str], result: str, delay: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the one store that holds this operator's state
    returns = [c for c in events.columns if c not in (MICROS, DAY)]
    out = T.StructType([*[T.StructField(c, T.TimestampType()) if c == at else events.schema[c] for c in returns], T.StructField(result, T.BooleanType())])
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(key).transformWithStateInPandas(_Keyed(rule, order, reads, returns, result), out, "Append", "EventTime")


def limit_stream(events: DataFrame, key: str, at: str, most: int, seconds: int, tie: str = "event_id", delay: str = "10 seconds") -> DataFrame:
    """``sliding_limit`` on a stream. Events are taken in order inside a micro-batch and as they come from one to the next; those ``delay`` or more behind the latest of earlier micro-batches are dropped by Spark. A key's state is gone ``seconds`` after its last accepted call."""
    timed = events.withColumn(MICROS, F.unix_micros(F.col(at).cast("timestamp")))
    return _on_stream(timed, key, at, sliding(most, seconds), [MICROS, tie], [MICROS], "allowed", delay)


def meter_stream(usage: DataFrame, cap_day: int, cap_month: int, key: str = "user_id", order: str = "seq", at: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """``metered`` on a stream of (key, order, ``at``, calls): the day is that of ``at``. A key's state is gone when its month has ended."""
    dated = usage.withColumn(DAY, F.to_date(at))
    return _on_stream(dated, key, at, caps(cap_day, cap_month), [order], [DAY, "calls"], "charged", delay)
