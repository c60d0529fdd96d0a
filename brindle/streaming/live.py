"""Incremental work: keyed upserts, rate limits, usage caps, retention, replay.

Each rule is a batch transformation; the streaming wrappers run the same
function on every micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.core import keep_first


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], result: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, bool]], reads: list[str]) -> DataFrame:
    """Adds the boolean ``result`` of a rule that must see each key's rows one by one in order.

    Rows are dealt by key, sorted by Spark (which spills) and streamed through
    the rule in Arrow batches, so a task holds one key's state and one batch,
    however many rows the key has. ``step`` takes the state and a row's
    ``reads`` and gives the next state and the result.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(result, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            names = batch.schema.names
            who = list(zip(*[batch.column(names.index(k)).to_pylist() for k in keys], strict=True))
            rows = zip(*[batch.column(names.index(c)).to_pylist() for c in reads], strict=True)
            out = []
            for k, row in zip(who, rows, strict=True):
                if k != key or state is None:
                    key, state = k, start()
                state, said = step(state, row)
                out.append(said)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*names, result])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def throttled(events: DataFrame, key: str, at: str, seconds: float, tie: str = "event_id") -> DataFrame:
    """Adds told: whether a status message is passed on, at most one of a key in ``seconds``."""
    def step(last: int, row: tuple) -> tuple[int, bool]:
        told = row[0] - last >= seconds * 1_000_000
        return (row[0] if told else last), told

    timed = events.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    return fold_in_order(timed, [key], ["_t", tie], "told", lambda: -(1 << 62), step, ["_t"]).drop("_t")


def accepted_reads(reads: DataFrame, key: str, order: str) -> DataFrame:
    """Adds accepted: a finished read (request, begun_at change, change now) counts only if it is newer than the last one applied and nothing changed since it began."""
    def step(applied: int, row: tuple) -> tuple[int, bool]:
        request, begun, change = row
        fits = begun == change and request > applied
        return (request if fits else applied), fits

    return fold_in_order(reads, [key], [order], "accepted", lambda: 0, step, ["request", "begun", "change"])


def fan_out_queue(events: DataFrame, subscriber: str, order: str, size: int = 256, drop: str = "oldest") -> DataFrame:
    """What a bounded queue of each subscriber holds when it is read: the newest ``size`` messages, or the first ones where new ones are dropped."""
    w = Window.partitionBy(subscriber).orderBy(F.desc(order) if drop == "oldest" else F.asc(order))
    return events.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn")


def replayed(snapshot: DataFrame, frames: DataFrame, key: str, order: str) -> DataFrame:
    """A snapshot with the frames that came while it was read: known ids keep the snapshot's row, new ones are added once, the first frame wins."""
    both = snapshot.withColumn("_f", F.lit(0)).withColumn("_o", F.lit(None).cast("long")).unionByName(frames.withColumn("_f", F.lit(1)).withColumn("_o", F.col(order).cast("long")), allowMissingColumns=True)
    return keep_first(both, [key], ["_f", "_o"]).drop("_f", "_o")


def in_source_order(rows: DataFrame, source: str, row: str) -> DataFrame:
    """Rows of sources that were read side by side, in the order of the sources and of their rows."""
    return rows.orderBy(source, row)


def next_work(items: DataFrame, done: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The next ``n`` items, newest first, that have no result yet."""
    return items.join(done.select(key), key, "left_anti").orderBy(F.desc(order)).limit(n)


def stored_answer(plan: dict, signature: str, columns: list[str]) -> dict | None:
    """A stored question's plan, to be run again on the table as it is now; None when the table's columns have changed."""
    return plan if signature == column_signature(columns) else None


def column_signature(columns: list[str]) -> str:
    """The table's own column names in order; columns that are derived from them are left out by the caller."""
    return "|".join(columns)


def keep_recent(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` events of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def state_at(events: DataFrame, key: str, order: str, value: str, until) -> DataFrame:
    """Replay: each key's latest value among the events up to ``until``."""
    return events.filter(F.col(order) <= until).groupBy(key).agg(F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("n"))


def without_repeats(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Visits without consecutive repeats of one value."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def thinned(times, least: float, cap: float = 4.0, scale: float = 1.0):
    """Column: a sorted array of times thinned greedily; gaps are scaled and capped, first and last always stay."""
    n = F.size(times)
    start = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("clock"), F.lit(-1e18).alias("kept"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        clock = acc["clock"] + F.coalesce(F.least((x - acc["before"]) * scale, F.lit(cap)), F.lit(0.0))
        keep = (clock - acc["kept"] >= least) | (x == F.get(times, n - 1))
        return F.struct(x.alias("before"), clock.alias("clock"), F.when(keep, clock).otherwise(acc["kept"]).alias("kept"), F.when(keep, F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(times, start, step, lambda a: a["out"])


def thinned_rows(events: DataFrame, key: str, at: str, tie: str, least: float, cap: float = 4.0, scale: float = 1.0) -> DataFrame:
    """Adds shown to the rows of each key's timeline (``at`` in seconds): a row is shown when the clock has run ``least`` seconds since the last shown one.

    The clock runs by the gaps between rows, scaled and capped. The first and
    the last row always show. A task holds one key's clock, however long its
    timeline is.
    """
    def step(state: tuple, row: tuple) -> tuple[tuple, bool]:
        before, clock, shown = state
        now, last = row
        clock += min(cap, (now - before) * scale) if before is not None else 0.0
        shows = shown is None or clock - shown >= least
        return (now, clock, clock if shows else shown), shows or last

    ends = F.lead(tie).over(Window.partitionBy(key).orderBy(at, tie)).isNull()
    return fold_in_order(events.withColumn("_last", ends), [key], [at, tie], "shown", lambda: (None, 0.0, None), step, [at, "_last"]).drop("_last")


def gated(events: DataFrame, key: str, order: str, kind: str, generation: str, view: str) -> DataFrame:
    """Orders snapshots against live frames: adds now (the generation), accepted and buffer to each key's events in order.

    ``kind`` is begin (of a snapshot of ``view``), frame, finish (of the
    snapshot that began as ``generation``, while ``view`` is shown), drop or
    reset. A begin or a reset starts a new generation, which makes snapshots on
    their way stale. A finish is accepted if its generation is the newest and
    its view the one that was begun; it takes the frames of its buffer along.
    A finish of the newest generation, a drop and a reset end the buffer. So
    the state is two counts and the last view: running sums, whatever the
    number of frames between.
    """
    so_far = Window.partitionBy(key).orderBy(order)
    is_ = lambda *k: F.col(kind).isin(*k)
    now = F.count_if(is_("begin", "reset")).over(so_far)
    begun = F.last(F.when(is_("begin"), F.col(view)), ignorenulls=True).over(so_far)
    newest = is_("finish") & (F.col(generation) == F.col("now"))
    out = events.withColumn("now", now).withColumn("_begun", begun)
    out = out.withColumn("accepted", F.when(is_("finish"), F.coalesce(newest & (F.col(view) == F.col("_begun")), F.lit(False))))
    ended = F.count_if(is_("drop", "reset") | F.coalesce(newest, F.lit(False))).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("buffer", F.coalesce(ended, F.lit(0))).drop("_begun")


def published(gate: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """(key, order of the frame, published_by): the frames that accepted snapshots replay, from ``gated`` events."""
    done = gate.filter("accepted").select(F.col(key).alias("_key"), F.col("buffer").alias("_buffer"), F.col(order).alias("published_by"))
    frames = gate.filter(F.col(kind) == "frame")
    return frames.join(done, (F.col(key) == F.col("_key")) & (F.col("buffer") == F.col("_buffer"))).select(key, order, "published_by")


def final_status(events: DataFrame, key: str, order: str, status: str, terminal: list[str]) -> DataFrame:
    """Latest status of each key; a terminal one is never reopened by a later event."""
    done = F.min_by(status, F.when(F.col(status).isin(*terminal), F.col(order)))
    return events.groupBy(key).agg(F.coalesce(done, F.max_by(status, order)).alias(status))
