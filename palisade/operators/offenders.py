"""Repeat offenders: how many stored events an address had in the ten minutes before.

An event's own batch never counts for it, and neither do events at the same
millisecond. Events of all configurations count.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import schema
from palisade.functions.instants import EPOCH, earlier, floor_to, instant_lit, millis
from palisade.operators.filters import matching
from palisade.operators.sizes import MAX_BROADCAST_BYTES, broadcast_if_small
from palisade.operators.trailing import over_frame, sliced, trailing

WINDOW_MS = schema.REPEAT_OFFENDER_WINDOW_MS

# Steps of time in which a batch's events are told apart, finest first: a frame, an hour, a day, about a month and a year.
UNITS_MS = (WINDOW_MS, 3_600_000, 86_400_000, 30 * 86_400_000, 360 * 86_400_000)
MOST_UNITS = 500
MOST_RANGES = 48


def is_repeat_offender(prior_count: Column) -> Column:
    return F.coalesce(prior_count > schema.REPEAT_OFFENDER_THRESHOLD, F.lit(False))


def keyed(events: DataFrame, *more: Column | str) -> DataFrame:
    return events.select("client_ip", millis(F.col("timestamp")).alias("ts_ms"), *more)


def batch_bounds(batch: DataFrame):
    """First and last event time of a batch, None when it is empty. One row reaches the driver."""
    row = batch.agg(
        F.unix_micros(F.min("timestamp")).alias("low"),
        F.unix_micros(F.max("timestamp")).alias("high"),
    ).first()
    if row["low"] is None:
        return None
    return EPOCH + timedelta(microseconds=row["low"]), EPOCH + timedelta(microseconds=row["high"])


def history_of_addresses(history: DataFrame, addresses: DataFrame, from_, to) -> DataFrame:
    """``(client_ip, ts_ms)`` of the stored events of some addresses in ``[from_, to)``."""
    wanted = broadcast_if_small(addresses.select("client_ip").distinct())
    return keyed(matching(history, from_, to)).join(wanted, "client_ip", "left_semi")


@dataclass(frozen=True)
class Reach:
    """Which stored events can matter to a batch: ranges of time, ends excluded, and what its addresses take in memory at most.

    None for a lower bound that would lie before the first representable instant.
    """

    ranges: list[tuple[datetime | None, datetime]]
    address_bytes: int

    def days(self) -> list[tuple[date | None, date]]:
        """First and last day of each range."""
        return [
            (low and low.date(), (earlier(high, timedelta(microseconds=1)) or high).date()) for low, high in self.ranges
        ]


def _merged(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one; over ``most`` of them, those nearest each other too."""
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    gaps = sorted(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1], reverse=True)
    starts = sorted([0, *gaps[: most - 1]]) if merged else []
    return [(merged[i][0], merged[j - 1][1]) for i, j in zip(starts, [*starts[1:], len(merged)])]


def _instant(ms: int) -> datetime | None:
    try:
        return EPOCH + timedelta(milliseconds=ms)
    except OverflowError:
        return None


def reach(batch: DataFrame) -> Reach:
    """What a batch reaches: the ten minutes before its events, told apart by slices of that length.

    An event now and one of three years ago reach two short ranges, not all
    between. A batch that touches over ``MOST_UNITS`` slices is told apart by hours,
    days, months or years instead, whichever is finest; a range may then hold
    events that do not matter, but none that do is left out. One job, from which a
    bounded number of rows reaches the driver.
    """
    ts = F.col("ts_ms")
    slices = keyed(batch).groupBy(floor_to(ts, UNITS_MS[0]).alias("slice")).agg(
        F.min(ts).alias("low"), F.max(ts).alias("high"), F.sum(F.octet_length("client_ip") + 64).alias("bytes")
    )
    steps = [floor_to(F.col("slice"), step) for step in UNITS_MS] + [F.lit(0).cast("bigint")]
    units = F.array(*[F.struct(F.lit(k).alias("kind"), unit.alias("unit")) for k, unit in enumerate(steps)])
    each = slices.select(F.explode(units).alias("u"), "low", "high", "bytes").groupBy("u.kind", "u.unit").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bytes").alias("bytes")
    )
    place = F.row_number().over(Window.partitionBy("kind").orderBy("unit"))
    found = each.withColumn("place", place).where(F.col("place") <= MOST_UNITS + 1).collect()
    for kind in range(len(steps)):
        rows = [r for r in found if r["kind"] == kind]
        if len(rows) <= MOST_UNITS:
            break
    spans = _merged([(r["low"] - WINDOW_MS, r["high"]) for r in rows], MOST_RANGES)
    return Reach([(_instant(low), _instant(high)) for low, high in spans], sum(r["bytes"] for r in rows))


def history_in_reach(history: DataFrame, batch: DataFrame, found: Reach) -> DataFrame:
    """The stored events of a batch's addresses in the ranges it reaches; days and times are pruned by them."""
    if not found.ranges:
        return history.limit(0)

    def inside(column: str, literal, low, high, last) -> Column:
        upper = F.col(column) <= literal(high) if last else F.col(column) < literal(high)
        return upper if low is None else (F.col(column) >= literal(low)) & upper

    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    rows = history.where(either([inside("timestamp", instant_lit, low, high, False) for low, high in found.ranges]))
    if "event_date" in history.columns:
        day = lambda value: F.lit(value.isoformat()).cast("date")
        rows = rows.where(either([inside("event_date", day, low, high, True) for low, high in found.days()]))
    wanted = batch.select("client_ip").distinct()
    if found.address_bytes <= MAX_BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "client_ip", "left_semi")


def history_for_batch(history: DataFrame, batch: DataFrame) -> DataFrame:
    """``(client_ip, ts_ms)`` of the batch's addresses from ten minutes before its first event up to its last."""
    bounds = batch_bounds(batch)
    if bounds is None:
        return keyed(history).limit(0)
    low, high = bounds
    return history_of_addresses(history, batch, earlier(low, timedelta(milliseconds=WINDOW_MS)), high)


def prior_counts_in_requests(batch: DataFrame, history: DataFrame, found: Reach | None = None) -> DataFrame:
    """``(client_ip, ts_ms, batch_id, prior_count)`` for several requests that come one after the other.

    ``batch_id`` (1 and up) is their order; each sees the history and the
    requests before it. ``found`` is what the batch reaches, if known already.
    """
    narrow = batch.select("client_ip", "timestamp", "batch_id")
    stored = history_in_reach(history, batch, reach(batch) if found is None else found)
    before = stored.select("client_ip", "timestamp", F.lit(0).cast("bigint").alias("batch_id"))
    return prior_counts_replayed(narrow.unionByName(before)).where("batch_id > 0")


def prior_counts(batch: DataFrame, history: DataFrame, found: Reach | None = None) -> DataFrame:
    """``(client_ip, ts_ms, prior_count)`` for the points of a batch with any history; ``found`` as above."""
    stored = keyed(history_in_reach(history, batch, reach(batch) if found is None else found)).withColumn("n", F.lit(1))
    points = keyed(batch).withColumn("n", F.lit(0))
    counted = stored.unionByName(points).groupBy("client_ip", "ts_ms").agg(
        F.sum("n").alias("n"), (F.min("n") == 0).alias("asked")
    )
    found_in = trailing(counted, ["client_ip"], -WINDOW_MS, -1, point=F.col("asked"))
    return found_in.where("in_frame > 0").select(
        "client_ip", "ts_ms", F.col("in_frame").alias("prior_count")
    )


def prior_counts_replayed(
    events: DataFrame, batch_id: str = "batch_id", in_order: bool = False
) -> DataFrame:
    """``(client_ip, ts_ms, batch_id, prior_count)`` as if the batches had come one by one.

    Counts the address's events in the frame with a lower batch id. ``in_order``
    says that no batch holds events older than an earlier batch's: the count is
    then that of all events in the frame less those of the same batch. Otherwise
    batches of a slice are told apart. Either way events are read once.
    """
    keyed_events = keyed(events, F.col(batch_id).cast("bigint").alias("batch_id"))
    if not in_order:
        cells = keyed_events.groupBy("client_ip", "ts_ms", "batch_id").agg(F.count(F.lit(1)).alias("n"))
        return _lower_batches_in_frame(cells)
    counted = (
        keyed_events.select("*", F.explode(F.array("batch_id", F.lit(None).cast("bigint"))).alias("scope"))
        .groupBy("client_ip", "ts_ms", "scope")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = trailing(counted, ["client_ip", "scope"], -WINDOW_MS, -1)
    point = Window.partitionBy("client_ip", "ts_ms")
    of_address = F.max(F.when(F.col("scope").isNull(), F.col("in_frame"))).over(point)
    return (
        found.select("client_ip", "ts_ms", "scope", (of_address - F.col("in_frame")).alias("prior_count"))
        .where(F.col("scope").isNotNull() & (F.col("prior_count") > 0))
        .select("client_ip", "ts_ms", F.col("scope").alias("batch_id"), "prior_count")
    )


def _lower_batches_in_frame(cells: DataFrame) -> DataFrame:
    """Count, for each cell (address, time, batch), the events of lower batches in its frame.

    The batches of a slice of an address are numbered from 0. For two numbers
    a < b there is one highest bit at which they differ: there b has 1 and a has
    0, and all bits above agree. A cell therefore looks, for each of its 1 bits,
    at the cells with a 0 there and the same bits above, and meets every lower
    batch once; for each (slice, bit, bits above) that is an ordinary trailing
    sum. A slice of k batches has log2(k) bits, one of a single batch has none.

    All of it happens in the slice: cells are shuffled to (address, slice) once,
    and numbering, sums and answers stay there.
    """
    of_slice = Window.partitionBy("client_ip", "slice")
    numbered = (
        sliced(cells, WINDOW_MS)
        .withColumn("number", F.dense_rank().over(of_slice.orderBy("batch_id")) - 1)
        .withColumn("last", F.max("number").over(of_slice).cast("bigint"))
        .where("last > 0")
    )
    at_bits = numbered.select(
        "*", F.explode(F.expr("sequence(0, length(bin(last)) - 1)")).alias("bit")
    ).select(
        "client_ip", "ts_ms", "batch_id", "own_slice", "slice", F.col("slice").alias("home"), "bit",
        F.expr("shiftright(number, bit + 1)").alias("above"),
        F.expr("getbit(number, bit) = 1").alias("asks"),
        F.expr("if(getbit(number, bit) = 1, 0L, n)").alias("n"),
    ).where(~F.col("asks") | (F.col("slice") == F.col("own_slice")))
    answers = over_frame(at_bits, ["client_ip", "bit", "above"], -WINDOW_MS, -1, point=F.col("asks"))
    return (
        answers.where("in_frame > 0")
        .groupBy("client_ip", "home", "ts_ms", "batch_id")
        .agg(F.sum("in_frame").alias("prior_count"))
        .drop("home")
    )


def with_prior_count(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``prior_count``, 0 where there is none.

    ``counts`` holds only points with a history, and is matched on its own
    columns: address, millisecond and, after a replay, batch.
    """
    on = [c for c in counts.columns if c != "prior_count"]
    return (
        events.withColumn("ts_ms", millis(F.col("timestamp")))
        .join(counts, on, "left")
        .withColumn("prior_count", F.coalesce("prior_count", F.lit(0)).cast("bigint"))
        .drop("ts_ms")
    )


def repeat_points(counts: DataFrame) -> DataFrame:
    """The points whose events are from repeat offenders."""
    return counts.where(is_repeat_offender(F.col("prior_count"))).drop("prior_count")


def with_points(events: DataFrame, points: DataFrame) -> DataFrame:
    """Add the ``repeat_offender`` flag: true for events at one of the points."""
    flagged = points.withColumn("repeat_offender", F.lit(True))
    return (
        events.withColumn("ts_ms", millis(F.col("timestamp")))
        .join(flagged, points.columns, "left")
        .withColumn("repeat_offender", F.coalesce("repeat_offender", F.lit(False)))
        .drop("ts_ms")
    )


def with_repeat_offender(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the ``repeat_offender`` flag; only the few flagged points take part in the join."""
    return with_points(events, repeat_points(counts))
