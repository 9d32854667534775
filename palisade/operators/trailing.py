"""Counts over a trailing time frame that stay even when one key is hot.

Events are first counted per key and millisecond. A frame of W milliseconds
never reaches further back than the epoch-aligned slice of W milliseconds
before the event's own, so each counted row is put into its own slice and the
next one, and all further work is per (keys, slice): at most a few rows per
millisecond of two slices, however many events one key has.

Within a slice, the slice's own counts enter the frame one after the other and
those of the slice before leave it. The count in the frame is a running sum of
both, which costs the same for a frame of ten rows and of a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.instants import floor_to


def sliced(counted: DataFrame, width_ms: int) -> DataFrame:
    """Put each row into its own slice and, when it counts for others, the next one."""
    own = floor_to(F.col("ts_ms"), width_ms)
    reach = F.when(F.col("n") > 0, F.array(own, own + width_ms)).otherwise(F.array(own))
    return counted.select("*", own.alias("own_slice"), F.explode(reach).alias("slice"))


def over_frame(
    slices: DataFrame,
    keys: list[str],
    lower_ms: int,
    upper_ms: int,
    point: Column | None = None,
) -> DataFrame:
    """Add ``in_frame``, the sum of ``n`` over ``[ts_ms + lower_ms, ts_ms + upper_ms]``.

    Rows for which ``point`` holds come back once each; the others only count.
    """
    at_home = F.col("slice") == F.col("own_slice")
    changed = slices.withColumns({
        "at": F.when(at_home, F.col("ts_ms")).otherwise(F.col("ts_ms") - lower_ms + upper_ms + 1),
        "delta": F.when(at_home, F.col("n")).otherwise(-F.col("n")),
    })
    in_slice = Window.partitionBy(*keys, "slice").orderBy("at")
    so_far = in_slice.rangeBetween(Window.unboundedPreceding, upper_ms)
    whole = in_slice.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    nothing = F.lit(0).cast("bigint")
    own = F.coalesce(F.sum("delta").over(so_far), nothing)
    in_frame = own + F.coalesce(F.sum(F.when(~at_home, F.col("n"))).over(whole), nothing)
    wanted = at_home if point is None else at_home & point
    return (
        changed.withColumn("in_frame", in_frame)
        .where(wanted)
        .drop("own_slice", "slice", "at", "delta")
    )


def trailing(
    counted: DataFrame,
    keys: list[str],
    lower_ms: int,
    upper_ms: int,
    point: Column | None = None,
) -> DataFrame:
    """``over_frame`` for one row per (keys, ts_ms) with a count ``n``."""
    return over_frame(sliced(counted, -lower_ms), keys, lower_ms, upper_ms, point)
