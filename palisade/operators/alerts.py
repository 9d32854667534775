"""Alert rules evaluated against the event table, all rules in one pass.

A rule's window is a whole number of minutes back from ``now``. Events are
therefore counted first per category, configuration and age in minutes. Each
distinct window asked for is looked up once among those few cells, and the rules
are joined to the answers: they meet no events, and equal ones share an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.instants import as_datetime, earlier, epoch_micros, instant_lit
from palisade.operators.filters import matching

_MINUTE_US = 60_000_000


def age_cells(events: DataFrame, now, minutes: int) -> DataFrame:
    """Counts per ``category, config_id, age`` for the given minutes before ``now``.

    An event at age a is inside exactly the windows of a minutes or more. A
    null ``config_id`` stands for all configurations together.
    """
    # A window that reaches before the first representable instant has no lower bound.
    recent = matching(events, earlier(as_datetime(now), minutes), now)
    age = F.ceil((F.lit(epoch_micros(now)) - F.unix_micros("timestamp")) / F.lit(_MINUTE_US))
    return with_all_configurations(
        recent.groupBy(F.col("rule_category").alias("category"), "config_id", age.alias("age"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_all_configurations(cells: DataFrame) -> DataFrame:
    """Cells (category, config_id, age, n), and those of all configurations together under a null one."""
    return cells.select(
        "category", F.explode(F.array(F.col("config_id"), F.lit(None).cast("bigint"))).alias("config_id"),
        "age", "n",
    ).groupBy("category", "config_id", "age").agg(F.sum("n").alias("n"))


def longest_window(rules: DataFrame) -> int:
    """Minutes of the longest window of the rules, 1 at least."""
    return rules.agg(F.max("window_minutes").alias("minutes")).first()["minutes"] or 1


def evaluate(events: DataFrame, rules: DataFrame, now) -> DataFrame:
    """Every rule with its count over ``[now - window_minutes, now)``."""
    return evaluate_cells(age_cells(events, now, longest_window(rules)), rules, now)


def evaluate_cells(cells: DataFrame, rules: DataFrame, now) -> DataFrame:
    """The rules' counts from cells as ``age_cells`` gives them.

    A window asked for enters its category and configuration at its age, and
    the running count there is its answer: nothing is paired with any cell.
    """
    cells = cells.withColumn("asked", F.lit(False))
    asked = rules.select(
        "category",
        "config_id",
        F.col("window_minutes").cast("bigint").alias("age"),
    ).distinct().withColumns({"n": F.lit(0).cast("bigint"), "asked": F.lit(True)})
    up_to = (
        Window.partitionBy("category", "config_id")
        .orderBy("age")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = cells.unionByName(asked).withColumn("actual_count", F.sum("n").over(up_to))
    answers = reached.where("asked").select(
        F.col("category").alias("of_category"), F.col("config_id").alias("of_config"),
        F.col("age").alias("of_age"), "actual_count",
    )
    met = rules.join(
        answers,
        (F.col("category") == F.col("of_category")) & F.col("config_id").eqNullSafe(F.col("of_config"))
        & (F.col("window_minutes").cast("bigint") == F.col("of_age")),
    )
    length = F.col("window_minutes").cast("bigint") * _MINUTE_US
    return met.select(
        F.col("id").alias("rule_id"),
        "config_id",
        "category",
        "threshold",
        "window_minutes",
        "actual_count",
        F.timestamp_micros(F.lit(epoch_micros(now)) - length).alias("window_from"),
        instant_lit(now).alias("window_to"),
    )


def firing(events: DataFrame, rules: DataFrame, now) -> DataFrame:
    """The rules whose count is strictly above their threshold."""
    return evaluate(events, rules, now).where(F.col("actual_count") > F.col("threshold"))
