"""Mixing sources to target weights by weighted fair queueing.

A source's documents are queued in an order shuffled by the md5 of their id,
``passes`` times over. A document's virtual finish time is the words its source
has sent up to and with it, divided by the source's target. The mix takes
documents in order of finish time, over all sources, until the words reach the
budget; as a source's time reaches 1 when it has sent its target, each comes
near its own.

Cumulative sums over a source, and over all rows, would put a third of all
rows (a hot source), or all of them, into one window. They are formed in levels
instead: sums per range of the order (at most 4096 ranges to a level), running
sums over those, and a window inside the last range only.

Null text has size 0. Null sources are one source, the last. Documents of size
0 are never taken. Repeated rows are mixed as so many documents; which of them
comes first does not change the totals. An empty table gives no rows. Columns
other than ``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import size, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
RANGES = 4096
ORDER = ["finish", "key", "turn", "doc_id", "size"]


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Rows (source, source_size) with their targets.

    The budget is ``share`` of all sizes. A target is level * weight, cut at
    ``passes`` times the size; the level makes the targets add up to the
    budget. In order of size / weight the cut sources come first, so one pass
    over running sums finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", place.alias("place"), weight.alias("weight"))
    rows = rows.withColumn("cap", (passes * F.col("source_size")).cast("double"))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("cut", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level is that of the first source which is not cut.
    level = F.first(F.when(~F.col("cut"), F.col("level")), ignorenulls=True).over(
        tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    rows = rows.withColumn("settled", level)
    return rows.select(
        "source", "source_size",
        F.when(F.col("cut") | F.col("settled").isNull(), F.col("cap"))
        .otherwise(F.col("settled") * F.col("weight")).alias("target"),
    )


def _running(rows: DataFrame, keys: list[str], levels: list[str], amount: str) -> DataFrame:
    """``before``: the amount in all earlier ranges of the same keys, level by level."""
    sums = rows.groupBy(*keys, *levels).agg(F.sum(amount).alias("amount"))
    out = None
    for depth in range(len(levels)):
        held = sums.groupBy(*keys, *levels[: depth + 1]).agg(F.sum("amount").alias("amount"))
        frame = Window.partitionBy(*keys, *levels[:depth]).orderBy(levels[depth]).rowsBetween(
            Window.unboundedPreceding, -1
        )
        held = held.select(
            *keys, *levels[: depth + 1], F.coalesce(F.sum("amount").over(frame), F.lit(0)).alias(f"before{depth}")
        )
        out = held if out is None else held.join(out, [*keys, *levels[:depth]])
    total = sum((F.col(f"before{depth}") for depth in range(1, len(levels))), F.col("before0"))
    return out.select(*keys, *levels, total.alias("before"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Rows doc_id, size, source_size, target, taken of all documents."""
    sized = stored(
        docs.select("doc_id", size().alias("size"), "source", F.md5(F.col("doc_id").cast("string")).alias("turn"))
        .withColumn("turn", F.coalesce("turn", F.lit("")))
    )
    goal = stored(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes)
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    )
    rows = sized.select(
        "doc_id", "size", "turn", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        F.substring("turn", 1, 3).alias("r1"), F.substring("turn", 4, 3).alias("r2"),
    )
    levels = ["r1", "r2"]
    before = _running(rows, ["key"], levels, "size")
    inside = Window.partitionBy("key", *levels).orderBy("turn", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    queued = (
        rows.withColumn("inside", F.sum("size").over(inside))
        .join(before, ["key", *levels])
        .select("doc_id", "size", "turn", "key", (F.col("before") + F.col("inside")).alias("sent"))
        .join(goal.select("key", "source_size", "target"), "key")
    )
    queued = stored(queued)
    return _truncate(queued, goal, share, passes)


def _truncate(queued: DataFrame, goal: DataFrame, share: float, passes: int) -> DataFrame:
    """Take copies in order of finish time until the budget is reached."""
    finish = lambda k: (F.col("sent") + k * F.col("source_size")) / F.col("target")
    copies = queued.where("size > 0 and target > 0").select(
        "doc_id", "size", "turn", "key",
        F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), finish(k).alias("finish")) for k in range(passes)])).alias("c"),
    ).select("doc_id", "size", "turn", "key", "c.pass", "c.finish")
    # The budget can only end at a time over 2 in odd small cases; those times share the last range.
    copies = copies.withColumn("r1", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)))
    left = goal.agg(F.floor(F.sum("source_size") * F.lit(share))).first()[0] or 0
    edge, end = copies, None
    r1, left = _boundary(edge, "r1", left)
    if r1 is not None:
        edge = edge.where(F.col("r1") == r1).withColumn(
            "r2", F.least(F.floor((F.col("finish") * RANGES - F.col("r1")) * RANGES), F.lit(RANGES * RANGES))
        )
        r2, left = _boundary(edge, "r2", left)
        last = Window.orderBy(*ORDER, "pass").rowsBetween(Window.unboundedPreceding, 0)
        rim = edge.where(F.col("r2") == r2).withColumn("upto", F.sum("size").over(last))
        # The first copy that does not fit ends the mix; all before it are in.
        end = rim.where(F.col("upto") > left).agg(F.min(F.struct(*ORDER, "pass"))).first()[0]
    inside = lambda k: F.lit(True) if end is None else (
        F.struct(finish(k).alias("finish"), *ORDER[1:], F.lit(k).alias("pass"))
        < F.struct(*[F.lit(x).alias(name) for name, x in end.asDict().items()])
    )
    taken = sum(F.when(inside(k), F.col("size")).otherwise(F.lit(0)) for k in range(passes))
    return queued.select(
        "doc_id", "size", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("bigint").alias("taken"),
    )


def _boundary(rows: DataFrame, level: str, left: int) -> tuple[int | None, int]:
    """The one range in which the budget ends, and what is left of it there."""
    sums = rows.groupBy(level).agg(F.sum("size").alias("amount"))
    upto = F.sum("amount").over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    row = sums.withColumn("upto", upto).where(F.col("upto") > left).orderBy(level).first()
    return (None, left) if row is None else (row[level], left - row["upto"] + row["amount"])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(source IS NULL, false) AS none,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS turn
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM per),
weighed AS (
  SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM placed),
levelled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
cut AS (SELECT *, cap <= level * weight AS cut FROM levelled),
settled AS (SELECT arg_min(level, (cap / weight, place)) AS settled FROM cut WHERE NOT cut),
goal AS (
  SELECT source, source_size, budget,
         CASE WHEN cut OR settled IS NULL THEN cap ELSE settled * weight END AS target,
         coalesce('=' || source, '') AS key
  FROM cut LEFT JOIN settled ON true),
sent AS (
  SELECT doc_id, size, turn, coalesce('=' || source, '') AS key,
         sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized),
copies AS (
  SELECT s.*, pass, source_size, target, budget, (sent + pass * source_size) / target AS finish
  FROM sent s JOIN goal USING (key) CROSS JOIN (VALUES (0), (1)) p(pass) WHERE size > 0 AND target > 0),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, encode(key), turn, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS upto
  FROM copies),
took AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queue WHERE upto <= floor(budget) GROUP BY doc_id)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, g.source_size, g.target, coalesce(t.taken, 0) AS taken
FROM sent s JOIN goal g USING (key) LEFT JOIN took t USING (doc_id)
"""
