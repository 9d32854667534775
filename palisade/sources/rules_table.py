"""Alert rules: checked definitions, sequential ids, and the table they live in.

Several writers may define rules at once. Numbers are reserved as ranges, each a small
file whose name is its first number and whose content is how many it takes. A
range begins where the last one ends, and its file appears whole or not at all,
and only if no other has that name: of two writers that reach for the same numbers
one gets them, and the other looks again. Ranges are disjoint and leave no gap;
a writer that dies after reserving leaves its numbers unused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade import schema

_ID_PREFIX = "rule-"
_RUN_BITS = 12
_RUN = 1 << _RUN_BITS


_KNOWN = ", ".join(f"'{name}'" for name in schema.CATEGORIES)

# Field, message, and the SQL condition under which it is reported.
CONSTRAINTS = [
    ("category", "must not be null", "category is null"),
    ("category", f"must be one of {', '.join(schema.CATEGORIES)}", f"category not in ({_KNOWN})"),
    ("threshold", "must be greater than or equal to 1", "coalesce(threshold, 0) < 1"),
    ("windowMinutes", "must be greater than or equal to 1", "coalesce(window_minutes, 0) < 1"),
]


def valid_definitions(requests: DataFrame) -> DataFrame:
    """Definitions with a known category, a threshold and a window of at least 1."""
    return requests.where(
        F.col("category").isin(schema.CATEGORIES)
        & (F.col("threshold") >= 1)
        & (F.col("window_minutes") >= 1)
    )


def definition_errors(requests: DataFrame, order: str = "seq") -> DataFrame:
    """A row ``order, field, message`` per broken constraint of the definitions that ``define`` refuses."""
    found = F.array_compact(F.array(*[
        F.when(F.expr(broken), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
        for field, message, broken in CONSTRAINTS
    ]))
    return requests.select(order, F.explode(found).alias("error")).select(order, "error.field", "error.message")


def define(requests: DataFrame, existing: DataFrame | None = None, order: str = "seq", base: int = 0) -> DataFrame:
    """Valid definitions with ids ``rule-N`` that go on from the existing ones, or from ``base``.

    ``order`` is a column of distinct whole numbers telling the order of
    definition. Rows are numbered within runs of that column, each of a fixed
    largest size, and a run starts where the ones before it end. Where runs lie
    is found the same way, by runs of runs, until few enough are left.
    """
    run = F.shiftright(F.col(order).cast("bigint"), _RUN_BITS)
    rows = valid_definitions(requests).withColumn("run", run)
    sizes = rows.groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    ends = rows.agg(F.min("run").alias("low"), F.max("run").alias("high")).first()
    starts = _starts(sizes, ends["low"] or 0, ends["high"] or 0)
    if existing is not None:
        base = _last_number(existing)
    place = F.row_number().over(Window.partitionBy("run").orderBy(order))
    return (
        rows.withColumn("place", place)
        .join(starts, "run")
        .select(
            F.concat(F.lit(_ID_PREFIX), (F.lit(base) + F.col("start") + F.col("place")).cast("string")).alias("id"),
            F.col("config_id").cast("bigint").alias("config_id"),
            "category",
            F.col("threshold").cast("int").alias("threshold"),
            F.col("window_minutes").cast("int").alias("window_minutes"),
        )
    )


def _last_number(rules: DataFrame) -> int:
    number = F.substring("id", len(_ID_PREFIX) + 1, 20).cast("bigint")
    return rules.agg(F.coalesce(F.max(number), F.lit(0)).alias("last")).first()["last"]


def _starts(sizes: DataFrame, low: int, high: int) -> DataFrame:
    """``(run, start)``: the sizes before each run, where runs lie in ``low..high``; no window holds over ``_RUN`` rows."""
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda window: F.coalesce(F.sum("size").over(window), F.lit(0))
    if high - low < _RUN:
        return sizes.select("run", sum_before(before).alias("start"))
    grouped = sizes.withColumn("group", F.shiftright("run", _RUN_BITS))
    groups = grouped.groupBy(F.col("group").alias("run")).agg(F.sum("size").alias("size"))
    of_group = _starts(groups, low // _RUN, high // _RUN).select(F.col("run").alias("group"), F.col("start").alias("base"))
    inside = grouped.withColumn("inside", sum_before(
        Window.partitionBy("group").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ))
    return inside.join(of_group, "group").select("run", (F.col("base") + F.col("inside")).alias("start"))


class _Ranges:
    """The reserved ranges of a rules table: files in a folder beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-ids")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self.fs.makeQualified(self.folder)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def last(self) -> int | None:
        """The last number reserved, None before the first range."""
        if not self.fs.exists(self.folder):
            return None
        # Names are padded, so the last in order is the range with the highest numbers.
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        names = sorted(n for n in names if n.isdigit())
        if not names:
            return None
        stream = self.fs.open(self._path(names[-1]))
        try:
            return int(names[-1]) + stream.readLong() - 1
        finally:
            stream.close()

    def publish(self, first: int, size: int) -> bool:
        """Make the range's file appear with its content; False if another has that name."""
        name, draft = self._path(f"{first:020d}"), self._path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.writeLong(size)
        stream.close()
        try:
            if self.folder.toUri().getScheme() == "file":
                # Here a rename may replace what is there; a link never does.
                place = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(place(name), place(draft))
                return True
            return not self.fs.exists(name) and self.fs.rename(draft, name)
        except Exception as taken:
            if "FileAlreadyExists" not in str(taken):
                raise
            return False
        finally:
            self.fs.delete(draft, False)


def reserve(spark: SparkSession, path: str, size: int) -> int:
    """Reserve ``size`` numbers for rules of the table at ``path``; returns the number before the first.

    The first reservation goes on from the rules that the table holds. File systems
    must refuse to rename a file onto another, as HDFS does, or be local.
    """
    ranges = _Ranges(spark, path)
    while True:
        last = ranges.last()
        if last is None:
            last = _last_number(read(spark, path)) if ranges.fs.exists(ranges.jvm.org.apache.hadoop.fs.Path(path)) else 0
        if not size or ranges.publish(last + 1, size):
            return last


def define_into(requests: DataFrame, path: str, order: str = "seq") -> DataFrame:
    """Define rules and append them to a table, whoever else does so at the same time; returns the rules.

    The definitions are read twice and must not change in between.
    """
    spark = requests.sparkSession
    size = valid_definitions(requests).count()
    rules = define(requests, order=order, base=reserve(spark, path, size))
    append(rules, path)
    return rules


def append(rules: DataFrame, path: str) -> None:
    """Add rules to the table, as a folder of their own: writers at the same time would clear each other's unfinished files."""
    rules.select(*schema.ALERT_RULE.fieldNames()).write.parquet(f"{path.rstrip('/')}/added-{uuid.uuid4().hex}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ALERT_RULE).option("recursiveFileLookup", True).parquet(path)
