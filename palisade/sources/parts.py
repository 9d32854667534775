"""Tables a stream adds small parts to, and packing those into few files.

A part is the rows one micro-batch of a run stored for one day: a folder
``event_date=.../ingest_run=.../ingest_batch=...``, which a repeated micro-batch
replaces. Parts are cheap to write and dear to read once there are thousands. ``pack``
rewrites a day's finished parts, and what was packed of it before, as a new
generation of files of about ``TARGET_BYTES``, in a folder beside the table. The
generation counts from the moment a log row names it and says up to which
micro-batch of each run it holds that day. Readers take each day's newest generation and
the parts it does not hold. So nobody ever sees rows twice or not at all:

* A reader that began before goes on with the files it listed: ``vacuum`` deletes what is
  no longer needed only after a grace period.
* A micro-batch repeated after it was packed writes a part that the generation
  already holds, and readers leave it out.
* A pack that dies leaves a folder no log row names. Of two packs at once the later row
  counts, and either is whole.

Finished are the micro-batches of a run that has begun a later one: a stream starts a
micro-batch only when the one before is committed. The newest stays as it is, and so does
what was appended as a run of its own. A stream that reads the table's folder as its source
sees each part once, as packing adds no files there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ["event_date", "ingest_run", "ingest_batch"]
PARTITION_FIELDS = [
    T.StructField("event_date", T.DateType()), T.StructField("ingest_run", T.StringType()), T.StructField("ingest_batch", T.LongType()),
]
TARGET_BYTES = 128 << 20
GRACE = timedelta(hours=6)

# Beyond this many days a read lists the whole table.
_MOST_DAYS = 1000
_LOG = "event_date date, generation string, ingest_run string, upto bigint, packed_at timestamp"

Days = list[tuple[date | None, date]]


@dataclass(frozen=True)
class Pack:
    """The newest generation of a day and the last micro-batch of each run that it holds."""

    generation: str
    upto: dict[str, int]
    packed_at: datetime


def packed_folder(path: str) -> str:
    return f"{path.rstrip('/')}-packed"


def _log_folder(path: str) -> str:
    return f"{path.rstrip('/')}-packs"


def stamped(rows: DataFrame, run: str, ingest_batch: int) -> DataFrame:
    """Rows with the run and the batch that stored them."""
    return rows.withColumns({"ingest_run": F.lit(run), "ingest_batch": F.lit(ingest_batch).cast("bigint")})


def replace(rows: DataFrame, path: str, run: str, ingest_batch: int) -> None:
    """Write the rows (with ``event_date``) of one micro-batch, replacing what an earlier try of the same run left behind."""
    (
        stamped(rows, run, ingest_batch)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def _found(load: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return load()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def _names(days: Days) -> list[str] | None:
    """The days as partition names; None where they are too many to name."""
    names: set[str] = set()
    for first, last in days:
        span = (last - (first or date.min)).days + 1
        if len(names) + span > _MOST_DAYS:
            return None
        names.update(((first or date.min) + timedelta(days=n)).isoformat() for n in range(span))
    return sorted(names)


def _loose(spark: SparkSession, path: str, schema: T.StructType, days: Days | None) -> DataFrame | None:
    """The parts of some days; None where there are none."""
    names = None if days is None else _names(days)
    folder = f"{path}/event_date=*" if names is None else f"{path}/event_date={{{','.join(names)}}}"
    if days is None:
        folder = path
    elif names == []:
        return None
    found = _found(lambda: spark.read.schema(schema).option("basePath", path).parquet(folder))
    if found is not None and days is not None and names is None:
        day = lambda value: F.lit(value.isoformat()).cast("date")
        ranges = [F.col("event_date").between(day(a or date.min), day(b)) for a, b in days]
        found = found.where(reduce(lambda x, y: x | y, ranges))
    return found


def packs(spark: SparkSession, path: str) -> dict[date, Pack]:
    """The newest generation of each packed day. A row per day and run reaches the driver."""
    log = _found(lambda: spark.read.schema(_LOG).parquet(_log_folder(path)))
    if log is None:
        return {}
    held = F.sort_array(F.collect_list(F.struct("ingest_run", "upto"))).alias("held")
    each = log.groupBy("event_date", "generation").agg(F.unix_micros(F.max("packed_at")).alias("packed"), held)
    newest = each.groupBy("event_date").agg(F.max(F.struct("packed", "generation", "held")).alias("newest"))
    return {
        r["event_date"]: Pack(
            r["generation"], {h["ingest_run"]: h["upto"] for h in r["held"]},
            datetime.fromtimestamp(r["packed"] / 1e6, timezone.utc),
        )
        for r in newest.select("event_date", "newest.*").collect()
    }


def _held(spark: SparkSession, found: dict[date, Pack]) -> DataFrame:
    rows = [(day, run, upto) for day, pack in found.items() for run, upto in pack.upto.items()]
    return spark.createDataFrame(rows, "held_date date, held_run string, held_upto bigint")


def _of(rows: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """Parts that ``held`` holds (left_semi), or does not (left_anti). It has a row per day and run, as counted on the driver."""
    on = (F.col("event_date") == F.col("held_date")) & (F.col("ingest_run") == F.col("held_run"))
    return rows.join(F.broadcast(held), on & (F.col("ingest_batch") <= F.col("held_upto")), kind)


def _generations(spark: SparkSession, path: str, schema: T.StructType, found: dict[date, Pack]) -> DataFrame:
    kept = T.StructType([*schema.fields, T.StructField("generation", T.StringType())])
    folders = [f"{packed_folder(path)}/event_date={day.isoformat()}/generation={pack.generation}" for day, pack in found.items()]
    return spark.read.schema(kept).option("basePath", packed_folder(path)).parquet(*folders).select(*schema.fieldNames())


def read(spark: SparkSession, path: str, schema: T.StructType, days: Days | None = None) -> DataFrame:
    """All rows of some days (None: of all), with the columns of ``schema``, which end with ``PARTITIONS``.

    Only the days named are listed, and a table of which nothing is there reads as
    empty unless all of it is asked for.
    """
    found = packs(spark, path)
    if days is not None:
        found = {day: pack for day, pack in found.items() if any((a is None or a <= day) and day <= b for a, b in days)}
    loose = _loose(spark, path, schema, days)
    if loose is None and (found or days is not None):
        loose = spark.createDataFrame([], schema)
    if loose is None:
        return spark.read.schema(schema).parquet(path)  # says that there is no such table
    if not found:
        return loose
    return _of(loose, _held(spark, found), "left_anti").unionByName(_generations(spark, path, schema, found))


def _files(spark: SparkSession, folder: str) -> DataFrame | None:
    """File, bytes and partition values below a folder, told by names alone."""
    listed = _found(lambda: (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    ))
    if listed is None:
        return None
    value = lambda name: F.url_decode(F.replace(
        F.regexp_extract("path", f"/{name}=([^/]*)", 1), F.lit("+"), F.lit("%2B")
    ))
    return listed.select(
        F.col("length").alias("bytes"), value("event_date").try_cast("date").alias("event_date"),
        value("ingest_run").alias("ingest_run"), value("ingest_batch").try_cast("bigint").alias("ingest_batch"),
        value("generation").alias("generation"),
    ).where("event_date is not null")


def _finished(files: DataFrame) -> DataFrame:
    """Parts of micro-batches that will not be repeated, with the last such number of their run."""
    newest = files.groupBy("ingest_run").agg((F.max("ingest_batch") - 1).alias("upto"))
    return files.join(newest, "ingest_run").where("ingest_batch <= upto")


def pack(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    order: list[str],
    combine: Callable[[DataFrame], DataFrame] | None = None,
    target_bytes: int = TARGET_BYTES,
    now: datetime | None = None,
) -> int:
    """Pack every day that has finished parts not packed yet; returns how many days.

    ``order`` sorts the rows of a file. ``combine`` may add rows up, day by day; its rows
    need run and batch too, but may leave them null. A row per day and run reaches the driver.
    """
    files = _files(spark, path)
    if files is None:
        return 0
    found = packs(spark, path)
    sizes = _finished(files).groupBy("event_date", "ingest_run", "ingest_batch", "upto").agg(F.sum("bytes").alias("bytes"))
    if found:
        sizes = _of(sizes, _held(spark, found), "left_anti")
    todo = sizes.groupBy("event_date", "ingest_run").agg(F.max("upto").alias("upto"), F.sum("bytes").alias("bytes")).collect()
    if not todo:
        return 0
    days: dict[date, dict[str, int]] = {}
    room: dict[date, int] = {}
    for row in todo:
        days.setdefault(row["event_date"], {})[row["ingest_run"]] = row["upto"]
        room[row["event_date"]] = room.get(row["event_date"], 0) + row["bytes"]
    before = {day: found[day] for day in days if day in found}
    if before:
        old = _files(spark, packed_folder(path)).groupBy("event_date", "generation").agg(F.sum("bytes").alias("bytes"))
        wanted = spark.createDataFrame([(d, p.generation) for d, p in before.items()], "event_date date, generation string")
        for row in old.join(F.broadcast(wanted), ["event_date", "generation"]).collect():
            room[row["event_date"]] += row["bytes"]
    stamp = now or datetime.now(timezone.utc)
    made = uuid.uuid4().hex
    whole = {
        day: Pack(made, {**(before[day].upto if day in before else {}), **runs}, stamp) for day, runs in days.items()
    }
    loose = _of(_loose(spark, path, schema, [(d, d) for d in days]), _held(spark, whole), "left_semi")
    if before:
        loose = _of(loose, _held(spark, before), "left_anti").unionByName(_generations(spark, path, schema, before))
    rows = loose if combine is None else combine(loose)
    first, pieces = 0, []
    for day in sorted(whole):
        n = -(-room[day] // target_bytes)
        pieces.append((day, first, n))
        first += n
    dealt = rows.join(
        F.broadcast(spark.createDataFrame(pieces, "event_date date, first int, pieces int")), "event_date"
    ).withColumn("piece", F.col("first") + F.pmod(F.xxhash64(*order), F.col("pieces")).cast("int"))
    (
        dealt.repartitionById(first, "piece").drop("first", "pieces", "piece")
        .withColumn("generation", F.lit(made)).sortWithinPartitions("event_date", *order)
        .write.mode("append").partitionBy("event_date", "generation").parquet(packed_folder(path))
    )
    log = [(day, made, run, upto, stamp) for day, p in whole.items() for run, upto in p.upto.items()]
    spark.createDataFrame(log, _LOG).coalesce(1).write.mode("append").parquet(_log_folder(path))
    return len(whole)


def vacuum(spark: SparkSession, path: str, now: datetime | None = None, grace: timedelta = GRACE) -> int:
    """Delete parts and generations that a newer generation has replaced for longer than the grace period; returns folders."""
    limit = (now or datetime.now(timezone.utc)) - grace
    old = {day: p for day, p in packs(spark, path).items() if p.packed_at <= limit}
    if not old:
        return 0
    folders = set()
    parts = _files(spark, path)
    if parts is not None:
        names = _of(parts, _held(spark, old), "left_semi").select(*PARTITIONS).distinct()
        folders |= {
            f"{path}/event_date={r[0].isoformat()}/ingest_run={_escaped(spark, r[1])}/ingest_batch={r[2]}" for r in names.collect()
        }
    # Only what the log once named: a generation being written now is in no row of it yet.
    log = spark.read.schema(_LOG).parquet(_log_folder(path)).select("event_date", "generation").distinct()
    kept = spark.createDataFrame([(d, p.generation) for d, p in old.items()], "event_date date, newest string")
    gone = log.join(F.broadcast(kept), "event_date").where("generation <> newest").select("event_date", "generation")
    folders |= {f"{packed_folder(path)}/event_date={d.isoformat()}/generation={g}" for d, g in gone.collect()}
    return sum(_delete(spark, f) for f in sorted(folders))


def _escaped(spark: SparkSession, name: str) -> str:
    """A partition value as Spark writes it in a path."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _delete(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
