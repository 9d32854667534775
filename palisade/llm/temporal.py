"""URL filters over time: an as-of join of captures against dated list entries.

A list is a history of dated entries: at ``since`` an entry is added to or
removed from the list. Per entry key the dated rows become validity intervals,
from each addition to the next removal. A capture is judged against the entries
valid at its own fetch time: its URL has a key per level (the host and each
parent domain, the host with each leading folder of the path, and the whole path
without its query), and the most specific valid entry decides. ``block`` entries reject, ``allow`` entries
except what lies under them.

Each interval is filed under every bucket of time it touches, split at the
bucket's edges; a capture looks only into the bucket of its fetch time, so the
join is an equality of (key, bucket) with a range left to check. No key is
gathered anywhere: the captures of a host that has a third of all rows can be
split among tasks, as can its intervals. Buckets are ``DAYS`` long; an interval
without an end runs to the last bucket that holds a capture.

Null urls have no key and are never blocked; neither are captures without a
time. Of entries of one key and time a removal comes last. Repeated captures
get a row each. An empty list blocks nothing.
Only native functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stored

DAYS = 30
DAY = 86_400
#: Folders of a page that the list of the registered query is drawn from, as in its SQL; captures are judged by all.
LEVELS = 4


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def keys(url: Column, levels: int | None = None) -> Column:
    """Entry keys of a URL with how specific each is: parent domains, the host, its leading folders, and the page.

    With ``levels``, only so many folders and no page.
    """
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    # The last label alone is no entry; at most ``levels`` trailing labels and the whole host count.
    domains = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), n)),
        lambda k: F.struct(F.array_join(F.slice(parts, F.greatest(F.lit(1), n - k + 1), k), ".").alias("key"), k.alias("rank")),
    )
    path = F.split(F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^?#]*)", 1), "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(path) - 1) if levels is None else F.lit(levels)),
        lambda k: F.struct(
            F.when(F.size(path) > k, F.concat(host(url), F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/"), F.lit("/"))).alias("key"),
            (F.lit(100) + k).alias("rank"),
        ),
    )
    # A path that ends in a folder has that folder's key already.
    page = F.array(F.struct(
        F.when(F.element_at(path, -1) != "", F.concat(host(url), F.lit("/"), F.array_join(path, "/"))).alias("key"),
        (F.lit(100) + F.size(path)).alias("rank"),
    ))
    known = F.concat(domains, folders, page) if levels is None else F.concat(domains, folders)
    return F.when(F.length(host(url)) > 0, F.filter(known, lambda x: x["key"].isNotNull()))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (key, action, begins, ends) of dated rows (key, action, since, listed).

    ``ends`` is null for what is still listed. Adding what is listed changes
    nothing, nor does removing what is not. The history of one key is short,
    however many captures the key has.
    """
    order = Window.partitionBy("key", "action").orderBy("since", F.col("listed").desc())
    changes = entries.where("key is not null and since is not null").select("key", "action", "since", "listed").withColumn(
        "was", F.lag("listed", 1, False).over(order)
    ).where("listed <> was")
    return changes.withColumn("ends", F.lead("since").over(order)).where("listed").select(
        "key", "action", F.col("since").alias("begins"), "ends"
    ).where("ends is null or ends > begins")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched) with blocked, the deciding key, and how many entries were valid."""
    bucket = lambda c: F.floor(F.col(c) / (DAYS * DAY))
    asked = stored(captures.select("page_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id()))
    last = asked.agg(F.max(bucket("fetched")), F.min(bucket("fetched"))).first()
    probes = asked.select("row", "fetched", bucket("fetched").alias("bucket"), F.explode(keys(F.col("url"))).alias("k")).select(
        "row", "fetched", "bucket", "k.key", "k.rank"
    )
    upto = F.least(F.coalesce(bucket("ends"), F.lit(last[0])), F.lit(last[0]))
    since = F.greatest(bucket("begins"), F.lit(last[1]))
    filed = intervals(entries).where(since <= upto).withColumn("bucket", F.explode(F.sequence(since, upto)))
    valid = probes.join(filed, ["key", "bucket"]).where("begins <= fetched and (ends is null or fetched < ends)")
    verdict = valid.groupBy("row").agg(
        F.count("*").alias("n_valid"),
        # Of equally specific entries an exception wins.
        F.max(F.struct("rank", (F.col("action") == "allow").alias("allows"), "key")).alias("top"),
    )
    return asked.join(verdict, "row", "left").select(
        "page_id", "fetched",
        F.coalesce(~F.col("top.allows"), F.lit(False)).alias("blocked"),
        F.col("top.key").alias("decided_by"),
        F.coalesce("n_valid", F.lit(0)).cast("bigint").alias("n_valid"),
    )


# --- lists and fetch times derived from the pages, for the registered query --------

START = 1_700_000_000


def _digest(text: Column, at: int) -> Column:
    """Five hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 5), 16, 10).cast("bigint")


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture at a time within a year, set by its id."""
    return pages.select("page_id", "url", (F.lit(START) + _digest(F.col("page_id").cast("string"), 1) * 30).alias("fetched"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and folders the pages have.

    About a third of the keys is listed at some time, half of those are taken
    off again later, and a quarter of these listed once more.
    """
    known = pages.select(F.explode(keys(F.col("url"), LEVELS)).alias("k")).select("k.key", "k.rank").distinct()
    at = lambda n: START + _digest(F.col("key"), n) * 30
    listed = known.where(_digest(F.col("key"), 1) % 3 == 0).select(
        "key", F.when(_digest(F.col("key"), 6) % 4 == 0, "allow").otherwise("block").alias("action"),
        F.array(
            F.struct(at(11).alias("since"), F.lit(True).alias("listed")),
            F.when(_digest(F.col("key"), 16) % 2 == 0, F.struct((at(11) + _digest(F.col("key"), 16) * 7).alias("since"), F.lit(False).alias("listed"))),
            F.when(_digest(F.col("key"), 16) % 8 == 0, F.struct((at(11) + _digest(F.col("key"), 16) * 9).alias("since"), F.lit(True).alias("listed"))),
        ).alias("dates"),
    )
    return listed.select("key", "action", F.explode("dates").alias("d")).where("d is not null").select(
        "key", "action", "d.since", "d.listed"
    )


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_HEX = "CAST(('0x' || substr(md5({0}), {1}, 5)) AS BIGINT)"


def _hex(text: str, at: int) -> str:
    return _HEX.format(text, at)


SQL = f"""
WITH asked AS (
  SELECT page_id, {START} + {_hex("CAST(page_id AS VARCHAR)", 1)} * 30 AS fetched, row_number() OVER () AS rid,
         {_HOST} AS host, string_split({_HOST}, '.') AS parts,
         string_split(regexp_extract(url, '^[^:]+://[^/?#]+/([^?#]*)', 1), '/') AS path
  FROM pages),
probes AS (
  SELECT rid, fetched, array_to_string(list_slice(parts, greatest(1, len(parts) - k + 1), len(parts)), '.') AS key, k AS rank
  FROM asked, LATERAL (SELECT unnest(range(2, greatest(2, len(parts)) + 1)) AS k) WHERE length(host) > 0
  UNION ALL
  SELECT rid, fetched, host || '/' || array_to_string(list_slice(path, 1, k), '/') || '/' AS key, 100 + k AS rank
  FROM asked, LATERAL (SELECT unnest(range(1, {LEVELS + 1})) AS k) WHERE length(host) > 0 AND len(path) > k),
listed AS (
  SELECT key, CASE WHEN {_hex("key", 6)} % 4 = 0 THEN 'allow' ELSE 'block' END AS action,
         {START} + {_hex("key", 11)} * 30 AS a, {_hex("key", 16)} AS h
  FROM (SELECT DISTINCT key FROM probes) WHERE {_hex("key", 1)} % 3 = 0),
spans AS (
  SELECT key, action, a AS begins, CASE WHEN h % 2 = 0 THEN a + h * 7 END AS ends FROM listed
  UNION ALL
  SELECT key, action, a + h * 9, NULL FROM listed WHERE h % 8 = 0),
valid AS (
  SELECT p.rid, p.rank, p.key, s.action FROM probes p JOIN spans s ON p.key = s.key AND s.begins <= p.fetched
     AND (s.ends IS NULL OR (p.fetched < s.ends)) AND (s.ends IS NULL OR s.ends > s.begins)),
top AS (
  SELECT rid, key, action, count(*) OVER (PARTITION BY rid) AS n_valid,
         row_number() OVER (PARTITION BY rid ORDER BY rank DESC, action = 'allow' DESC, encode(key) DESC) AS place
  FROM valid)
SELECT page_id, fetched, coalesce(t.action = 'block', false) AS blocked, t.key AS decided_by,
       coalesce(t.n_valid, 0) AS n_valid
FROM asked a LEFT JOIN top t ON a.rid = t.rid AND t.place = 1
"""
