"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Instants are UTC throughout; wall clocks only appear at the edges.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir``, which all executors can reach.

    A local session without the setting gets a temporary folder of its own. On
    a cluster without it there is no safe place, and the answer is None.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    return None


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="palisade-")
