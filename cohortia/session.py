"""Spark session helpers.

The library never creates its own cluster settings in production: it takes the
session the caller built. ``local_session`` exists for tests, the bench and the
smoke entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry: ANSI-safe arithmetic is handled in the
# operators (try_divide / try_cast); these keep plans adaptive and times in UTC
# so dates match across engines.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cohortia") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("COHORTIA_DRIVER_MEM", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in
    local mode with the setting unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortia-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that several actions read; lost blocks recompute."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def settled(held: DataFrame) -> DataFrame:
    """A persisted table, written as a checkpoint and persisted once more without
    its plan; the first one is let go. Spark writes the whole plan of a persisted
    table into the plan text of every query, once for each place the table is read,
    and the driver keeps these texts: tables built on such tables multiply them."""
    shared_folder(held.sparkSession)                    # sets the checkpoint folder where unset
    out = keep(held.checkpoint())
    out.count()
    held.unpersist()
    return out


def packed(df: DataFrame, rows: int = 1, most: int | None = None) -> DataFrame:
    """Persist a table that many short jobs read, in at most two partitions a
    core and ``rows`` rows a partition at least: a shuffle's 200 partitions
    would cost each of these jobs 200 tasks, however few rows there are.
    ``most``: rows a partition at most, on average, which large tables get by
    more partitions (no more than they came in)."""
    held = keep(df)
    n, now = held.count(), held.rdd.getNumPartitions()
    cores = held.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, min(2 * cores, -(-n // rows)), -(-n // most) if most else 0)
    if now <= wanted:
        return held
    out = keep(held.coalesce(wanted))
    out.count()
    held.unpersist()
    return out
