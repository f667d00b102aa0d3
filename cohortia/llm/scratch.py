"""Tables written once in the shared checkpoint folder.

An intermediate result that several jobs read is written as Parquet in the
folder the session names in ``spark.checkpoint.dir``. Every executor sees that
folder, so a lost executor costs only its running tasks; and because the
planner knows the size of a written table, a join broadcasts it only below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with skew splitting)
beyond.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode
    with the setting unset (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortia-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cohortia-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.remove(path)


def discard(table: DataFrame) -> None:
    """Remove a table of ``written`` that no later step reads again."""
    _remove(table.sparkSession, table.scratch_path)


def clear(spark: SparkSession) -> None:
    """Remove every table this process has written and not yet discarded. Call
    it after the results that read them are stored elsewhere."""
    for path in list(_WRITTEN):
        _remove(spark, path)
