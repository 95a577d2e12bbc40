"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Input of less than this for each core may lie in fewer row groups than there are cores.
SMALL_PER_CORE = 64 << 20


def session(app: str = "corvane", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` come on top (dots as double underscores)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is read from few files of few bytes, so that work on each row keeps them busy.

    A file of one row group is one task however many cores there are; with a file for every other
    core the shuffle costs more than it saves.  Larger inputs, and frames that aren't read from
    files, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores / 2:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * SMALL_PER_CORE else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder of ``spark.checkpoint.dir``, its lineage cut.

    Only where the session names none and runs on one machine is a local folder set; on a
    cluster its absence is an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            at = os.path.join(tempfile.gettempdir(), "corvane-checkpoint")
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)
