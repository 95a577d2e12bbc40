"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, e.g. ``documents``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (Spark names ignore case)."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{base}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{base}_{k}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (``local``) is a local folder set;
    on a cluster its absence is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "corvane-checkpoint")
        os.makedirs(at, exist_ok=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of texts in one Arrow batch, where this library runs the job itself.
TEXT_ROWS = 1_000


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs run within send texts to Python in batches of at most so many rows, which bounds what
    JVM and worker hold of them; the session's setting is put back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes what was written under a path of :func:`scratch_path`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, quoted, so that odd or clashing names elsewhere don't matter."""
    return df.select(*[df[f"`{n}`"] for n in names])


def bucket_order(*cols: Column) -> Column:
    """A fixed pseudo-random order of rows, the same on every run and layout."""
    return F.xxhash64(*cols)
