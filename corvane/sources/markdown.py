"""Sources of files and rows (SRC1, SRC2, SRC4, and the driver's tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.analyzers import note_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """SRC1: ``(path, content, modified, length)`` of all matching files below a folder, paths relative to it; blank files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    out = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"), "length")
    return out.where(F.rlike("content", F.lit(r"\S")))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: a single Markdown file."""
    if not path.endswith(".md"):
        raise ValueError("only .md files can be added")
    folder, _, name = path.rpartition("/")
    return files(spark, folder or ".", name)


def notes(found: DataFrame, source_name: str = "") -> DataFrame:
    """SRC2: a note node for each file, its text kept."""
    words = F.size(F.filter(F.split(F.trim("content"), r"\s+"), lambda w: w != ""))
    return found.select(note_id(F.col("path")).alias("id"), F.lit("note").alias("type"), tx.title_from_filename(F.col("path")).alias("title"), "content", F.col("modified").alias("created_at"), F.col("path").alias("source_file"), F.lit(source_name).alias("source_name"), words.alias("word_count"), F.length("content").alias("char_count"))
