"""Incremental maintenance (IN1-IN5, JN14, SNK14, SNK16)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_hash
from corvane.operators import graph
from corvane.session import checkpointed


def changes(now: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """JN14/IN1/IN3: ``(key, status)``: added, modified, deleted or unchanged.

    ``now`` has ``(key, modified, hash)``, ``known`` ``(key, last_modified, content_hash)``.  A file
    is modified if its content's hash differs; a new time alone is no change.
    """
    both = now.select(key, "hash").join(known.select(F.col(key), "content_hash"), key, "full_outer")
    status = F.when(F.col("content_hash").isNull(), "added").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("content_hash"), "modified").otherwise("unchanged")
    return both.select(key, status.alias("status"))


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", content_hash(F.col(content)))


def provenance(files: DataFrame, nodes: DataFrame, edges: DataFrame, source_name: str = "") -> DataFrame:
    """SNK16: a row for each file with its hash and how many nodes and edges it gave."""
    n = nodes.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("node_count"))
    e = edges.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("edge_count"))
    out = (files if "hash" in files.columns else with_hash(files)).join(n, "path", "left").join(e, "path", "left")
    return out.select("path", F.lit(source_name).alias("source_name"), F.col("modified").alias("last_modified"), F.col("hash").alias("content_hash"), F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


def dependents(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """IN4: ``(path)`` of the files whose edges point at nodes of ``gone`` files."""
    ids = nodes.join(gone.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi").select(F.col("id").alias("target_id"))
    return edges.join(ids, "target_id", "left_semi").select(F.col("source_file").alias("path")).where("path IS NOT NULL").distinct().join(gone.select("path"), "path", "left_anti")


def update(files: DataFrame, nodes: DataFrame, edges: DataFrame, known: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IN5: ``(nodes, edges, changes)`` after adding, modifying and deleting.

    Rows of changed, deleted and dependent files are dropped, ``build`` makes those of changed
    and dependent files anew, both are joined by id.  The caller commits the frames at once.
    """
    found = checkpointed(changes(with_hash(files), known))
    touched = found.where("status <> 'unchanged'").select("path")
    touched = touched.unionByName(dependents(nodes, edges, found.where("status IN ('deleted', 'modified')").select("path"))).distinct()
    touched = checkpointed(touched)
    mine = touched.select(F.col("path").alias("source_file"))
    kept_nodes, kept_edges = nodes.join(mine, "source_file", "left_anti").select(*nodes.columns), edges.join(mine, "source_file", "left_anti").select(*edges.columns)
    new_nodes, new_edges = (checkpointed(x) for x in build(files.join(touched, "path", "left_semi")))
    all_nodes = kept_nodes.join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes, allowMissingColumns=True).select(*nodes.columns)
    all_edges = kept_edges.join(new_edges.select("id"), "id", "left_anti").unionByName(new_edges, allowMissingColumns=True).select(*edges.columns)
    for end in ("source_id", "target_id"):
        all_edges = all_edges.join(all_nodes.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns)
    all_edges = checkpointed(all_edges)
    return graph.prune_orphans(all_nodes, all_edges), all_edges, found


def fill_abstracts(chunks: DataFrame, generate, column: str = "l0_abstract", content: str = "content") -> DataFrame:
    """SNK14: a missing abstract made by ``generate`` (a column function); there ones stay."""
    return chunks.withColumn(column, F.coalesce(F.col(column), generate(F.col(content))))


def consistency(chunks: DataFrame, dimensions: int | None = None, vector: str = "embedding") -> DataFrame:
    """AG16/RT15: one row: chunks, vectors, the least and greatest number of dimensions, and whether all agree."""
    n = F.size(vector)
    out = chunks.agg(F.count("*").alias("chunks"), F.count(vector).alias("vectors"), F.min(n).alias("least"), F.max(n).alias("greatest"))
    fine = (F.col("chunks") == F.col("vectors")) & ((F.col("chunks") == 0) | (F.col("least") == F.col("greatest")))
    if dimensions is not None:
        fine = fine & ((F.col("chunks") == 0) | (F.col("greatest") == dimensions))
    return out.withColumn("consistent", fine)


class Consistency:
    """RT15: :func:`consistency` of a store, worked out again after ``ttl`` seconds, after a commit, or on demand."""

    def __init__(self, store, dimensions: int | None = None, ttl: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.store, self.dimensions, self.ttl, self.clock = store, dimensions, ttl, clock
        self._held: tuple[int, float, dict] | None = None

    def check(self, force: bool = False) -> dict:
        version, now = self.store.version, self.clock()
        if force or self._held is None or self._held[0] != version or now - self._held[1] >= self.ttl:
            found = consistency(self.store.read("chunks"), self.dimensions).first().asDict() if "chunks" in self.store.tables() else {"consistent": True}
            self._held = (version, now, found)
        return self._held[2]

    def invalidate(self) -> None:
        self._held = None

    def status(self) -> dict:
        """What is held, and how old it is; nothing is worked out."""
        if self._held is None:
            return {"cached": False, "consistent": None, "age_seconds": None, "ttl_seconds": self.ttl, "expired": True}
        age = self.clock() - self._held[1]
        return {"cached": True, "consistent": self._held[2]["consistent"], "age_seconds": round(age, 1), "ttl_seconds": self.ttl, "expired": age >= self.ttl}


def health(**tables: DataFrame) -> DataFrame:
    """AG16: ``(part, n)``: the rows of each store, one aggregation each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
