"""Graph operators over ``nodes`` and ``edges`` frames (GR1-GR11, JN4, JN5, JN13, SNK8-SNK11, AG5, AG7, FLT7).

Edges are stored directed and walked both ways.  Walks are joins of the frontier with the
edges, one hop a step, with lineage cut by checkpoints; no node set has to fit one machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ranking import numbered
from corvane.session import checkpointed

#: An adjacency list of at most so many edges, in both directions, is broadcast for betweenness: 4 bytes each, and 4 a node.
MAX_BROADCAST_EDGES = 20_000_000


def undirected(edges: DataFrame, *cols: str) -> DataFrame:
    """``(u, v, cols...)`` in both directions; self-loops once."""
    a = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), *cols)
    return a.unionByName(edges.where("source_id <> target_id").select(F.col("target_id").alias("u"), F.col("source_id").alias("v"), *cols))


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """GR1: ``(start, node, distance)`` within ``depth`` hops (1 to 3) of each row ``(start)``, without the start."""
    if not 1 <= depth <= 3:
        raise ValueError("depth has to be 1, 2 or 3")
    both = undirected(edges).distinct()
    seen = start.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(both, frontier["node"] == both["u"]).select("start", F.col("v").alias("node"), F.lit(d).alias("distance")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        if d < depth:
            frontier = checkpointed(frontier)
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def find_by_title(nodes: DataFrame, title: str, kind: str | None = None) -> DataFrame:
    """The one node meant by a part of a title: the shortest title that holds it, then the least id."""
    hits = nodes.where(F.contains(F.lower("title"), F.lit(title.lower())))
    if kind:
        hits = hits.where(F.col("type") == kind)
    return hits.orderBy(F.length("title"), "id").limit(1)


def connections(nodes: DataFrame, edges: DataFrame, title: str, depth: int = 2) -> DataFrame:
    """GR2: the found node's neighbourhood by the type of the edge that first reaches each node.

    ``(type, n, connections)`` with connections as sorted structs ``(distance, node, weight, confidence)``.
    """
    centre = checkpointed(find_by_title(nodes, title).select(F.col("id").alias("start")))
    near = checkpointed(neighbours(edges, centre, depth).unionByName(centre.select("start", F.col("start").alias("node"), F.lit(0).alias("distance"))))
    both = undirected(edges, "id", "type", "weight", "confidence")
    prev = near.select(F.col("node").alias("u"), (F.col("distance") + 1).alias("distance"))
    reach = near.where("distance > 0").join(both, F.col("node") == F.col("v")).join(prev, ["u", "distance"])
    first = reach.groupBy("node", "distance").agg(F.min_by(F.struct("type", "weight", "confidence"), F.struct("id", "u")).alias("e"))
    return first.groupBy("e.type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("distance", "node", "e.weight", "e.confidence"))).alias("connections"))


def similar_nodes(nodes: DataFrame, edges: DataFrame, node_id, limit: int = 5) -> DataFrame:
    """GR3/TK7: nodes joined by a ``similar_to`` edge, heaviest first."""
    e = undirected(edges.where("type = 'similar_to'"), "weight").where(F.col("u") == node_id)
    return e.join(nodes, e["v"] == nodes["id"]).select("id", "title", "weight").orderBy(F.desc("weight"), "id").limit(limit)


def shortest_path(edges: DataFrame, source, target, max_nodes: int = 6) -> DataFrame:
    """GR4: ``(path, distance)``, or no row beyond ``max_nodes`` nodes; of equally short paths the least.

    Bounded by hops where the reference bounds visits, so no path that short is missed.
    """
    both = undirected(edges).distinct()
    frontier = edges.sparkSession.createDataFrame([(source,)], f"node {edges.schema['source_id'].dataType.simpleString()}").select("node", F.array("node").alias("path"))
    seen = frontier.select("node")
    for _ in range(max_nodes):
        hit = frontier.where(F.col("node") == target).limit(1)
        if hit.count():
            return hit.select("path", (F.size("path") - 1).alias("distance"))
        step = frontier.join(both, frontier["node"] == both["u"]).join(seen.withColumnRenamed("node", "v"), "v", "left_anti")
        frontier = checkpointed(step.groupBy("v").agg(F.min(F.concat("path", F.array("v"))).alias("path")).withColumnRenamed("v", "node").where(F.size("path") <= max_nodes))
        if not frontier.count():
            break
        seen = checkpointed(seen.unionByName(frontier.select("node")))
    return frontier.limit(0).select("path", (F.size("path") - 1).alias("distance"))


def topic_web(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    """GR5/JN5: the topic node's neighbours over any edge, heaviest edge first: ``(id, title, type, weight)``."""
    centre = find_by_title(nodes, topic, "topic").select(F.col("id").alias("u"))
    near = undirected(edges, "weight").join(F.broadcast(centre), "u").groupBy("v").agg(F.max("weight").alias("weight"))
    return near.join(nodes, near["v"] == nodes["id"]).select("id", "title", "type", "weight").orderBy(F.desc("weight"), "id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN4/AG5: ``(id, title, degree)``: distinct edges at each node, 0 included.

    The condition "source or target" is split into two equal joins, which Spark would else run
    as a nested loop.
    """
    ends = undirected(edges, "id").groupBy(F.col("u").alias("id")).agg(F.count_distinct(F.col("id")).alias("degree"))
    return nodes.select("id", "title").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def hub_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """GR6/TK8."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(limit)


def edges_of(edges: DataFrame, node_id, direction: str = "both") -> DataFrame:
    """FLT7."""
    out, into = F.col("source_id") == node_id, F.col("target_id") == node_id
    return edges.where({"out": out, "in": into, "both": out | into}[direction])


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    """GR7: latest first."""
    return nodes.where(F.col("type") == kind).orderBy(F.desc("created_at"), "id")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR11/AG7: ``(part, type, n)`` for nodes and edges."""
    one = lambda df, p: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "type", "n")
    return one(nodes, "nodes").unionByName(one(edges, "edges"))


def merge_duplicates(nodes: DataFrame, edges: DataFrame, order: Column | str = "id") -> tuple[DataFrame, DataFrame]:
    """GR8: nodes of equal type and title (trimmed, any case) become the first of them; edges follow, self-loops go.

    An edge whose end changed gets the id ``type_source_target``.
    """
    w = Window.partitionBy("type", F.lower(F.trim("title"))).orderBy(order)
    named = nodes.withColumn("__first", F.first("id").over(w))
    kept = named.where("id = __first").drop("__first")
    to = named.where("id <> __first").select(F.col("id").alias("__old"), F.col("__first").alias("__new"))
    out = edges.join(to.withColumnsRenamed({"__old": "source_id", "__new": "__s"}), "source_id", "left").join(to.withColumnsRenamed({"__old": "target_id", "__new": "__t"}), "target_id", "left")
    s, t = F.coalesce("__s", "source_id"), F.coalesce("__t", "target_id")
    changed = F.col("__s").isNotNull() | F.col("__t").isNotNull()
    out = out.withColumns({"id": F.when(changed, F.concat_ws("_", "type", s, t)).otherwise(F.col("id")), "source_id": s, "target_id": t})
    return kept, out.where("source_id <> target_id").select(*edges.columns).dropDuplicates(["id"])


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN13/SNK8: edges one of whose ends doesn't exist."""
    ids = nodes.select(F.col("id").alias("__id"))
    return edges.join(ids, edges["source_id"] == ids["__id"], "left_anti").unionByName(edges.join(ids, edges["source_id"] == ids["__id"], "left_semi").join(ids, F.col("target_id") == F.col("__id"), "left_anti"))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame, strict: bool = True) -> DataFrame:
    """SNK8/SNK9: upsert by id without self-loops.  Dangling edges raise, or are skipped if not ``strict``."""
    new = new.where("source_id <> target_id").dropDuplicates(["id"])
    if not new.where(~(F.col("weight").between(0, 1) & F.col("confidence").between(0, 1))).isEmpty():
        raise ValueError("weights and confidences lie between 0 and 1")
    if strict:
        if not integrity(nodes, new).isEmpty():
            raise ValueError("an edge's end doesn't exist")
    else:
        ids = nodes.select("id")
        for end in ("source_id", "target_id"):
            new = new.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK10: nodes ``(id)`` and the edges at them."""
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), edges


def remove_source_file(nodes: DataFrame, edges: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """SNK10: a file's nodes and edges, then the nodes that nothing holds any more (notes stay)."""
    mine = F.coalesce(F.col("source_file") == file, F.lit(False))
    nodes, edges = remove_nodes(nodes.where(~mine), edges.where(~mine), nodes.where(mine).select("id"))
    return prune_orphans(nodes, edges), edges


def prune_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Without the nodes that no edge touches, but with all notes."""
    used = undirected(edges).select(F.col("u").alias("id")).distinct()
    return nodes.where("type = 'note'").unionByName(nodes.where("type <> 'note'").join(used, "id", "left_semi").select(*nodes.columns))


def weak_edges_removed(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """GR9, its first part."""
    return edges.where(F.col("weight") >= least)


def prune_greedy(edges: DataFrame, least: float = 0.3, cap: int = 50) -> DataFrame:
    """GR9 exactly: by falling weight, an edge stays iff both its ends have fewer than ``cap`` kept edges.

    The order makes this sequential, so it runs in one task over ids and weights only (what makes
    the edges stays parallel); meant
    for graphs whose edge list one executor can stream.  :func:`prune_ranked` scales.
    """
    cols = edges.select("id", "source_id", "target_id", "weight").where(F.col("weight") >= least).repartition(1).sortWithinPartitions(F.desc("weight"), "id")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict = {}
        for b in batches:
            good = []
            for s, t in zip(b["source_id"], b["target_id"]):
                ok = n.get(s, 0) < cap and n.get(t, 0) < cap
                good.append(ok)
                if ok:
                    n[s], n[t] = n.get(s, 0) + 1, n.get(t, 0) + 1
            if any(good):
                yield b.loc[good, ["id"]]

    return edges.join(cols.mapInPandas(keep, f"id {edges.schema['id'].dataType.simpleString()}"), "id", "left_semi")


def prune_ranked(edges: DataFrame, least: float = 0.3, cap: int = 50) -> DataFrame:
    """[ext] The scalable variant: an edge stays iff it is among the ``cap`` heaviest at both ends."""
    strong = weak_edges_removed(edges, least)
    rank = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("weight"), "id"))
    return strong.withColumn("__s", rank("source_id")).withColumn("__t", rank("target_id")).where((F.col("__s") <= cap) & (F.col("__t") <= cap)).drop("__s", "__t")


def _broadcast_passes(both: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """:func:`_tree_passes`, each tree in one task over a broadcast adjacency list.

    Nodes stand as their places in the order of ids, so the list is two arrays of whole numbers, 4
    bytes an edge and a node each.
    """
    spark = both.sparkSession
    places = numbered(nodes, "id", name="place").select("id", (F.col("place") - 1).cast("int").alias("place"))
    ends = both.join(places.select(F.col("id").alias("u"), F.col("place").alias("x")), "u").join(places.select(F.col("id").alias("v"), F.col("place").alias("y")), "v")
    held = ends.select("x", "y").toArrow()
    x, y = (held[c].to_numpy() for c in "xy")
    starts = np.append(0, np.cumsum(np.bincount(x, minlength=int(x.max(initial=-1)) + 1))).astype(np.int32)
    sent = spark.sparkContext.broadcast((starts, y[np.lexsort((y, x))].astype(np.int32)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, near = sent.value
        n = len(starts) - 1
        total, mark, first = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for b in batches:
            for root in b.column(0).to_pylist():
                _add_tree(root, starts, near, total, mark, first)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["place", "through"])

    tasks = max(16, 2 * spark.sparkContext.defaultParallelism)
    passes = roots.join(places, "id").select("place").repartition(tasks).mapInArrow(walk, "place int, through long").groupBy("place").agg(F.sum("through").alias("through"))
    return passes.join(places, "place").select("id", "through")


def _add_tree(root: int, starts: np.ndarray, near: np.ndarray, total: np.ndarray, mark: np.ndarray, first: np.ndarray) -> None:
    """Adds to ``total`` how many paths of the breadth-first tree from ``root`` a node lies inside, a level at a time.

    ``mark`` tells the nodes of this tree by its root, ``first`` is scratch space.
    """
    mark[root] = root
    level = np.array([root])
    parents, levels = [], [level]
    while True:
        n = starts[level + 1] - starts[level]
        size = int(n.sum(dtype=np.int64))
        at = np.arange(size, dtype=np.int32) + np.repeat((starts[level] - np.cumsum(n) + n).astype(np.int32), n)
        found, parent = near[at], np.repeat(np.arange(len(level), dtype=np.int32), n)
        new = mark[found] != root
        found, parent = found[new], parent[new]
        if not len(found):
            break
        # of several parents the first of the queue: the last to be written, as writing goes backwards
        place = np.arange(len(found), dtype=np.int32)
        first[found[::-1]] = place[::-1]
        new = first[found] == place
        level = found[new]
        mark[level] = root
        parents.append(parent[new])
        levels.append(level)
    below = np.zeros(len(level), np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        total[levels[depth]] += below
        below = np.bincount(parents[depth - 1], weights=below + 1, minlength=len(levels[depth - 1])).astype(np.int64)


def _tree_passes(both: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, through)``: how often a node lies inside a path of the breadth-first trees from ``roots``.

    All trees grow together, a level a round, by joins of the frontier with ``both``; a node's
    parent is the first of the level before in the order of a queue, as in a walk of one machine.
    """
    both = checkpointed(both)
    root = F.col("id").alias("root")
    before = checkpointed(roots.select(root, F.col("id").alias("node"), F.lit(1).cast("long").alias("place")))
    levels, older = [], before.limit(0)
    while True:
        step = before.join(both, before["node"] == both["u"]).groupBy("root", "v").agg(F.min(F.struct("place", "node")).alias("p"))
        # a neighbour lies in the same level, the one before or the next
        seen = before.unionByName(older).select("root", F.col("node").alias("v"))
        new = step.join(seen, ["root", "v"], "left_anti")
        order = F.row_number().over(Window.partitionBy("root").orderBy("p.place", "v")).cast("long")
        level = checkpointed(new.select("root", F.col("v").alias("node"), F.col("p.node").alias("parent"), order.alias("place")))
        if not level.take(1):
            break
        levels.append(level)
        older, before = before, level.select("root", "node", "place")
    below = roots.select(root, F.col("id").alias("node"), F.lit(0).cast("long").alias("below")).limit(0)
    through = below.select(F.col("node").alias("id"), F.col("below").alias("through"))
    for level in reversed(levels):
        here = checkpointed(level.join(below, ["root", "node"], "left").select("root", "node", "parent", F.coalesce("below", F.lit(0)).alias("below")))
        through = checkpointed(through.unionByName(here.where("below > 0").select(F.col("node").alias("id"), F.col("below").alias("through"))).groupBy("id").agg(F.sum("through").alias("through")))
        below = here.groupBy("root", F.col("parent").alias("node")).agg(F.sum(F.col("below") + 1).alias("below"))
    return through


def importance(edges: DataFrame, sources: int = 500, seed: int = 42) -> DataFrame:
    """GR10: ``(id, importance)``: 0.7 degree + 0.3 betweenness, each over its maximum; no rows without edges.

    Degrees count distinct neighbours.  Betweenness takes one breadth-first tree from each of at
    most ``sources`` nodes (chosen by a hash, so always the same) and counts how often a node lies
    inside a path.  Trees run in parallel over a broadcast adjacency list of checked size; in a
    larger graph the same trees grow by joins.
    """
    both = undirected(edges.where("source_id <> target_id")).distinct()
    degree = both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    roots = degree.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sources)
    if both.count() <= MAX_BROADCAST_EDGES:
        through = _broadcast_passes(both, degree.select("id"), roots)
    else:
        through = _tree_passes(both, roots)
    joined = degree.join(through, "id", "left").withColumn("through", F.coalesce("through", F.lit(0)))
    top = joined.agg(F.max("degree").alias("d"), F.max("through").alias("t"))
    score = 0.7 * F.col("degree") / F.col("d") + 0.3 * F.when(F.col("t") > 0, F.col("through") / F.col("t")).otherwise(F.lit(0.0))
    return joined.crossJoin(F.broadcast(top)).select("id", F.round(score, 9).alias("importance"))
