"""Index builds: files to chunks, vectors, postings, graph and metadata, committed as one version (SRC1, SNK1-SNK6, SNK13, IN1-IN5, §3.2).

What has to be read from a text (chunks, vectors, postings, front matter, tags, links, entities) is
made for added and changed files only and kept for the others.  What depends on several files (how
often an entity occurs, which title a link means, dates, topics, importance) is joined anew from
these tables, so an update ends with the graph that a full build would give.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.chunking import chunk_files, front_matter
from corvane.functions.embedding import embed_cached, embed_column, hashed
from corvane.operators import analyzers, graph, incremental, keyword, metadata, vector
from corvane.schemas import filled
from corvane.session import checkpointed
from corvane.sources.markdown import files as scan
from corvane.sources.markdown import notes as note_nodes
from corvane.sources.snapshots import Snapshots

#: Edges of one kind at a node, and in all, as the greedy caps have them.
PER_NODE, IN_ALL = 20, 50_000


def upsert_chunks(held: DataFrame, new: DataFrame, embed: Callable = hashed, dimensions: int | None = None) -> DataFrame:
    """SNK1/SRC3: chunks ``(doc_id, content[, embedding, ...])`` checked, embedded where a vector is missing, normalised, and put in place of those with their ids.

    Blank ids or contents, and vectors of another size than the others or ``dimensions``, raise
    ``ValueError`` and change nothing.
    """
    if "embedding" not in new.columns:
        new = new.withColumn("embedding", F.lit(None).cast("array<float>"))
    given = new.where("embedding IS NOT NULL").withColumn("embedding", F.col("embedding").cast("array<double>"))
    made = new.where("embedding IS NULL").withColumn("embedding", embed_column(F.col("content"), embed).cast("array<double>"))
    full = checkpointed(given.unionByName(made))
    size = F.size("embedding")
    bad = full.agg(F.count_if(~(filled(F.col("doc_id")) & filled(F.col("content")))).alias("blank"), F.min(size).alias("least"), F.max(size).alias("greatest")).first()
    if bad["blank"]:
        raise ValueError(f"{bad['blank']} chunks have a blank id or content")
    sizes = {x for x in (bad["least"], bad["greatest"], dimensions) if x is not None}
    if len(sizes) > 1:
        raise ValueError(f"vectors have different numbers of dimensions: {sorted(sizes)}")
    return metadata.upsert(held, full.withColumn("embedding", vector.l2_normalise(F.col("embedding")).cast("array<float>")), "doc_id")


def with_front_matter(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, front, front_tags, body)``: front-matter values as strings, its tags apart, the text without it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, text in zip(b[path], b[content]):
                front, body = front_matter(text or "")
                tags = front.get("tags")
                tags = tags if isinstance(tags, list) else str(tags).split(",") if isinstance(tags, str) else []
                said = {k: v if isinstance(v, str) else json.dumps(v) for k, v in front.items() if v is not None}
                rows.append((p, said, [str(t) for t in tags], body))
            yield pd.DataFrame(rows, columns=["path", "front", "front_tags", "body"])

    return files.select(path, content).mapInPandas(run, "path string, front map<string,string>, front_tags array<string>, body string")


def document_tables(fronted: DataFrame, modified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK4-SNK6: documents with their metadata, their tags (of front matter and text), and their links as cross-references."""
    rows = fronted.join(modified, "path").select(F.col("path").alias("filename"), tx.title_from_filename(F.col("path")).alias("title"), "front", "front_tags", "body", F.col("modified").alias("updated_at"))
    docs = metadata.extract_metadata(rows).join(rows.select("filename", "updated_at"), "filename")
    tags = rows.select("filename", F.explode(F.concat("front_tags", tx.hashtags(F.col("body")))).alias("tag"))
    return docs, metadata.normalised_tags(tags), metadata.cross_references(rows.select("filename", F.explode(tx.wiki_links(F.col("body"))).alias("ref_target")))


def note_features(notes: DataFrame, fronts: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None, embed: Callable | None = None) -> DataFrame:
    """``(id, path, tags, links, entities, front[, embedding])`` of notes.

    ``extractor`` makes ``(id, entity)`` from notes in place of the patterns (UX6), for instance
    with :func:`corvane.operators.analyzers.model_entities`.
    """
    out = analyzers.note_features(notes).join(notes.select("id", F.col("source_file").alias("path")), "id").join(fronts, "path", "left")
    if extractor is not None:
        found = extractor(notes).groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
        out = out.drop("entities").join(found, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    if embed is not None:
        out = out.join(notes.select("id", embed_column(F.col("content"), embed).alias("embedding")), "id")
    return out


def graph_of(notes: DataFrame, features: DataFrame, min_frequency: int = 2, topics: bool = True, per_node: int | None = PER_NODE, in_all: int | None = IN_ALL, similarity: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from notes and their features: tags, references, entities, dates, topics,
    likeness (where the features have vectors); duplicates merged, weak edges gone, importance on the nodes."""
    tag_nodes, tag_edges = analyzers.tags(features)
    entity_nodes, entity_edges = analyzers.entities(features, min_frequency)
    dated = notes.join(features.select("id", "front"), "id", "left").withColumn("ts", analyzers.note_date(F.col("front"), F.col("created_at"), F.col("source_file")))
    near = analyzers.temporal(dated)
    if per_node is not None:
        near = analyzers.capped(checkpointed(near), per_node, in_all)
    kinds = [tag_edges, entity_edges, analyzers.references(features, notes.select("id", "title")), near]
    plain = lambda df: df.select("id", "type", "title")
    others = [plain(tag_nodes), plain(entity_nodes)]
    if topics:
        topic_nodes, topic_edges = analyzers.topics(notes)
        others.append(plain(topic_nodes))
        kinds.append(topic_edges)
    if "embedding" in features.columns:
        like = analyzers.semantic(features.select("id", "embedding"), similarity)
        kinds.append(like if per_node is None else analyzers.capped(checkpointed(like), per_node, in_all))
    nodes, edges = notes, kinds[0]
    for df in others:
        nodes = nodes.unionByName(df, allowMissingColumns=True)
    for df in kinds[1:]:
        edges = edges.unionByName(df)
    edges = edges.join(notes.select(F.col("id").alias("source_id"), "source_file"), "source_id", "left").dropDuplicates(["id"])
    # Notes of equal titles are different files; only the rest is merged.
    merged, edges = graph.merge_duplicates(nodes.withColumn("title", F.when(F.col("type") == "note", F.concat("title", F.lit("\u0000"), "id")).otherwise(F.col("title"))), checkpointed(edges))
    merged = merged.withColumn("title", F.substring_index("title", "\u0000", 1))
    edges = checkpointed(graph.weak_edges_removed(edges))
    return merged.join(graph.importance(edges), "id", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0))), edges


def build_graph(files: DataFrame, source_name: str = "", min_frequency: int = 2, extractor: Callable[[DataFrame], DataFrame] | None = None, embed: Callable | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The graph of files ``(path, content, modified)``; with ``embed`` also of their likeness."""
    notes = checkpointed(note_nodes(files, source_name))
    fronts = with_front_matter(files).select("path", "front")
    return graph_of(notes, checkpointed(note_features(notes, fronts, extractor, embed)), min_frequency, **options)


def index_folder(spark: SparkSession, root: str, store: Snapshots, source_name: str = "", chunker: str = "hybrid", embed: Callable = hashed, force: bool = False, extractor: Callable[[DataFrame], DataFrame] | None = None, semantic: bool = False, **graph_options) -> dict[str, int]:
    """Brings a store up to date with a folder; only added and changed files are read into tables.

    Returns how many files were added, modified, deleted and unchanged; without changes nothing
    is committed.  ``semantic`` adds edges between notes that are alike.
    """
    held = set() if force else set(store.tables())
    found = incremental.with_hash(scan(spark, root))
    known = store.read("provenance") if "provenance" in held else spark.createDataFrame([], "path string, content_hash string")
    status = checkpointed(incremental.changes(found.select("path", "hash"), known))
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    result = {s: counts.get(s, 0) for s in ("added", "modified", "deleted", "unchanged")}
    if held and result["unchanged"] == sum(result.values()):
        return result
    gone = checkpointed(status.where("status <> 'unchanged'").select("path"))
    fresh = checkpointed(found.join(status.where("status IN ('added', 'modified')"), "path", "left_semi"))

    def merged(name: str, new: DataFrame, column: str) -> DataFrame:
        """The rows of unchanged files with those of the others."""
        if name not in held:
            return new
        return store.read(name).join(gone.withColumnRenamed("path", column), column, "left_anti").unionByName(new, allowMissingColumns=True)

    chunks, cache = embed_cached(chunk_files(fresh, chunker, source_name=source_name), store.read("embedding_cache") if "embedding_cache" in held else None, "content", embed)
    chunks = checkpointed(chunks)
    posted = keyword.postings(chunks)
    if "postings" in held:
        old = store.read("chunks").join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("doc_id")
        posted = store.read("postings").join(old, "doc_id", "left_anti").unionByName(posted)
    fronted = checkpointed(with_front_matter(fresh))
    docs, tags, refs = document_tables(fronted, fresh.select("path", "modified"))
    notes = note_nodes(fresh, source_name)
    features = checkpointed(merged("note_features", note_features(notes, fronted.select("path", "front"), extractor, embed if semantic else None), "path"))
    notes = checkpointed(merged("notes", notes, "source_file").select(*notes.columns))
    nodes, edges = graph_of(notes, features, **graph_options)
    nodes = checkpointed(nodes)
    listing = found.select("path", "modified", "hash")
    store.commit(
        {
            "chunks": merged("chunks", chunks, "file_path"), "embedding_cache": cache, "postings": posted, "notes": notes, "note_features": features, "nodes": nodes, "edges": edges,
            "documents": merged("documents", docs, "filename"), "document_tags": merged("document_tags", tags, "filename"), "cross_refs": merged("cross_refs", refs, "filename"),
            "provenance": incremental.provenance(listing, nodes, edges, source_name),
        },
        sort={"chunks": "doc_id", "postings": "term"},
    )
    return result
