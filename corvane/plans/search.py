"""Composed searches: variants, four layers and their fusion (RT3, RT3b, RT11, RT12, RT14, JN12, JN15, JN16, FLT11)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.embedding import hashed
from corvane.functions.text import all_query_variants
from corvane.operators import graph, keyword, metadata, ranking, vector
from corvane.session import checkpointed
from corvane.sources.snapshots import Snapshots

MAX_LIMIT, MAX_QUERY = 100, 1000


@dataclass
class Stores:
    """What a search reads; graph and metadata may be missing."""

    chunks: DataFrame  # doc_id, content, file_path, embedding
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    documents: DataFrame | None = None
    tags: DataFrame | None = None
    postings: DataFrame | None = None  # keyword.postings of the chunks; where they aren't stored, the texts are counted for the query

    @classmethod
    def of(cls, store: Snapshots) -> Stores:
        """What an indexed store holds."""
        return cls(*(store.read(t) for t in ("chunks", "nodes", "edges", "documents", "document_tags", "postings")))


def simple_variants(query: str) -> list[str]:
    """RT4 on the driver: spellings with and without a space before digits and with hyphens gone."""
    import re

    forms = [query, query.lower()]
    for pattern, put in ((r"\b([A-Za-z]+)(\d+)\b", r"\1 \2"), (r"\b([A-Za-z]+)\s+(\d+)\b", r"\1\2")):
        form = re.sub(pattern, put, query)
        forms += [form, form.lower()] if form != query else []
    forms += [query.replace("-", ""), query.replace("-", " ")]
    return list(dict.fromkeys(forms)) if query.strip() else []


def lexical(query: str, content: Column) -> Column:
    """The default reranker."""
    return ranking.lexical_rerank(query.split(), content)


def _check(query: str, limit: int, threshold: float) -> None:
    if not query or not query.strip() or len(query) > MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
    if not 1 <= limit <= MAX_LIMIT or not 0 <= threshold <= 1:
        raise ValueError(f"limits are 1 to {MAX_LIMIT}, thresholds 0 to 1")


def vector_search(stores: Stores, query: str, limit: int = 5, threshold: float = 0.3, embed: Callable[[list[str]], np.ndarray] = hashed, rerank_limit: int | None = 5, expand: str = "simple", reranker: Callable[[str, Column], Column] | None = lexical) -> DataFrame:
    """RT3: ``(doc_id, file_path, content, similarity, rrf_score, rerank, score, rank)``.

    All variants are searched in one batch, fused by rank, cut to one chunk a file, reranked
    (``rerank_limit`` keeps so many) and blended.  ``reranker`` makes a column of probabilities from
    the query and the content (UX2), for instance a Pandas UDF over a cross-encoder; with none,
    the score is the fused one and ``rerank`` is null.
    """
    _check(query, limit, threshold)
    forms = [query] if len(query) < 3 else all_query_variants(query) if expand == "full" else simple_variants(query)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(embed(forms))]
    queries = stores.chunks.sparkSession.createDataFrame(rows, "list_no int, embedding array<double>")
    hits = vector.search_batch(stores.chunks, queries, min(2 * limit, 20), "doc_id", "list_no", threshold=threshold)
    fused = ranking.reciprocal_rank_fusion(hits, similarity="similarity")
    full = F.broadcast(fused).join(stores.chunks.select("doc_id", "file_path", "content"), "doc_id")  # few rows, so no text is shuffled
    once = ranking.dedupe_by_file(full)
    if reranker is None:
        scored = once.withColumn("rerank", F.lit(None).cast("double")).withColumn("score", F.col("rrf_score")).drop("rank")
        return ranking.ranked(scored, F.desc("score"), F.desc("similarity"), "doc_id", top=limit)
    scored = once.withColumn("rerank", reranker(query, F.col("content")))
    if rerank_limit:
        scored = ranking.ranked(scored.withColumnRenamed("rank", "fused_rank"), F.desc("rerank"), "fused_rank", top=rerank_limit).drop("rank", "fused_rank")
    else:
        scored = scored.drop("rank")
    scored = scored.withColumn("score", ranking.blended(F.col("similarity"), F.col("rerank"), F.col("rrf_score")))
    return ranking.ranked(scored, F.desc("score"), "doc_id", top=limit)


def search_embedding(stores: Stores, query, limit: int = 5, threshold: float = 0.3) -> DataFrame:
    """RT3b: by a vector; the limit counts chunks, files are deduplicated after it."""
    hits = vector.search(stores.chunks, query, limit, threshold, "doc_id")
    full = ranking.ranked(hits, F.desc("similarity"), "doc_id").join(stores.chunks.select("doc_id", "file_path", "content"), "doc_id")
    return ranking.dedupe_by_file(full)


def graph_candidates(stores: Stores, query: str, stop: tuple[str, ...] = ("the", "and", "for", "what", "how", "with")) -> DataFrame:
    """RT12: ``(title, score)``: the whole query two hops around (3 for each relation), its first words one hop (2 each), topics (5)."""
    parts = [(query, 2, 3)] + [(w, 1, 2) for w in [x for x in query.split() if len(x) > 2 and x.lower() not in stop][:3]]
    out = None
    for text, depth, most in parts:
        found = graph.connections(stores.nodes, stores.edges, text, depth).select("type", F.explode(F.slice("connections", 1, most)).alias("c")).select(F.col("c.node").alias("id"), F.least(F.lit(0.5), F.col("c.weight") / F.col("c.distance")).alias("score"))
        out = found if out is None else out.unionByName(found)
    if len(query.split()) <= 3:
        out = out.unionByName(graph.topic_web(stores.nodes, stores.edges, query).limit(5).select("id", F.least(F.lit(0.5), "weight").alias("score")))
    return out.join(stores.nodes.select("id", "title", "source_file"), "id").groupBy("title").agg(F.max("score").alias("score"), F.min("source_file").alias("source_file"))


def unified(stores: Stores, query: str, limit: int = 5, threshold: float = 0.3, enrich: bool = True, filters: dict | None = None, key: str = "name", embed: Callable = hashed, reranker: Callable[[str, Column], Column] | None = lexical) -> DataFrame:
    """RT11/FLT11: vector, keyword, metadata and graph lists fused, with the ``mode`` of the search: the layers that took part.

    The layers are branches of one plan; only the graph's walk, which goes hop by hop, cuts its own with checkpoints.

    ``key="name"`` fuses vector hits under the file's base name and the others under their path, as
    the reference does; ``key="path"`` uses paths throughout.
    """
    _check(query, limit, threshold)
    each = 3 * limit
    name = (lambda c: ranking.basename(c)) if key == "name" else (lambda c: c)
    near = vector_search(stores, query, min(each, MAX_LIMIT), threshold, embed, reranker=reranker).select(name(F.col("file_path")).alias("doc_id"), "rank", F.col("doc_id").alias("chunk"), "content")
    near = checkpointed(near)  # a few rows, needed in three places
    lists = [near.select(F.lit(0).alias("list_no"), "rank", "doc_id", F.lit("vector").alias("source"))]
    if any(keyword.search_terms(query)):
        hits = keyword.bm25_indexed(stores.postings, stores.chunks, query) if stores.postings is not None else keyword.bm25_texts(stores.chunks, query)
        hits = F.broadcast(ranking.ranked(hits.orderBy(F.desc("score"), "doc_id").limit(each), F.desc("score"), "doc_id")).join(stores.chunks.select("doc_id", "file_path"), "doc_id")
        lists.append(hits.select(F.lit(1).alias("list_no"), "rank", F.col("file_path").alias("doc_id"), F.lit("keyword").alias("source")))
    if stores.documents is not None:
        docs = metadata.filter_documents(stores.documents, stores.tags, limit=each, **filters) if filters else metadata.title_search(stores.documents, query, each)
        lists.append(ranking.ranked(docs, F.desc("updated_at"), "filename").select(F.lit(2).alias("list_no"), "rank", F.col("filename").alias("doc_id"), F.lit("metadata").alias("source")))
    if stores.nodes is not None:
        found = graph_candidates(stores, query).where("source_file IS NOT NULL")
        lists.append(ranking.ranked(found, F.desc("score"), "title").select(F.lit(3).alias("list_no"), "rank", F.col("source_file").alias("doc_id"), F.lit("graph").alias("source")))
    names = ["vector", *(["keyword"] if any(keyword.search_terms(query)) else []), *(["metadata"] if stores.documents is not None else []), *(["graph"] if stores.nodes is not None else [])]
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    fused = ranking.reciprocal_rank_fusion(union, payload=["source"])
    good = ranking.confirmed(fused, near)
    best = ranking.promoted(good, F.regexp_replace(ranking.basename(F.col("doc_id")), r"\.[^.]*$", ""), query)
    top = best.orderBy("rank").limit(limit).join(near.dropDuplicates(["doc_id"]).select("doc_id", "chunk", "content"), "doc_id", "left").withColumn("mode", F.lit("+".join(names)))
    return with_related(stores, top) if enrich and stores.nodes is not None else top


def with_related(stores: Stores, results: DataFrame, by: int = 3, most: int = 5) -> DataFrame:
    """JN16: each result's related titles: at most 3 for each relation, 5 in all."""
    mine = stores.nodes.where("type = 'note'").select(F.col("id").alias("u"), ranking.basename(F.col("source_file")).alias("name"))
    near = results.select("doc_id", ranking.basename(F.col("doc_id")).alias("name")).join(mine, "name").join(graph.undirected(stores.edges, "type", "weight"), "u")
    near = near.join(stores.nodes.select(F.col("id").alias("v"), "title"), "v")
    w = Window.partitionBy("doc_id", near["type"]).orderBy(F.desc("weight"), "title")
    held = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= by).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "title"))).alias("x"))
    return results.join(held.select("doc_id", F.slice(F.array_distinct(F.col("x.title")), 1, most).alias("related")), "doc_id", "left")


def query_documents(stores: Stores, **filters) -> DataFrame:
    """RT14: documents by metadata, each with its tags."""
    return metadata.with_tags(metadata.filter_documents(stores.documents, stores.tags, **filters), stores.tags)
