"""A PySpark engine for hybrid retrieval and corpus analytics."""

from corvane.functions.chunking import Chunk, by_headers, chunk_files, hybrid, semantic
from corvane.functions.embedding import embed_cached, embed_column, hashed
from corvane.functions.text import ACRONYMS, all_query_variants, register_acronyms
from corvane.operators.graph import connections, hub_nodes, importance, neighbours, shortest_path, similar_nodes, topic_web
from corvane.operators.incremental import Consistency
from corvane.operators.ranking import reciprocal_rank_fusion
from corvane.operators.vector import build_index, search_batch, search_index, similar_pairs
from corvane.plans.indexing import build_graph, index_folder
from corvane.plans.search import Stores, query_documents, search_embedding, unified, vector_search
from corvane.session import session
from corvane.sources.snapshots import Snapshots

__all__ = [
    "ACRONYMS", "Chunk", "Consistency", "Snapshots", "Stores", "all_query_variants", "build_graph", "build_index", "by_headers", "chunk_files", "connections", "embed_cached", "embed_column",
    "hashed", "hub_nodes", "hybrid", "importance", "index_folder", "neighbours", "query_documents", "reciprocal_rank_fusion", "register_acronyms", "search_batch", "search_embedding", "search_index",
    "semantic", "session", "shortest_path", "similar_nodes", "similar_pairs", "topic_web", "unified", "vector_search",
]
