"""Schemas of the stores: chunks, postings, graph, document metadata, usage and change tracking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l, _i, _d, _t = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CHUNKS = _of(doc_id=_s, content=_s, metadata=_s, embedding=T.ArrayType(T.FloatType()), created=_t, l0_abstract=_s, l1_overview=_s, l0_embedding=T.ArrayType(T.FloatType()), l1_embedding=T.ArrayType(T.FloatType()))
NODES = _of(id=_s, type=_s, title=_s, content=_s, metadata=_s, created_at=_t, source_file=_s, source_name=_s)
EDGES = _of(id=_s, source_id=_s, target_id=_s, type=_s, weight=_d, confidence=_d, metadata=_s, created_at=_t, source_file=_s, source_name=_s)
DOCUMENTS = _of(filename=_s, title=_s, category=_s, status=_s, project=_s, created_date=_s, updated_date=_s, meta=T.MapType(_s, _s), created_at=_t, updated_at=_t)
DOCUMENT_TAGS = _of(filename=_s, tag=_s)
CROSS_REFS = _of(filename=_s, ref_type=_s, ref_target=_s)
USAGE = _of(filename=_s, action=_s, source=_s, ts=_t)
PROVENANCE = _of(file_path=_s, source_name=_s, last_modified=_d, content_hash=_s, node_count=_l, edge_count=_l, indexed_at=_t)
FILE_CACHE = _of(cache_key=_s, last_modified=_d, source_name=_s, last_indexed=_t)

NODE_TYPES = ("note", "entity", "topic", "tag", "folder")
RELATIONS = ("references", "tagged_as", "similar_to", "discusses", "mentions", "part_of", "temporal", "uses", "enables", "created_by", "influences", "requires", "evolved_from")
ACTIONS = ("search_hit", "read", "update")


def in_unit(c: Column) -> Column:
    """Whether a weight or confidence lies in [0, 1]."""
    return c.between(F.lit(0.0), F.lit(1.0))


def filled(c: Column) -> Column:
    """Whether a required text is there and isn't blank."""
    return c.isNotNull() & (F.length(F.trim(c)) > 0)
