"""Ranked lists: fusion, deduplication, promotion, confirmation, blending (RT5-RT8, RT13, TK5-TK6, TK11-TK12, WN1-WN4, FLT10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import checkpointed

MAX_TOTAL = 1000


def ranked(df: DataFrame, *order: Column | str, by: str | list[str] | None = None, top: int | None = None) -> DataFrame:
    """WN1/WN2: ``rank`` from 1, within ``by`` if given, and only the first ``top``.

    Without ``by`` and ``top`` this is one task's work, for lists of a bounded size; :func:`numbered`
    ranks any number of rows.
    """
    if not by and top is not None:
        df = df.orderBy(*order).limit(top)
    w = Window.partitionBy(*([by] if isinstance(by, str) else by or [F.lit(0)])).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows with their place from 1 in a total order, at any size: sorted by ranges, each range counted, then shifted.

    The sorted rows are checkpointed, so that counts and places come from the same ranges.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.withColumn("__part", part).join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return joined.withColumn(name, (F.col("__before") + (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))) + 1).cast("int" if name == "rank" else "long")).drop("__at", "__part", "__before")


def truncated(lists: DataFrame) -> DataFrame:
    """TK12: where all lists together have over 1,000 rows, each is cut to its equal share.

    Rows beyond a list's first 1,001 can't stay and prove the excess, so only the rows up to there
    are counted, in the same pass; a list is bounded then, whatever its length.
    """
    w = Window.partitionBy(F.lit(0))
    some = lists.where(F.col("rank") <= MAX_TOTAL + 1).withColumns({"__n": F.count("*").over(w), "__lists": F.size(F.collect_set("list_no").over(w))})
    return some.where((F.col("__n") <= MAX_TOTAL) | (F.col("rank") <= F.floor(F.lit(MAX_TOTAL) / F.col("__lists")))).drop("__n", "__lists")


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, key: str = "doc_id", similarity: str | None = None, payload: list[str] | None = None, fallback: Column | None = None) -> DataFrame:
    """RT5: lists ``(list_no, rank, key, ...)`` fused: ``(key, rrf_score, rank, payload...)``.

    The score adds 1 / (k + rank) over every occurrence.  Of several versions of an item the
    most similar one stays, the first seen on a tie.  ``fallback`` names items whose key is null (UX3).  Order is by full precision, ties by first
    appearance; the score is rounded to 4 places after that.
    """
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 1000:
        raise ValueError("k has to be a whole number from 1 to 1000")
    if fallback is not None:
        lists = lists.withColumn(key, F.coalesce(F.col(key), fallback))
    seen = F.struct("list_no", "rank")
    pick = F.struct(F.coalesce(F.col(similarity), F.lit(float("-inf"))).alias("s"), (-F.col("list_no")).alias("l"), (-F.col("rank")).alias("r")) if similarity else F.struct((-F.col("list_no")).alias("l"), (-F.col("rank")).alias("r"))
    cols = [c for c in (payload or []) + ([similarity] if similarity else [])]
    fused = truncated(lists).groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("__score"), F.min(seen).alias("__seen"), *[F.max_by(F.col(c), pick).alias(c) for c in cols])
    w = Window.orderBy(F.desc(F.round("__score", 12)), "__seen.list_no", "__seen.rank", key)
    return fused.select(key, F.round("__score", 4).alias("rrf_score"), F.row_number().over(w).alias("rank"), *cols)


def basename(path: Column) -> Column:
    """A path's last part; of ``source::path::chunk`` the path counts."""
    parts = F.split(path, "::")
    inner = F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(path)
    return F.element_at(F.split(inner, "/"), -1)


def dedupe_by_file(results: DataFrame, path: str = "file_path", order: str = "rank", key: str = "name") -> DataFrame:
    """RT6/WN3: the first result of each file name; rows without a path all stay."""
    name = basename(F.col(path)) if key == "name" else F.col(path)
    blank = F.coalesce(F.col(path), F.lit("")) == ""
    w = Window.partitionBy(F.when(~blank, name), F.when(blank, F.col(order))).orderBy(order)
    return results.withColumn("__nth", F.row_number().over(w)).where(blank | (F.col("__nth") == 1)).drop("__nth")


def excerpt(content: Column, limit: int = 2000, side: int = 1000) -> Column:
    """RT7: a long text's head and tail."""
    return F.when(F.length(content) > limit, F.concat(F.rtrim(F.substring(content, 1, side)), F.lit("\n...\n"), F.ltrim(F.right(content, F.lit(side))))).otherwise(content)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blended(cosine: Column, rerank: Column, rrf: Column) -> Column:
    """RT8: 0.6 cosine + 0.15 sigmoid(rerank) + 0.25 min(30 rrf, 1), to 4 places."""
    return F.round(0.6 * cosine + 0.15 * sigmoid(rerank) + 0.25 * F.least(30 * rrf, F.lit(1.0)), 4)


def lexical_rerank(query_terms: list[str], content: Column) -> Column:
    """The default reranker: the share of the query's terms that an excerpt holds, as a probability."""
    hit = [F.when(F.contains(F.lower(excerpt(content)), F.lit(t.lower())), 1.0).otherwise(0.0) for t in query_terms]
    share = sum(hit, F.lit(0.0)) / max(1, len(hit))
    return sigmoid(4 * share - 2)


def filename_match(stem: Column, query: str) -> Column:
    """RT13: how well a file's stem matches a query: 3 the same, 2 one holds the other, 1 a common word, 0 nothing."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[-_]", " "))
    s, q = plain(stem), query.lower().replace("-", " ").replace("_", " ").strip()
    return F.when(s == q, 3).when(F.contains(s, F.lit(q)) | F.contains(F.lit(q), s), 2).when(F.arrays_overlap(F.split(s, r"\s+"), F.array(*[F.lit(w) for w in q.split() or [""]])), 1).otherwise(0)


def promoted(results: DataFrame, stem: Column, query: str, order: str = "rank", score: str = "rrf_score", many: bool = False) -> DataFrame:
    """TK11: for queries of up to three words, results whose stem matches well move to the front.

    A search's results are few and ranked in one task; with ``many`` they may be any number (:func:`numbered`).
    """
    if len(query.split()) > 3:
        return results
    m = filename_match(stem, query)
    by = (F.desc("__good"), F.desc(F.when(F.col("__good"), F.col("__match"))), F.desc(F.when(F.col("__good"), F.col(score))), F.col(order))
    marked = results.withColumn("__match", m).withColumn("__good", F.col("__match") >= 2)
    out = numbered(marked, *by, name="__new") if many else marked.withColumn("__new", F.row_number().over(Window.orderBy(*by)))
    return out.drop(order, "__match", "__good").withColumn(order, F.col("__new").cast("int")).drop("__new")


def confirmed(candidates: DataFrame, vector_hits: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """FLT10: candidates that the vector list holds too, or that came from metadata or vectors; all if that list is empty."""
    hit = vector_hits.select(F.col(key).alias("__hit")).distinct()
    some = vector_hits.agg((F.count("*") > 0).alias("__some"))
    joined = candidates.join(hit, candidates[key] == F.col("__hit"), "left").crossJoin(F.broadcast(some))
    return joined.where(~F.col("__some") | F.col("__hit").isNotNull() | F.col(source).isin("metadata", "vector")).drop("__hit", "__some")
